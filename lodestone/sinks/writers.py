"""Writers: designs as CSV and SDF, marked structures, heterogeneous unions, decisions as JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import round_or_blank
from lodestone.operators.selection import global_rank

# Columns of the design table in order, and those rounded to four places.
DESIGN = ["rank", "id", "smiles", "pareto_front", "composite", "vina_score", "QED", "SA_score", "clash_frac", "out_frac", "ph4", "interaction", "hbond_score", "pipi_score", "hbond_matches", "pipi_matches", "heavy_atoms", "growth_step"]
ROUNDED = ["composite", "vina_score", "QED", "SA_score", "clash_frac", "out_frac", "ph4", "interaction", "hbond_score", "pipi_score"]


def design_rows(states: DataFrame, order: list[Column]) -> DataFrame:
    """The design table as text: rank and id by position, floats at four places, null as blank."""
    ranked = global_rank(states, order, "rank")
    ranked = ranked.withColumn("id", F.format_string("design_%04d", "rank"))
    return ranked.select(*[(round_or_blank(F.col(c)) if c in ROUNDED else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in DESIGN])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def mol_block(title: Column, atoms: Column, bonds: Column, props: Column) -> Column:
    """A V2000 record; ``props`` is an array<struct<name,value>>, null values are left out."""
    atom = F.array_join(F.transform(atoms, lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0  0  0  0  0  0  0\n", a["x"], a["y"], a["z"], a["elem"])), "")
    bond = F.array_join(F.transform(bonds, lambda b: F.format_string("%3d%3d%3d  0\n", b["a"], b["b"], b["order"])), "")
    prop = F.array_join(F.transform(F.filter(props, lambda p: p["value"].isNotNull()), lambda p: F.format_string(">  <%s>\n%s\n\n", p["name"], p["value"])), "")
    head = F.concat(title, F.lit("\n  lodestone\n\n"), F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000\n", F.size(atoms), F.size(bonds)))
    return F.concat(head, atom, bond, F.lit("M  END\n"), prop, F.lit("$$$$"))


def write_sdf(df: DataFrame, path: str, block: str = "block") -> None:
    df.select(block).write.text(path)


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns as text; one that isn't there, or a null, is blank."""
    return df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def design_props(states: DataFrame, optional: tuple[str, ...] = ("vina_score", "pareto_front")) -> Column:
    """A design's properties as text, floats at four places: array<struct<name,value>>; an optional one that is null is left out by the writer."""
    def text(c: str) -> Column:
        v = F.format_string("%.4f", F.col(c)) if c in ROUNDED else F.col(c).cast("string")
        return F.when(F.col(c).isNotNull(), v) if c in optional else F.coalesce(v, F.lit(""))

    return F.array(*[F.struct(F.lit(c).alias("name"), text(c).alias("value")) for c in DESIGN if c in states.columns])


def molecule_index(records: DataFrame, key: Column) -> DataFrame:
    """(key, title, atoms, bonds, props): the first record of each key; blank keys go."""
    rows = records.withColumn("key", key).where(F.trim("key") != "")
    first = F.min_by(F.struct("title", "atoms", "bonds", "props"), F.struct("file", "ord"))
    return rows.groupBy("key").agg(first.alias("r")).select("key", "r.*")


def subset(selected: DataFrame, index: DataFrame, key: str, rank: str) -> DataFrame:
    """Records of the selected candidates that have a molecule, with ``block``, in order of ``rank``: the molecule's properties, those of the selection winning.

    ``selected`` has its own properties in a map column ``row``; blank ones are left out."""
    found = selected.join(index.withColumnRenamed("key", key), key)
    props = merged_props(F.col("props"), F.map_filter("row", lambda _, v: v.isNotNull() & (v != "")))
    pairs = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return found.select(key, rank, mol_block(F.col("title"), F.col("atoms"), F.col("bonds"), pairs).alias("block")).orderBy(rank)


def union_of_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns: columns in order of first appearance, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged_props(props: Column, computed: Column) -> Column:
    """Both maps' entries; computed ones win."""
    kept = F.map_filter(props, lambda k, _: ~F.map_contains_key(computed, k))
    return F.map_concat(kept, computed)


def marker_line(serial: Column, number: Column, x: Column, y: Column, z: Column, chain: str = "Z", resname: str = "DU") -> Column:
    """A marker's line; a serial beyond 99,999 runs over into column 12, which is blank otherwise and read back by :func:`lodestone.sources.pdb.atoms`."""
    return F.format_string(f"HETATM%-6s DU  {resname:>3s} {chain:1s}%4d    %8.3f%8.3f%8.3f  1.00  0.00          DU", F.format_string("%5d", serial), number, x, y, z)


def with_markers(lines: DataFrame, centres: DataFrame, key: str = "file") -> DataFrame:
    """(key, section, ord, value): structure lines with marker lines before the first MASTER, ENDMDL or END.

    ``centres``: (key, ord, x, y, z).  Serials go on from the largest, residue numbers start at 1."""
    v = F.col("value")
    ends = v.startswith("MASTER") | v.startswith("END")
    facts = lines.groupBy(key).agg(
        F.coalesce(F.max(F.when(v.startswith("ATOM") | v.startswith("HETATM"), F.trim(F.substring("value", 7, 6)).try_cast("int"))), F.lit(0)).alias("serial"),
        F.min(F.when(ends, F.col("line_no"))).alias("cut"),
    )
    old = lines.join(facts, key).select(key, F.when(F.col("cut").isNull() | (F.col("line_no") < F.col("cut")), 0).otherwise(2).alias("section"), F.col("line_no").cast("long").alias("ord"), "value")
    number = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    new = centres.withColumn("number", number).join(facts, key)
    new = new.select(key, F.lit(1).alias("section"), F.col("number").cast("long").alias("ord"), marker_line(F.col("serial") + F.col("number"), F.col("number"), F.col("x"), F.col("y"), F.col("z")).alias("value"))
    return old.unionByName(new)


def decisions_json(pockets: DataFrame, key: str = "pdb_id") -> DataFrame:
    """One JSON text per structure: its pockets with volume, decision and reasons."""
    body = F.struct("pocket_id", "volume", "selected", "reasons")
    return pockets.groupBy(key).agg(F.array_sort(F.collect_list(body)).alias("pockets")).select(key, F.to_json(F.struct(key, "pockets")).alias("json"))


def error_json(failures: DataFrame, key: str = "pdb_id") -> DataFrame:
    """One JSON text for each structure that failed: its id, the error and its type."""
    return failures.select(key, F.to_json(F.struct(key, "error", "type")).alias("json"))


def sweep_report(facts: dict[str, object], front: DataFrame, shortlist: DataFrame, columns: list[str]) -> str:
    """A run's report as Markdown: its facts, and tables of the front (15 rows) and the shortlist."""
    lines = ["# Sweep Analysis Summary", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for title, df, limit in (("Pareto Front", front, 15), ("Ranked Shortlist", shortlist, 50)):
        lines += ["", f"## {title}", "", f"No {title} rows." if df.isEmpty() else markdown(df, columns, limit)]
    return "\n".join(lines)


def swapped(df: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Replace what lies at ``path``: written beside it first, so that a failed write leaves the old one, and ``df`` may read it.

    Names beside it are of this call alone.  A rename that doesn't succeed is an error, and the old table is put back."""
    spark = df.sparkSession
    own = uuid.uuid4().hex
    fresh, old = f"{path}.new-{own}", f"{path}.old-{own}"
    write(df.write.mode("error"), fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        fs.delete(at(fresh), True)
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(at(fresh), at(path)):
        if there and not fs.rename(at(old), at(path)):
            raise OSError(f"{path} lies at {old}")
        raise OSError(f"{fresh} can't be moved to {path}")
    if there:
        fs.delete(at(old), True)


def save_cache(df: DataFrame, path: str) -> None:
    """Replace a cache of JSON lines."""
    swapped(df, path, lambda w, p: w.json(p))


def rewrite_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV table by a version of itself with other columns."""
    swapped(df, path, lambda w, p: w.option("header", True).option("emptyValue", "").option("nullValue", "").csv(p))


def markdown(df: DataFrame, columns: list[str], limit: int = 20) -> str:
    """A small table for a report."""
    rows = df.select(*columns).limit(limit).collect()
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(text(v) for v in r) + " |" for r in rows]])
