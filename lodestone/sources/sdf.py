"""Molecule files: records separated by $$$$ lines, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import chemistry, numeric, text


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, title, atoms, bonds, props, block): one row per readable record.

    Records end at lines that are ``$$$$``, whichever way lines end; the same signs within a line
    end nothing.  Files are split at record ends, so large ones are read by many tasks;
    empty files and records that can't be read give no rows."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = spark.read.option("lineSep", "\n$$$$").text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    return parse_sdf(records(raw))


#: What stands after a record's end: the rest of its line, which has to be empty.
AFTER = r"^[ \t]*(\r?\n|\r?$)"


def records(raw: DataFrame) -> DataFrame:
    """(file, ord, block) of parts of files (file, place, value) that were cut before every line that begins with ``$$$$``.

    A part that goes on in the same line was cut inside a record: it joins the part before, as only
    the files with such a part are looked at again."""
    first = raw.groupBy("file").agg(F.min("place").alias("place"), F.max(F.when(~F.col("value").rlike(AFTER), F.col("place"))).alias("odd"))
    # a file's first part follows no record's end
    wrong = first.where(F.col("odd") > F.col("place")).select("file")
    starts = first.select("file", "place", F.lit(True).alias("starts"))
    rows = raw.join(starts, ["file", "place"], "left")
    whole = F.when(F.coalesce("starts", F.lit(False)), F.col("value")).otherwise(F.regexp_replace("value", AFTER, ""))
    right = rows.join(wrong, "file", "left_anti").select("file", F.col("place.at").alias("ord"), whole.alias("block"))
    own = F.coalesce("starts", F.lit(False)) | F.col("value").rlike(AFTER)
    number = F.sum(own.cast("int")).over(Window.partitionBy("file").orderBy("place"))
    joined = rows.join(wrong, "file", "left_semi").withColumn("number", number).withColumn("own", own)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]), "\n$$$$")
    joined = joined.groupBy("file", "number").agg(F.min("place").alias("place"), text.alias("value"), F.max("starts").alias("starts"))
    return right.unionByName(joined.select("file", F.col("place.at").alias("ord"), whole.alias("block")))


def parse_sdf(raw: DataFrame) -> DataFrame:
    """Parse records given as (file, ord, block)."""
    lines = F.split("block", r"\r?\n")
    rows = raw.where(F.trim("block") != "").withColumn("lines", lines)
    counts = F.get("lines", 3)
    n = lambda a: F.trim(F.substring(counts, a, 3)).try_cast("int")
    rows = rows.withColumns({"n_atoms": n(1), "n_bonds": n(4)}).where("n_atoms is not null and n_bonds is not null")
    cut = lambda s, a, w: F.trim(F.substring(s, a, w))
    atoms = F.transform(F.slice("lines", 5, F.col("n_atoms")), lambda s: F.struct(cut(s, 32, 3).alias("elem"), *[cut(s, a, 10).try_cast("double").alias(c) for a, c in ((1, "x"), (11, "y"), (21, "z"))]))
    bonds = F.transform(F.slice("lines", F.col("n_atoms") + 5, F.col("n_bonds")), lambda s: F.struct(*[cut(s, a, 3).try_cast("int").alias(c) for a, c in ((1, "a"), (4, "b"), (7, "order"))]))
    rows = rows.withColumns({"atoms": atoms, "bonds": bonds}).where(F.size("atoms") == F.col("n_atoms"))
    names = F.transform(F.filter(F.transform("lines", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda p: p["s"].rlike(r"^>.*<[^>]+>")), lambda p: F.struct(F.regexp_extract(p["s"], r"<([^>]+)>", 1).alias("key"), F.trim(F.coalesce(F.get("lines", p["i"] + 1), F.lit(""))).alias("value")))
    # a repeated name keeps its last value
    keys = F.array_distinct(F.transform(names, lambda p: p["key"]))
    props = F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(names, lambda p: p["key"] == k), -1)))
    return rows.select("file", "ord", F.trim(F.get("lines", 0)).alias("title"), "atoms", "bonds", props.alias("props"), "block")


def scored(records: DataFrame) -> DataFrame:
    """With the score found in properties or text and where it was found."""
    return records.withColumn("found", text.score_of(F.col("props"), F.col("block"))).select("*", F.col("found.score").alias("score"), F.col("found.source").alias("score_source")).drop("found")


def size_metrics(records: DataFrame) -> DataFrame:
    """Median heavy atoms and median weight for each file."""
    return records.groupBy("file").agg(F.median(chemistry.heavy_atoms(F.col("atoms"))).alias("median_heavy_atoms"), F.median(chemistry.weight(F.col("atoms"))).alias("median_mol_wt"))


def numeric_prop(*names: str) -> Column:
    """The first of these properties that is a number."""
    return F.coalesce(*[numeric.lenient_double(F.try_element_at("props", F.lit(n))) for n in names])
