"""Fragment libraries: small files parsed on the driver, or lines in any table."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.smiles import graph
from lodestone.session import each_once, met

# Header names and the built-in library.
HEADER = {"smiles", "name", "fragment", "fragment_name", "id", "identifier", "reagent_id", "attach_map_num", "attachment_map_num"}
SINGLE_ATOMS = [("C", 6, []), ("N", 7, []), ("O", 8, []), ("S", 16, []), ("F", 9, []), ("Cl", 17, []), ("Br", 35, []), ("C=O", 6, [(8, 2)]), ("C=N", 6, [(7, 2)]), ("C#N", 6, [(7, 3)]), ("C#C", 6, [(6, 3)]), ("S=O", 16, [(8, 2)]), ("S(=O)=O", 16, [(8, 2), (8, 2)])]
FIXED = [("C(=O)N", "[C:1](=O)N", 1), ("C(=O)NC", "[C:1](=O)NC", 1), ("C(=O)N(C)C", "[C:1](=O)N(C)C", 1), ("OC", "[O:1]C", 1), ("NC", "[N:1]C", 1), ("N(C)C", "[N:1](C)C", 1)]
ALKENES = [("C=C(E)", "E"), ("C=C(Z)", "Z")]
RINGS = [
    ("Ph", "c1ccccc1"), ("Py", "c1ccncc1"), ("Nap", "c1ccc2ccccc2c1"), ("Ind", "c1ccc2[nH]ccc2c1"), ("Qui", "c1ccc2ncccc2c1"),
    ("iQui", "c1ccc2ccncc2c1"), ("Bzt", "c1ccc2sccc2c1"), ("Pyz", "n1ccncc1"), ("Pym", "n1cnccc1"), ("Pydz", "n1ncccc1"),
    ("Fur", "c1ccoc1"), ("Thio", "c1ccsc1"), ("Tz", "c1nccs1"), ("Imid", "c1cnc[nH]1"), ("Oxz", "c1cnoc1"), ("Pyr", "c1cc[nH]c1"),
    ("Indn", "c1ccc2CCCc2c1"), ("Tet", "c1ccc2CCCCc2c1"), ("cPr", "C1CC1"), ("cPen", "C1CCCC1"), ("cHex", "C1CCCCC1"),
    ("Dec", "C1CCC2CCCCC2C1"), ("Nor", "C1CC2CCC1C2"), ("BCP", "C1C2CC1C2"), ("Pip", "C1CCNCC1"), ("Mor", "N1CCOCC1"), ("Pipz", "N1CCNCC1"), ("Pyrr", "C1CCNC1"),
]


def balanced(smiles: str) -> bool:
    """A light validity test without a toolkit: brackets close, ring digits pair up, known characters."""
    if not smiles or re.search(r"[^A-Za-z0-9@+\-\[\]()=#$:/\\.%*]", smiles):
        return False
    bare = re.sub(r"\[[^\[\]]*\]", "A", smiles)
    depth = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    digits = re.findall(r"%\d\d|\d", bare)
    return depth == 0 and "[" not in bare and "]" not in bare and all(digits.count(d) % 2 == 0 for d in digits)


def parse(text: str, fixed: bool = False) -> list[tuple]:
    """(name, smiles) or, for ``fixed``, (name, smiles, attach_map_num) of a fragment file.

    '#' lines and blanks are skipped; commas make CSV (name, SMILES), tabs or spaces
    SMILES name; a header that names a smiles column sets the order of CSV fields.
    A wrong line or an empty file is an error.
    """
    out: list[tuple] = []
    columns: dict[str, int] = {}
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        commas = "," in line
        fields = [f.strip() for f in (next(csv.reader([line])) if commas else line.split("\t") if "\t" in line else line.split())]
        fields = fields if commas and columns else [f for f in fields if f]
        lowered = [f.strip("\"'").lower() for f in fields]
        if "smiles" in lowered and set(lowered) <= HEADER:
            columns = {}
            for i, token in enumerate(lowered):
                slot = "smiles" if token == "smiles" else "map" if token.startswith("attach") else "name"
                if not (slot == "name" and "name" in columns and token in ("id", "identifier", "reagent_id")):
                    columns[slot] = i
            continue
        attach = None
        if commas and columns:
            get = lambda k: fields[columns[k]] if k in columns and columns[k] < len(fields) else ""  # noqa: B023, E731
            smiles, name, attach = get("smiles"), get("name") or get("smiles"), get("map")
        elif len(fields) == 1:
            name = smiles = fields[0]
        elif len(fields) in (2, 3) and (fixed or len(fields) == 2):
            name, smiles = fields[:2] if commas else (fields[1], fields[0])
            attach = fields[2] if len(fields) == 3 else None
        else:
            raise ValueError(f"fragment line {number}: wrong number of fields")
        if not balanced(smiles):
            raise ValueError(f"fragment line {number}: no valid SMILES: {smiles!r}")
        if not fixed:
            out.append((name, smiles))
            continue
        try:
            attach = int(attach or 1)
        except ValueError:
            raise ValueError(f"fragment line {number}: attachment number {attach!r}") from None
        if f":{attach}]" not in smiles:
            raise ValueError(f"fragment line {number}: atom map number {attach} is not in {smiles!r}")
        out.append((name, smiles, attach))
    if not out:
        raise ValueError("no fragments found")
    return out


def read_fragments(spark: SparkSession, path: str | None = None, fixed: bool = False) -> DataFrame:
    """A fragment table; without a path the built-in one."""
    schema = "name string, smiles string" + ", attach_map_num int" * fixed
    if path is None:
        return spark.createDataFrame(FIXED if fixed else RINGS, schema)
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse(text.value if text else "", fixed), schema)


def single_atoms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SINGLE_ATOMS, "name string, z int, extras array<struct<z:int,order:int>>")


def alkenes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALKENES, "name string, stereo string")


def read_lines(df: DataFrame, line: str) -> DataFrame:
    """Lines of fragment files, anywhere in a table, as (name, smiles, map, graph) beside the other columns; comments, blanks and lines without a SMILES go.

    A line with a comma holds name, SMILES (quotes are left out); one with tabs or spaces SMILES, name and, if there is one, a map number; a bare SMILES names itself."""
    text = F.trim(F.col(line))
    commas = text.contains(",")
    fields = F.filter(F.transform(F.when(commas, F.split(text, ",")).when(text.contains("\t"), F.split(text, "\t")).otherwise(F.split(text, r"\s+")), lambda x: F.trim(F.regexp_replace(F.trim(x), "^\"|\"$", ""))), lambda x: x != "")
    rows = df.where((text != "") & ~text.startswith("#")).withColumn("__f", fields).where(F.size("__f").between(1, 3))
    part = lambda i: F.get("__f", i)
    named = F.when(commas & (F.size("__f") > 1), F.struct(part(0).alias("name"), part(1).alias("smiles"))).otherwise(F.struct(F.coalesce(part(1), part(0)).alias("name"), part(0).alias("smiles")))
    own = [c for c in df.columns if c not in (line, "name", "smiles", "map", "graph")]
    rows = rows.select(*own, named.alias("__n"), part(2).try_cast("int").alias("map")).select(*own, "__n.name", "__n.smiles", "map")
    # each different SMILES is read once, however many lines have it
    found = each_once(rows, "smiles", lambda some: some.select("smiles", graph(F.col("smiles")).alias("graph"))).where(F.col("graph").isNotNull())
    return met(rows, found, "smiles")
