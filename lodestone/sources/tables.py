"""Tabular inputs: summaries with varying headers, id lists, caches, growing run folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import numeric

# Column names that mean the same.
ALIASES = {
    "smiles": ["smiles", "SMILES"],
    "composite": ["composite", "composite_grower"],
    "vina": ["vina_score", "vina", "VINA", "docking_score", "binding_energy", "affinity"],
    "source_id": ["id", "source_id", "_Name"],
}
ID_COLUMNS = ["pdb_id", "pdb", "pdbid", "PDB", "PDB_ID", "id"]


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """All columns as text, with the file and the row's place in it.

    With ``line_breaks`` quoted values may hold some, and a file is read by one task, as a run's
    summary is; files without, however large, are split if it is off."""
    df = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return df.withColumns({"_file": F.input_file_name(), "_ord": F.monotonically_increasing_id()})


def candidates(rows: DataFrame) -> DataFrame:
    """Typed candidates of summary rows (text columns, _file, _ord); rows without SMILES or a numeric composite go.

    The cavity is the file's name without ``_summary.csv``; a row without an id is
    named by its place among the rows kept.
    """
    name = F.regexp_extract("_file", r"([^/]*)$", 1)
    cavity = F.when(name.endswith("_summary.csv"), F.regexp_replace(name, r"_summary\.csv$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    out = rows.select(
        "*",
        cavity.alias("cavity_id"),
        numeric.first_present(rows, ALIASES["smiles"]).alias("_smiles"),
        numeric.lenient_double(numeric.first_present(rows, ALIASES["composite"])).alias("composite_value"),
        numeric.lenient_double(numeric.first_present(rows, ALIASES["vina"])).alias("vina_value"),
        (numeric.lenient_int(F.col("rank"), True) if "rank" in rows.columns else F.lit(None).cast("int")).alias("_rank"),
        numeric.first_present(rows, ALIASES["source_id"]).alias("_id"),
    ).where("_smiles is not null and composite_value is not null")
    place = F.row_number().over(Window.partitionBy("cavity_id").orderBy("_ord"))
    return out.withColumn("candidate_id", F.coalesce("_id", F.format_string("row_%04d", place)))


def id_list(df: DataFrame, column: str | None = None) -> DataFrame:
    """Upper-case distinct ids in order of first appearance: (ord, pdb_id)."""
    column = column or next((c for c in ID_COLUMNS if c in df.columns), None)
    if column is None:
        raise ValueError(f"no id column among {df.columns}")
    rows = df.select(F.monotonically_increasing_id().alias("ord"), F.upper(F.trim(F.col(column))).alias("pdb_id")).where("pdb_id <> ''")
    return rows.groupBy("pdb_id").agg(F.min("ord").alias("ord"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, key, payload, ts, status) of a cache of JSON lines; a missing cache is an empty one, and so is a line that can't be read."""
    schema = "namespace string, key string, payload string, ts long, status string"
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("key is not null")
    except AnalysisException as error:  # the path doesn't exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, payload) of files that each hold one JSON object; a missing or broken file holds nothing."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "key string, payload string")
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "payload"))


def companion(path, ending: str, other: str):
    """The path of a file that goes with another: X_summary.csv to X_all_filtered.sdf."""
    return F.regexp_replace(path, ending.replace(".", r"\.") + "$", other)


def structure_file(codes: DataFrame, files: DataFrame, code: str = "pdb_code", path: str = "path") -> DataFrame:
    """(code, path, n_matches): the file CODE_DU.pdb of each code, the exact name before other spellings; null unless it is the only one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    own = files.select(F.col(path), name.alias("__name"), F.upper(F.regexp_extract(name, r"(?i)^(.*)_DU\.pdb$", 1)).alias("__code")).where("__code <> ''")
    wanted = codes.select(code).distinct().withColumn("__code", F.upper(F.trim(code)))
    hit = wanted.join(own, "__code", "left").withColumn("__exact", F.col("__name") == F.concat("__code", F.lit("_DU.pdb")))
    n, exact = F.count(path), F.max(F.when(F.col("__exact"), F.col(path)))
    return hit.groupBy(code).agg(F.coalesce(exact, F.when(n == 1, F.max(path))).alias(path), n.alias("n_matches"))


def newest_files(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths in order, each once."""
    return df.select(path).distinct().orderBy(path)
