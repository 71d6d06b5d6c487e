"""From raw documents to token ids: language, near duplicates, contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept and returns a DataFrame; what it returns is written as Parquet and
read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, neardup, pii, sentencepieces
from lodestone.llm.common import fresh, sized, stored
from lodestone.llm.queries import MODEL, held_out

#: Documents whose language is less certain than this go, as do those without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty ones too) and those of no clear language; repeated rows are judged alike."""
    model = langid.train(docs.where(~held_out()), MODEL)
    lang, score = fresh(docs.columns, "__lang"), fresh(docs.columns, "__score")
    out = langid.identify(docs, model, into=(lang, score))
    # a model without languages (no labelled row) tells nothing: then only letters count
    kept = (F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE) if model["langs"] else F.col("text").rlike(r"\p{L}")
    return out.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest doc_id (null last), of repeated rows the first; documents without words stay."""
    uid = fresh(docs.columns, "__uid")
    keyed = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "near-keyed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(uid).alias("uid"))
    groups = neardup.near_duplicates(keyed.select(row.alias("row"), "text"), id_col="row")
    stay = groups.where(F.col("id") == F.col("class_id")).select(F.col("id.uid").alias(uid))
    return keyed.join(stay, uid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words stands in benchmark windows; those without words stay."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.decontaminate(docs.select(key.alias("key"), "text"), benchmark, ["key"])
    own = fresh(docs.columns, "__key")
    bad = stored(decontam.digest(found, "key").where("contaminated").select(F.col("key").alias(own)).distinct(), "contaminated")
    # judged by text alone, so equal texts go together
    return docs.join(sized(bad), key == F.col(own), "left_anti")


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it; keeps every document, repeated ones too; null texts stay null."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    out = pii.sanitise(own)
    columns = [F.col("sanitised").alias(c) if c == "text" else F.length("sanitised").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and the checks of parity and round trip; null and empty texts have no ids.

    In all stages an empty table gives an empty table, and columns of other names stay as they are."""
    return sentencepieces.encode(docs, MODEL)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("tokenisation", tokenisation),
]

#: SQL can't express the learned language model, so none; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
