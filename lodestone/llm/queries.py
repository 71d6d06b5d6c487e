"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, clusters, decontam, langid, neardup, pii, secrets, sentencepieces, sharding, tokencount, topk, toxicity, wrappers

#: The public tokenizer that operators 1, 2 and 8 use; a parameter of each.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: The byte-level tokenizer that operator 12 aligns with it.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(docs, MODEL, keep=["doc_id"]).select("doc_id", "n_tokens", "ids", "parity", "round_trip")


def held_out(id_col: str = "doc_id"):
    """Rows that languages are not learned from: crc32 of the id as text is 2 modulo 4 (a null id: learned from by neither, held out by neither)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()), MODEL)
    out = langid.identify(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages).select("page_id", "url", "text", "n_chars")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = neardup.near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", "n_set_links")


def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.sanitise(docs))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op5_sanitise by themselves, which SQL can express."""
    docs = table(spark, sf_dir, "documents").select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    return pii.digest(docs).drop("spans")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.shard(rows, "source", 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "stratum_rank")


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, MODEL, keep=["doc_id"]).select("doc_id", "n_tokens")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op10_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs))


def op11_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digest(clusters.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5, dim=64))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_LEVEL, MODEL, keep=["doc_id"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~held_out()))
    out = toxicity.score(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", "terms")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_langid": op2_langid,
    "op3_wrappers": op3_wrappers,
    "op4_neardup": op4_neardup,
    "op5_sanitise": op5_sanitise,
    "pii_base_spans": pii_base_spans,
    "op6_decontaminate": op6_decontaminate,
    "op7_interleave": op7_interleave,
    "op8_tokencount": op8_tokencount,
    "op9_topk": op9_topk,
    "op10_ledger": op10_ledger,
    "op11_drake": op11_drake,
    "op12_align": op12_align,
    "op13_toxicity": op13_toxicity,
}
