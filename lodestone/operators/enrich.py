"""Lookups with caches, activity aggregation, id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(cache: DataFrame, key: str, values: list[str], order: list[Column] | None = None) -> DataFrame:
    """(key, values...): the first row of each key in the given order, by default that of the values."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order or [F.col(v) for v in values])])
    first = cache.groupBy(key).agg(F.min_by(F.struct(*values), place).alias("__first"))
    return first.select(key, *[F.col("__first").getField(v).alias(v) for v in values])


def lookup(df: DataFrame, cache: DataFrame, key: str, values: list[str], order: list[Column] | None = None) -> DataFrame:
    """A left join to the first row of each key of a dimension: a row of ``df`` stays one row."""
    return df.join(first_of(cache, key, values, order), key, "left")


def to_fetch(df: DataFrame, cache: DataFrame, key: str, retry: str | None = "error") -> DataFrame:
    """Keys of ``df`` that the cache doesn't hold; kept misses aren't asked for again, failed ones are."""
    known = cache.where(F.col("status") != retry) if retry and "status" in cache.columns else cache
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def rescored(rows: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Rows without a score get the one that ``scores`` (key, score, error) holds for their key; scored rows stay as they are.

    A failed score stays null, with its ``error``."""
    fresh = first_of(scores, key, [score, "error"]).select(key, F.col(score).alias("__score"), F.col("error").alias("__error"))
    out = rows.join(fresh, key, "left")
    own = F.col(score).isNotNull()
    return out.withColumn("error", F.when(~own & F.col("__score").isNull(), F.col("__error"))).withColumn(score, F.coalesce(score, "__score")).drop("__score", "__error")


def merged_cache(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cache with fresh rows in the place of old ones."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def targets(df: DataFrame, key: str, accessions: DataFrame, links: DataFrame) -> DataFrame:
    """(key, targets): the sorted union of all targets of all accessions of a key."""
    hit = df.select(key).distinct().join(accessions, key).join(links, "accession")
    return hit.groupBy(key).agg(F.sort_array(F.collect_set("target")).alias("targets"))


def best_activity(facts: DataFrame, by: str, target: str, value: str) -> DataFrame:
    """(by, max_value, n, best_target): of equal values the smallest target."""
    return facts.where(F.col(value).isNotNull()).groupBy(by).agg(F.max(value).alias("max_value"), F.count("*").alias("n"), F.min_by(target, F.struct((-F.col(value)).alias("v"), F.col(target).alias("t"))).alias("best_target"))


def is_hit(flag: Column, cid: Column) -> Column:
    """A yes among the known spellings, or any id."""
    return F.coalesce(flag.cast("string").isin("1", "True", "true", "YES", "yes"), F.lit(False)) | (F.trim(F.coalesce(cid.cast("string"), F.lit(""))) != "")


def confident(a: Column, b: Column) -> Column:
    """Whether the first of two confidence values that is given is 9."""
    return F.coalesce(F.coalesce(a, b).cast("string").try_cast("int") == 9, F.lit(False))


def set_difference(present: Column, taken: Column) -> Column:
    return F.array_except(present, taken)


def set_intersection(requested: Column, present: Column) -> Column:
    """Requested ids that are present, in the order of the request."""
    return F.array_intersect(requested, present)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
