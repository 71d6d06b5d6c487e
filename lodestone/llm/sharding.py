"""Sharding by proportional stratified interleaving.

Rows of each stratum (source) are put in a seeded random order and get the
fractional rank ``(rank - 1 + start) / rows of the stratum``, where ``start`` is a
fixed number in [0, 1) drawn for the stratum.  Sorting all rows by it spreads
every stratum evenly over the whole order, so that cutting the order into equal
runs gives shards that all match the mixture.

No window ever covers a whole stratum: ranks come from hash buckets.  A bucket
is a slice of the random order; counts of buckets (partial aggregates) are
summed up to offsets, and rows are ranked only within their bucket.  A source
with a third of all rows therefore has a third of all buckets, not one large task.
Equal rows are counted first and numbered, and the number is part of what is
hashed, so that a third of all rows being equal is spread as well.

Random numbers are the first 60 bits of MD5 digests, which SQL can compute too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Copies of a row that one task writes out.
COPIES = 1 << 16
RESULTS = ("stratum_rank", "position", "shard", "slot")


def draw(*parts: Column) -> Column:
    """60 bits of the MD5 digest of the parts as text, joined by NUL; a null part is one more NUL."""
    text = F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """60 bits as a number in [0, 1), in their order."""
    return key.cast("double") / F.lit(2.0**60)


def bucket_of(share: Column, buckets: int) -> Column:
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(share * buckets).cast("int")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with __copy, from 1 among equal rows; which of them has which number shows nowhere."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    counted = stored(rows.groupBy(*names).agg(F.count("*").alias("__copies")), "shard-counted")
    each = lambda lo, hi: F.explode(F.sequence(lo, hi)).alias("__copy")
    few = counted.where(F.col("__copies") <= COPIES).select(*names, each(F.lit(1).cast("long"), F.col("__copies")))
    if not counted.where(F.col("__copies") > COPIES).limit(1).count():
        return few
    many = counted.where(F.col("__copies") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / COPIES))).alias("__run"))
    first = F.col("__run") * COPIES
    many = many.repartition(*names, "__run").select(*names, each(first + 1, F.least(first + COPIES, F.col("__copies"))))
    return few.unionByName(many)


def interleave(rows: DataFrame, stratum: str, seed: int = 17, bucket_rows: int = 1024) -> DataFrame:
    """Add ``stratum_rank`` (from 1) and ``position`` (from 0, gapless, the interleaved order).

    ``rows`` must be narrow: all its columns travel; they must have an order (no maps).
    The seeded order is that of a hash over all columns and the number among equal
    rows, ties by the columns themselves; equal rows can swap places, which no result
    shows.  A null stratum is a stratum of its own, other nulls are values like others.
    An empty table gives an empty table.  Input columns named stratum_rank, position,
    shard or slot give way, unless they are the stratum (ValueError).
    """
    if stratum in RESULTS:
        raise ValueError(f"the stratum can't be called {stratum}")
    names = [c for c in rows.columns if c not in RESULTS]
    # by place, so that none of their names meets one of ours
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    out = interleaved(plain, f"c{names.index(stratum)}", seed, bucket_rows)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "stratum_rank", "position")


def interleaved(rows: DataFrame, stratum: str, seed: int, bucket_rows: int) -> DataFrame:
    """:func:`interleave` of columns c0, c1, ..."""
    columns = [F.col(c) for c in rows.columns]
    n = rows.count()
    buckets = max(1, math.ceil(n / max(bucket_rows, math.isqrt(n))))
    keyed = numbered(rows.select(*columns)).select(
        *columns,
        "__copy",
        F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")).alias("__stratum"),
        draw(F.lit(seed), *columns, F.col("__copy")).alias("__hash"),
    ).withColumn("__bucket", bucket_of(uniform(F.col("__hash")), buckets))
    before = Window.partitionBy("__stratum").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__stratum", "__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select(
        "__stratum",
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__stratum")).alias("__rows"),
    )
    within = Window.partitionBy("__stratum", "__bucket").orderBy("__hash", *columns, "__copy")
    start = uniform(draw(F.lit(seed + 1), F.col("__stratum")))
    ranked = (
        keyed.join(offsets, ["__stratum", "__bucket"])
        .withColumn("stratum_rank", F.col("__before") + F.row_number().over(within))
        .withColumn("__share", (F.col("stratum_rank") - 1 + start) / F.col("__rows"))
        .withColumn("__slice", bucket_of(F.col("__share"), buckets))
        .select(*columns, "__stratum", "stratum_rank", "__share", "__slice")
    )
    ranked = stored(ranked, "interleave")
    cuts = ranked.groupBy("__slice").agg(F.count("*").alias("__n"))
    # One row for each slice of the order, at most the square root of the rows: small enough for one window.
    cuts = cuts.select(
        "__slice",
        F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"),
    )
    order = Window.partitionBy("__slice").orderBy("__share", "__stratum", "stratum_rank")
    return (
        ranked.join(cuts, "__slice")
        .withColumn("position", F.col("__first") + F.row_number().over(order) - 1)
        .select(*columns, "stratum_rank", "position")
    )


def shard(rows: DataFrame, stratum: str, shards: int = 16, seed: int = 17) -> DataFrame:
    """Add ``shard`` and ``slot``: the interleaved order cut into runs whose row counts differ by one at most.

    Nulls, equal rows, ties, empty tables and clashing names: as :func:`interleave` has it."""
    rows = stored(rows, "shard-rows")
    n = F.lit(rows.count())
    placed = interleave(rows, stratum, seed)
    names = [c for c in placed.columns if c not in RESULTS]
    cut = F.floor(F.col("position") * shards / n).cast("int")
    # floor(p * s / n) starts shard i at the ceiling of i * n / s
    first = F.floor((cut.cast("long") * n + shards - 1) / F.lit(shards))
    return placed.select(*[F.col(f"`{c}`") for c in names], "stratum_rank", "position", cut.alias("shard"), (F.col("position") - first).alias("slot"))
