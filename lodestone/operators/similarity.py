"""Similarity of bit fingerprints and sphere-exclusion clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import kept


def bits(words: Column) -> Column:
    """Set bits of an array of 64-bit words."""
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def tanimoto(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Common bits over bits of either; 0 for two empty fingerprints."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, w: s + w)
    return F.coalesce(common / F.nullif(na + nb - common, F.lit(0)), F.lit(0.0))


def similarity_join(df: DataFrame, key: str, words: str, cutoff: float) -> DataFrame:
    """Pairs (a < b) with similarity >= cutoff: (a, b, sim).

    Sparse fingerprints (an eighth of the bits set, or fewer, on average) are joined on rare
    bits, dense ones compared in pairs of blocks (those of uneven length on the numbers of bits that can match); all are exact."""
    rows = df.select(F.col(key).alias("k"), F.col(words).alias("w"), bits(F.col(words)).alias("n")).where("n > 0")
    share = rows.agg(F.avg("n").alias("n"), F.max(F.size("w")).alias("words"), F.min(F.size("w")).alias("least")).first()
    if share.n is not None and share.n * 8 <= share.words * 64:
        return rare_bit_join(rows, cutoff)
    if share.n is not None and share.words == share.least <= 64:
        return block_pairs(rows, cutoff, share.words)
    return count_join(rows, cutoff)


#: Rows of a block of :func:`block_pairs`, fewer than Spark's buffer of a merge join holds.
BLOCK = 2048


def block_pairs(rows: DataFrame, cutoff: float, words: int) -> DataFrame:
    """All pairs, compared in pairs of blocks: for dense fingerprints, of which hardly a pair can be ruled out unseen.

    Words stand in columns of their own, so that a comparison is a few machine operations; a task holds
    a pair of blocks, and each pair of rows is met once."""
    n = max(1, math.ceil(rows.count() / BLOCK))
    block = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    side = lambda s: [F.col("k").alias(f"k{s}"), F.col("n").alias(f"n{s}"), *[F.get("w", i).alias(f"w{s}{i}") for i in range(words)]]
    left = rows.select(*side(0), block.alias("__i")).withColumn("__j", F.explode(F.sequence(F.col("__i"), F.lit(n - 1))))
    right = rows.select(*side(1), block.alias("__j")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__j"))))
    tasks = min(n * (n + 1) // 2, 10_000)
    common = sum(F.bit_count(F.col(f"w0{i}").bitwiseAND(F.col(f"w1{i}"))) for i in range(words))
    sim = common / F.nullif(F.col("n0") + F.col("n1") - common, F.lit(0))
    met = left.repartition(tasks, "__i", "__j").join(right.repartition(tasks, "__i", "__j"), ["__i", "__j"])
    met = met.where(((F.col("__i") < F.col("__j")) | (F.col("k0") < F.col("k1"))) & (sim >= cutoff))
    return met.select(F.least("k0", "k1").alias("a"), F.greatest("k0", "k1").alias("b"), sim.alias("sim"))


def count_join(rows: DataFrame, cutoff: float) -> DataFrame:
    """A pair that similar has bit counts in the ratio cutoff or nearer, so a row is sent to
    the counts it can match and an equi-join on counts finds the rest."""
    right = rows.select(F.col("k").alias("b"), F.col("w").alias("wb"), F.col("n").alias("nb"))
    lo = F.ceil(F.col("n") * F.lit(cutoff) - 1e-9).cast("int")
    hi = F.floor(F.col("n") / F.lit(cutoff) + 1e-9).cast("int")
    left = rows.select(F.col("k").alias("a"), F.col("w").alias("wa"), F.col("n").alias("na"), F.explode(F.sequence(F.greatest(lo, F.lit(1)), hi)).alias("nb"))
    sim = tanimoto(F.col("wa"), F.col("wb"), F.col("na"), F.col("nb"))
    return left.join(right, "nb").where("a < b").select("a", "b", sim.alias("sim")).where(F.col("sim") >= cutoff)


def rare_bit_join(rows: DataFrame, cutoff: float) -> DataFrame:
    """A pair that similar shares one of the n - ceil(cutoff * n) + 1 rarest bits of either row,
    so rows meet on those bits only; a pair is compared at the rarest bit that both have there.

    Common bits, which would gather many rows, are rarely among a row's rarest."""
    place = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) * 64 - 1), lambda i: F.get(w, F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) != 0)
    rows = rows.withColumn("bits", place(F.col("w")))
    counts = rows.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("c")).collect()  # one row for each bit of a fingerprint
    order = {r.bit: i for i, r in enumerate(sorted(counts, key=lambda r: (r.c, r.bit)))}
    if not order:
        return count_join(rows.drop("bits"), cutoff)
    rank = F.lit([order.get(i, 0) for i in range(max(order) + 1)])
    ranked = F.array_sort(F.transform("bits", lambda b: F.get(rank, b)))
    rows = rows.withColumn("own", F.slice(ranked, F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(cutoff) - 1e-9) + 1).cast("int"))).drop("bits")
    side = lambda s: rows.select(F.col("k").alias(s), F.col("w").alias(f"w{s}"), F.col("n").alias(f"n{s}"), F.col("own").alias(f"own{s}"), F.explode("own").alias("bit"))
    pairs = side("a").join(side("b"), "bit").where((F.col("a") < F.col("b")) & (F.col("bit") == F.array_min(F.array_intersect("owna", "ownb"))))
    pairs = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(cutoff) - 1e-9)
    sim = tanimoto(F.col("wa"), F.col("wb"), F.col("na"), F.col("nb"))
    return pairs.select("a", "b", sim.alias("sim")).where(F.col("sim") >= cutoff)


def sphere_exclusion(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, centroid): largest neighbourhood first, ties by key.

    A row becomes a centroid once no open neighbour has a higher priority; its open
    neighbours then can't become one.  All such rows of a round are settled at once, which
    gives the centroids of the sequential search; at the end every other row goes to its
    neighbouring centroid of highest priority, the one that search would meet first."""
    pairs = kept(pairs.select("a", "b"))  # read many times
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("deg"))
    nodes = df.select(F.col(key).alias("a")).join(degree, "a", "left").select("a", F.struct((-F.coalesce("deg", F.lit(0))).alias("d"), F.col("a").alias("k")).alias("p"))
    edges = kept(both.join(nodes, "a").withColumnRenamed("p", "pa").join(nodes.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b"))
    open_, live, found = nodes, edges, None
    while True:  # each round settles the open row of highest priority at least
        best = live.groupBy("a").agg(F.min("pb").alias("best"))
        first = F.col("best").isNull() | (F.col("p") < F.col("best"))
        marked = kept(open_.join(best, "a", "left").select("a", "p", first.alias("centre")))
        centres = marked.where("centre").select("a", "p")
        found = centres if found is None else found.unionByName(centres)
        beside = live.join(centres.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        open_ = kept(marked.where("not centre").select("a", "p").join(beside, "a", "left_anti"))
        if open_.isEmpty():
            break
        live = kept(live.join(open_.select("a"), "a", "left_semi").join(open_.select(F.col("a").alias("b")), "b", "left_semi"))
    members = edges.join(found.select(F.col("a").alias("b")), "b", "left_semi").join(found.select("a"), "a", "left_anti")
    members = members.groupBy("a").agg(F.min_by("b", "pb").alias("centroid"))
    return found.select("a", F.col("a").alias("centroid")).unionByName(members).select(F.col("a").alias(key), "centroid")


#: Rows of a block whose neighbours are counted, and open rows of highest priority among which a round looks for centroids.
COUNTED, FIRST = 8192, 8192


def words_of(column: pa.ChunkedArray, words: int) -> np.ndarray:
    """A column of arrays of ``words`` 64-bit words as a matrix."""
    return pc.list_flatten(column).to_numpy().view(np.uint64).reshape(-1, words)


def least_common(words: int, cutoff: float) -> np.ndarray:
    """By the bits of both together: how many in common make a pair that similar (more than there are, where none does)."""
    both = np.arange(128 * words + 1)[:, None]
    common = np.arange(64 * words + 1)[None, :]
    either = np.maximum(both - common, 1)
    hit = (common / either >= cutoff) & (2 * common <= both)
    return np.where(hit.any(1), hit.argmax(1), 64 * words + 1).astype(np.int32)


def alike(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are similar to which of ``b``."""
    common = np.bitwise_count(a[:, None, 0] & b[None, :, 0]).astype(np.int16)
    for i in range(1, a.shape[1]):
        common += np.bitwise_count(a[:, None, i] & b[None, :, i])
    na, nb = (np.bitwise_count(x).sum(1, dtype=np.int32) for x in (a, b))
    return common >= least.astype(np.int16)[na[:, None] + nb[None, :]]


def strips(n: int, other: int) -> Iterator[slice]:
    """Rows to compare at once, so that about 256,000 pairs are held."""
    size = max(1, 262_144 // max(1, other))
    return (slice(i, i + size) for i in range(0, n, size))


def neighbour_counts(rows: DataFrame, words: int, cutoff: float) -> DataFrame:
    """(k, deg): how many other rows are that similar, for those with any; counted in pairs of blocks, no pair is written."""
    n = max(1, math.ceil(rows.count() / COUNTED))
    block = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    base = rows.select("k", "w", block.alias("own"))
    pairs = lambda lo, hi: F.explode(F.sequence(lo, hi))
    left = base.select("k", "w", F.col("own").alias("i"), pairs(F.col("own"), F.lit(n - 1)).alias("j"))
    right = base.select("k", "w", pairs(F.lit(0), F.col("own")).alias("i"), F.col("own").alias("j"))
    tasks = min(n * (n + 1) // 2, 10_000)
    least = least_common(words, cutoff)

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = words_of(a["w"], words), words_of(b["w"], words)
        own, other = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for s in strips(len(x), len(y)):
            hit = alike(x[s], y, least)
            own[s] += np.count_nonzero(hit, axis=1)
            other += np.count_nonzero(hit, axis=0)
        if len(a) and len(b) and a["i"][0].as_py() == a["j"][0].as_py():
            return pa.table({"k": a["k"], "deg": own - 1})  # a block with itself: each row met itself once
        return pa.table({"k": pa.chunked_array(a["k"].chunks + b["k"].chunks, a["k"].type), "deg": np.concatenate([own, other])})

    deal = lambda df: df.repartition(tasks, "i", "j").groupBy("i", "j")
    counted = deal(left).cogroup(deal(right)).applyInArrow(count, T.StructType([base.schema["k"], T.StructField("deg", T.LongType())]))
    return counted.groupBy("k").agg(F.sum("deg").alias("deg")).where("deg > 0")


def exclusion_spheres(df: DataFrame, key: str, words: str, cutoff: float) -> DataFrame:
    """:func:`sphere_exclusion` of all pairs with similarity >= cutoff, which for dense fingerprints are counted and never written.

    A round takes the FIRST open rows of highest priority, finds the centroids among them one after the other, and settles every
    open row that is similar to one.  Centroids of a later round come later in the search, so a row's first centroid stays its own."""
    rows = df.select(F.col(key).alias("k"), F.col(words).alias("w"), bits(F.col(words)).alias("n"))
    share = rows.where("n > 0").agg(F.avg("n").alias("n"), F.max(F.size("w")).alias("words"), F.min(F.size("w")).alias("least")).first()
    if share.n is None or share.n * 8 <= share.words * 64 or share.words != share.least or share.words > 64:
        return sphere_exclusion(df, key, similarity_join(df, key, words, cutoff))
    some = kept(rows.where("n > 0").select("k", "w"))
    size, least = share.words, least_common(share.words, cutoff)
    open_ = kept(some.join(neighbour_counts(some, size, cutoff), "k", "left").select("k", "w", F.coalesce("deg", F.lit(0)).alias("deg")))
    alone = rows.where("n is null or n = 0").select("k", F.col("k").alias("centroid"))
    done = [alone, open_.where("deg = 0").select("k", F.col("k").alias("centroid"))]
    open_ = open_.where("deg > 0")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The centroids among rows in the order of the search, with their places."""
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        w = words_of(table["w"], size)
        free, found = np.ones(len(w), bool), []
        for i in range(len(w)):
            if free[i]:
                found.append(i)
                free[i:] &= ~alike(w[i : i + 1], w[i:], least)[0]
        yield from table.take(found).select(["k", "w"]).append_column("at", pa.array(found, pa.int64())).to_batches()

    def settle(a: pa.Table, b: pa.Table) -> pa.Table:
        """Open rows with their first centroid, or null."""
        b = b.sort_by("at")
        x, y = words_of(a["w"], size), words_of(b["w"], size)
        first = np.full(len(x), -1)
        for s in strips(len(x), len(y)) if len(y) else ():
            hit = alike(x[s], y, least)
            first[s] = np.where(hit.any(1), hit.argmax(1), -1)
        return a.select(["k", "w", "deg"]).append_column("centroid", b["k"].take(pa.array(first, mask=first < 0)))

    k = rows.schema["k"]
    while not open_.isEmpty():
        top = open_.orderBy(F.desc("deg"), "k").limit(FIRST).coalesce(1).sortWithinPartitions(F.desc("deg"), "k")
        centres = kept(top.mapInArrow(search, T.StructType([k, rows.schema["w"], T.StructField("at", T.LongType())])))
        n = max(1, math.ceil(open_.count() / COUNTED))
        dealt = open_.withColumn("i", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).repartition(n, "i").groupBy("i")
        every = centres.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "i").groupBy("i")
        schema = T.StructType([k, rows.schema["w"], T.StructField("deg", T.LongType()), T.StructField("centroid", k.dataType)])
        now = kept(dealt.cogroup(every).applyInArrow(settle, schema))
        done.append(now.where("centroid is not null").select("k", "centroid"))
        open_ = now.where("centroid is null").select("k", "w", "deg")
    return reduce(DataFrame.unionByName, done).select(F.col("k").alias(key), "centroid")


def sign_words(vector: Column, dims: int = 64) -> Column:
    """The signs of a vector as one array of 64-bit words."""
    def word(i: int) -> Column:
        some = F.slice(vector, 64 * i + 1, 64)
        ones = F.transform(some, lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(ones, F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(w))

    return F.array(*[word(i) for i in range(math.ceil(dims / 64))])


def cluster_count(settled: DataFrame) -> DataFrame:
    """One row: how many clusters there are (0 of none)."""
    return settled.agg(F.count_distinct("centroid").alias("clusters"))


def cluster_representatives(rows: DataFrame, cluster: str, hit: str, composite: str, ord_col: str) -> DataFrame:
    """With ``is_centroid``: 1 for a cluster's best row, a hit before others, then the larger composite, then the first; else 0."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(hit), F.desc_nulls_last(composite), ord_col))
    return rows.withColumn("is_centroid", (place == 1).cast("int"))
