"""Centroid clustering with Drake's adaptive bounds: exact Lloyd rounds that seldom measure all distances.

Each vector carries its centroid with an upper bound of that distance, its b next
nearest centroids in order, each with a lower bound, and one lower bound for all
the others.  When centroids move, bounds move with them.  A vector whose upper
bound lies strictly below all lower bounds stays unmeasured; else its upper bound
is made exact; else only the centroids before the first place whose bounds
certify the rest are measured and put in order anew; else all are (a full
rescan).  b follows need: the most places that any vector used in a round, at
least an eighth of the centroids.

Components are integers, squared distances exact; bounds are 32-bit floats rounded
outwards and certify by strict inequality only, so ties always get measured and
go to the smaller number.  Vectors travel in blocks of one dimension; a round
reads the blocks of the round before from the shared folder and writes its own,
with each block's sums, so a lost executor costs its tasks only.  The driver holds
the centroids (k x dim numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Vectors of a block.
ROWS = 4096
#: Vectors whose differences are held at once.
STEP = 1024
#: Components beyond are held at these ends, so that squared distances of up to 64 components stay within 64 bits.
TOP = 2**27
STATE = "ids array<long>, cells binary, width int, dim int, near array<short>, upper array<float>, lower array<float>, used int, scanned long, sums array<struct<cluster:int,n:long,total:array<long>>>"


@dataclass(frozen=True)
class Clusters:
    rows: DataFrame
    centroids: list[list[int]]
    #: (places kept, places used, vectors rescanned) of each round
    rounds: list[tuple[int, int, int]]


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; a vector that is null or holds null, NaN or infinity gives null."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    cells = F.transform(vector, lambda c: F.greatest(F.lit(-TOP), F.least(F.lit(TOP), F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), c.cast("double") * scale))))).cast("long"))
    return F.when(vector.isNotNull() & ~bad, cells)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of rows and centroids, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * max(1, x.shape[1]) * (most + 1) ** 2 < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def ordered(distances: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of each row's candidates by distance, equal ones by centroid number."""
    return np.lexsort((numbers, distances), axis=1)


@dataclass
class Bounds:
    """near[:, 0] is the centroid of a vector, near[:, 1:] the next ones; lower's last column bounds all the others."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def scan(x: np.ndarray, centroids: np.ndarray, places: int) -> Bounds:
    """Exact order of all centroids of some vectors, kept to their first ``places`` + 1."""
    d = squared(x, centroids)
    by = ordered(d, np.broadcast_to(np.arange(len(centroids)), d.shape))
    root = np.sqrt(np.take_along_axis(d, by, axis=1).astype(np.float64))
    rest = root[:, places + 1 : places + 2] if places + 1 < len(centroids) else np.full((len(x), 1), np.inf)
    return Bounds(by[:, : places + 1].astype(np.int16), up(root[:, 0]), down(np.concatenate([root[:, 1 : places + 1], rest], axis=1)))


def moved(x: np.ndarray, old: Bounds, centroids: np.ndarray, steps: np.ndarray, places: int) -> tuple[Bounds, int, int]:
    """Bounds after the centroids moved by ``steps``; the most places that a vector needed; the vectors that were rescanned."""
    near, rest = old.near.astype(np.int64), old.lower[:, -1:].astype(np.float64)
    upper = up(old.upper.astype(np.float64) + steps[near[:, 0]])
    lower = down(np.concatenate([old.lower[:, :-1] - steps[near[:, 1:]], rest - steps.max(initial=0)], axis=1))
    if places < near.shape[1] - 1:  # places given up are bounded by the remainder from now on
        lower = np.concatenate([lower[:, :places], lower[:, places:].min(axis=1, keepdims=True)], axis=1)
        near = near[:, : places + 1]
    least = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]  # of each place and all after it
    open_ = np.flatnonzero(upper >= least[:, 0])
    # certified by an exact upper bound
    exact = ((x[open_] - centroids[near[open_, 0]]) ** 2).sum(axis=1)
    upper[open_] = up(np.sqrt(exact.astype(np.float64)))
    open_ = open_[upper[open_] >= least[open_, 0]]
    certified = upper[open_, None] < least[open_]
    first = np.where(certified.any(axis=1), certified.argmax(axis=1), places + 1)
    for z in np.unique(first).tolist():
        some = open_[first == z]
        for i in range(0, len(some), STEP):
            at = some[i : i + STEP]
            if z > places:
                new = scan(x[at], centroids, places)
                near[at], upper[at], lower[at] = new.near, new.upper, new.lower
                continue
            rivals = near[at, : z + 1]
            d = ((x[at, None, :] - centroids[rivals]) ** 2).sum(axis=2)
            by = ordered(d, rivals)
            root = np.sqrt(np.take_along_axis(d, by, axis=1).astype(np.float64))
            near[at, : z + 1], upper[at], lower[at, :z] = np.take_along_axis(rivals, by, axis=1), up(root[:, 0]), down(root[:, 1:])
    return Bounds(near.astype(np.int16), upper, lower), int(first[first <= places].max(initial=0)), int((first > places).sum())


def narrow(cells: np.ndarray) -> tuple[bytes, int]:
    """Components in as few bytes as hold them."""
    most = int(np.abs(cells).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32
    return cells.astype(kind).tobytes(), np.dtype(kind).itemsize


def packed(ids: pa.Array, x: np.ndarray, b: Bounds, used: int, scanned: int) -> pa.RecordBatch:
    """One block with its sums by centroid."""
    own = b.near[:, 0].astype(np.int64)
    order = np.argsort(own, kind="stable")
    there, first = np.unique(own[order], return_index=True)
    totals = np.add.reduceat(x[order], first, axis=0) if len(there) else x
    counts = np.diff(np.append(first, len(own)))
    sums = [{"cluster": int(c), "n": int(n), "total": t.tolist()} for c, n, t in zip(there, counts, totals, strict=True)]
    cells, width = narrow(x)
    row = {"ids": [ids.to_pylist()], "cells": [cells], "width": [width], "dim": [x.shape[1]], "near": [b.near.ravel()], "upper": [b.upper], "lower": [b.lower.ravel()], "used": [used], "scanned": [scanned], "sums": [sums]}
    return pa.RecordBatch.from_pydict(row, schema=SCHEMA)


SCHEMA = pa.schema(
    [
        ("ids", pa.list_(pa.int64())), ("cells", pa.binary()), ("width", pa.int32()), ("dim", pa.int32()), ("near", pa.list_(pa.int16())), ("upper", pa.list_(pa.float32())),
        ("lower", pa.list_(pa.float32())), ("used", pa.int32()), ("scanned", pa.int64()),
        ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))),
    ]
)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, Bounds]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
            ids = row["ids"].values
            x = np.frombuffer(row["cells"].as_py(), np.int16 if row["width"].as_py() == 2 else np.int32).reshape(len(ids), row["dim"].as_py()).astype(np.int64)
            read = lambda c, n=len(ids): row[c].values.to_numpy(zero_copy_only=False).reshape(n, -1)
            yield ids, x, Bounds(read("near").copy(), read("upper")[:, 0].copy(), read("lower").copy())


def first_round(centroids: np.ndarray, places: int):
    """mapInArrow: rows (id, cells) to blocks with exact bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1) if batch.num_rows else None
            for i in range(0, batch.num_rows, ROWS):
                x = flat[i : i + ROWS]
                parts = [scan(x[j : j + STEP], centroids, places) for j in range(0, len(x), STEP)]
                bounds = Bounds(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("near", "upper", "lower")))
                yield packed(batch.column(0).slice(i, ROWS), x, bounds, places, len(x))

    return run


def next_round(centroids: np.ndarray, steps: np.ndarray, places: int):
    """mapInArrow: blocks to blocks, after the centroids moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, bounds in opened(batches):
            new, used, scanned = moved(x, bounds, centroids, steps, places)
            yield packed(ids, x, new, used, scanned)

    return run


def members(centroids: np.ndarray):
    """mapInArrow: blocks to rows (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, bounds in opened(batches):
            own = bounds.near[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"id": ids, "cluster": own.astype(np.int32), "distance": ((x - centroids[own]) ** 2).sum(axis=1)})

    return run


def totals(state: DataFrame, dim: int) -> tuple[dict[int, tuple[int, list[int]]], int, int]:
    """Of each cluster the count and the components' sums; the places used and the vectors rescanned."""
    parts = state.select(F.explode("sums").alias("s")).select("s.*")
    wide = [F.sum(F.get("total", F.lit(j)).cast("decimal(38,0)")).alias(f"t{j}") for j in range(dim)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*wide).alias("total")).collect()  # k rows
    used, scanned = state.agg(F.max("used"), F.sum("scanned")).first()
    return {r["cluster"]: (r["n"], [int(t) for t in r["total"]]) for r in rows}, used or 0, scanned or 0


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, salt: str = "2") -> Clusters:
    """(id, cluster, distance) of every vector with exactly ``dim`` components, none null or non-finite, after ``rounds`` of Lloyd's rounds and one more assignment.

    Components become floor(scale * x), held within +-2**27.  Centroids 0, 1, ... start
    as the k vectors with the smallest lower-case hex sha256 of ``salt:id``, in that
    order (null ids last; among repeated ids the smaller components first); with fewer
    vectors there are fewer.  A round's new centroid is the floor of the mean; one
    without vectors stays.  Ties go to the smaller number.  Ids may be null or
    repeated, other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector_col}`")
    rows = vectors.where(F.size(x) == dim).select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(x, scale).alias("cells")).where(F.col("cells").isNotNull())
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds = rows.orderBy(draw.asc_nulls_last(), "cells").limit(k).collect()  # k rows
    nothing = spark.createDataFrame([], "id long, cluster int, distance long")
    if not seeds:
        return Clusters(nothing, [], [])
    centroids = np.array([s["cells"] for s in seeds], np.int64).reshape(len(seeds), dim)
    most = len(seeds) - 1
    places, least = min(most, max(1, len(seeds) // 4)), min(most, max(1, len(seeds) // 8))
    log: list[tuple[int, int, int]] = []
    state = stored(rows.mapInArrow(first_round(centroids, places), STATE), "clusters")
    for _ in range(rounds):
        sums, used, scanned = totals(state, dim)
        log.append((places, used, scanned))
        after = centroids.copy()
        for c, (n, total) in sums.items():
            after[c] = [t // n for t in total]
        steps = up(np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(np.float64))).astype(np.float64)
        centroids, places = after, min(places, max(least, used))
        new = stored(state.mapInArrow(next_round(centroids, steps, places), STATE), "clusters")
        dropped(state)
        state = new
    log.append((places, *totals(state, dim)[1:]))
    return Clusters(state.mapInArrow(members(centroids), nothing.schema), centroids.tolist(), log)


def digest(found: Clusters) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and its centroid's sha256."""
    import hashlib

    rows = stored(found.rows, "clustered")
    inertia = {r["cluster"]: int(r["inertia"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    marks = [(c, v, sum(inertia.values()), hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()) for c, v in inertia.items()]
    per = rows.sparkSession.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # broadcast: k rows
