"""Exact top-k search by inner product: distributed histogram selection.

Vectors are packed into blocks.  Every pair of a query block and a candidate
block is scored with one matrix product; a pass adds up, for each query, a
histogram of the scores that fall in its current interval.  The bin holding the
k-th best score becomes the next interval, until the number of candidates at or
above its lower edge is small, or the interval is one single score.  In that
case further passes refine a histogram over the ids of the candidates with
exactly that score, so that ties of any size are cut at the right id.  A last
pass emits only what lies within the final bounds, a few rows a query.

Nothing is broadcast unless Spark's own size check allows it, no state comes to
the driver but the number of unfinished queries, and no pass makes a row for a
pair.  Products are taken in float64 while exact (bound below 2**53), else with
Python integers; scores beyond 64 bits are held at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_groups, stored

BINS = 512
SLICE = 64
I64 = np.iinfo(np.int64)
BLOCK = "block string, dim int, n int, ids binary, cells binary, norm double, top double"
STATE = "block string, slice int, dim int, ids binary, cells binary, norm double, top double, lo binary, hi binary, above binary, idlo binary, idhi binary, mode binary, open int"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, cells): floor(scale * x) of each component; vectors that are null or hold null, NaN or infinity are left out, as are null ids."""
    x = F.col(f"`{vector_col}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    # floor() of a double is a long; beyond its range it would overflow, so the ends are held
    top = F.lit(float(2**62))
    cells = F.transform(x, lambda c: F.floor(F.greatest(-top, F.least(top, c.cast("double") * scale))).cast("long"))
    return vectors.where(x.isNotNull() & ~bad & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), cells.alias("cells"))


def packer(size: int):
    """mapInArrow: rows (id, cells) to blocks of up to ``size`` rows of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def flush(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            n = count.pop(dim)
            ids, cells = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            wide = cells.astype(np.float64)
            norm = float(np.sqrt((wide * wide).sum(axis=1)).max()) if dim else 0.0
            top = float(np.abs(wide).max()) if dim else 0.0
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int32()), "ids": [ids.tobytes()], "cells": [cells.tobytes()], "norm": [norm], "top": [top]})

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cells = batch.column(1)
            sizes = np.diff(cells.offsets.to_numpy())
            flat = cells.values.to_numpy(zero_copy_only=False)
            starts = cells.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for i in range(0, len(rows), size):
                    some = rows[i : i + size]
                    matrix = flat[(starts[some][:, None] + np.arange(dim)[None, :])] if dim else np.zeros((len(some), 0), np.int64)
                    held.setdefault(dim, []).append((ids[some], matrix))
                    count[dim] = count.get(dim, 0) + len(some)
                    if count[dim] >= size:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return pack


def scores_of(q: np.ndarray, c: np.ndarray, q_top: float, c_top: float) -> np.ndarray:
    dim = q.shape[1]
    if dim * q_top * c_top < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T if dim else np.zeros((len(q), len(c)), object)
    return np.clip(exact, int(I64.min), int(I64.max)).astype(np.int64)


def read_state(row: dict) -> dict[str, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    out = {k: np.frombuffer(row[k], np.int64).copy() for k in ("lo", "hi", "above", "idlo", "idhi", "mode")}
    return out | {"ids": ids, "cells": np.frombuffer(row["cells"], np.int64).reshape(len(ids), row["dim"])}


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Of joined blocks with equal dimension: the row, the query state, the candidates' ids and the scores."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["dim"] != row["c_dim"]:
                continue
            state = read_state(row)
            ids = np.frombuffer(row["c_ids"], np.int64)
            cells = np.frombuffer(row["c_cells"], np.int64).reshape(len(ids), row["c_dim"])
            yield row, state, ids, scores_of(state["cells"], cells, row["top"], row["c_top"])


def span_width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Width of each of BINS bins over lo..hi, at least 1, without overflow."""
    span = hi.astype(np.uint64) - lo.astype(np.uint64)
    return np.maximum(np.uint64(1), span // np.uint64(BINS) + np.uint64(1))


def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each query slice that a task meets: counts of its bins."""
    held: dict[tuple[str, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_pydict({"block": [k[0] for k in held], "slice": pa.array([k[1] for k in held], pa.int32()), "bins": [v.tobytes() for v in held.values()]})
            held.clear()

    for row, s, ids, scores in pairs(batches):
        n = len(s["ids"])
        mine = ids[None, :] != s["ids"][:, None]
        by_id = (s["mode"] == 1)[:, None]
        inside = mine & (scores >= s["lo"][:, None]) & (scores <= s["hi"][:, None]) & (s["mode"] < 2)[:, None]
        inside &= ~by_id | ((ids[None, :] >= s["idlo"][:, None]) & (ids[None, :] <= s["idhi"][:, None]))
        r, c = np.nonzero(inside)
        as_id = s["mode"][r] == 1
        value = np.where(as_id, ids[c], scores[r, c]).astype(np.uint64)
        low = np.where(s["mode"] == 1, s["idlo"], s["lo"])
        high = np.where(s["mode"] == 1, s["idhi"], s["hi"])
        width = span_width(low, high)
        place = ((value - low.astype(np.uint64)[r]) // width[r]).astype(np.int64)
        bins = np.bincount(r * BINS + place, minlength=n * BINS).astype(np.int64)
        key = (row["block"], row["slice"])
        held[key] = held[key] + bins if key in held else bins
        if len(held) >= 64:
            yield from out()
    yield from out()


def refiner(k: int, slack: int):
    """mapInArrow over (state, histograms) sorted by query slice: the next state."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, ["block", "slice"]):
            row, bins = None, None
            for x in table.to_pylist():
                if x["bins"] is None:
                    row = x
                else:
                    add = np.frombuffer(x["bins"], np.int64)
                    bins = add if bins is None else bins + add
            s = read_state(row)
            n = len(s["ids"])
            bins = np.zeros(n * BINS, np.int64) if bins is None else bins
            for i, counts in enumerate(bins.reshape(n, BINS)):
                if s["mode"][i] == 2:
                    continue
                if s["mode"][i] == 0:
                    down = np.cumsum(counts[::-1])  # from the highest score
                    need = k - s["above"][i]
                    if down[-1] < need:  # fewer than k candidates: all of them
                        s["mode"][i] = 2
                        continue
                    at = BINS - 1 - int(np.searchsorted(down, need))
                    through = int(down[BINS - 1 - at])
                    width = int(span_width(s["lo"][i : i + 1], s["hi"][i : i + 1])[0])
                    low = int(s["lo"][i]) + at * width
                    high = min(int(s["hi"][i]), low + width - 1)
                    total = int(s["above"][i]) + through
                    s["above"][i] += through - int(counts[at])
                    s["lo"][i], s["hi"][i] = low, high
                    if total <= k + slack:
                        s["mode"][i] = 2
                    elif width == 1:
                        s["mode"][i] = 1
                else:
                    up = np.cumsum(counts)  # from the smallest id
                    need = k - s["above"][i]
                    at = int(np.searchsorted(up, need))
                    width = int(span_width(s["idlo"][i : i + 1], s["idhi"][i : i + 1])[0])
                    low = int(s["idlo"][i]) + at * width
                    high = min(int(s["idhi"][i]), low + width - 1)
                    taken = int(up[at])
                    if taken - need <= slack or width == 1:
                        s["mode"][i], s["idhi"][i] = 2, high
                    else:
                        s["above"][i] += taken - int(counts[at])
                        s["idlo"][i], s["idhi"][i] = low, high
            out = {c: [row[c]] for c in ("block", "slice", "dim", "ids", "cells", "norm", "top")}
            out |= {c: [s[c].tobytes()] for c in ("lo", "hi", "above", "idlo", "idhi", "mode")} | {"open": [int((s["mode"] < 2).sum())]}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(out[c], pa.int32()) for c in ("slice", "dim", "open")})

    return refine


def starter(top_norm: float, id_low: int, id_high: int):
    """mapInArrow: query blocks to slices with their first interval, the Cauchy-Schwarz bound."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                cells = np.frombuffer(row["cells"], np.int64).reshape(len(ids), row["dim"])
                for i in range(0, len(ids), SLICE):
                    some, own = cells[i : i + SLICE], ids[i : i + SLICE]
                    wide = some.astype(np.float64)
                    bound = np.minimum(np.sqrt((wide * wide).sum(axis=1)) * top_norm * (1 + 1e-9) + 2, 2.0**62)
                    hi = np.ceil(bound).astype(np.int64)
                    hi[bound >= 2.0**62] = I64.max
                    n = len(own)
                    full = lambda v, n=n: np.full(n, v, np.int64).tobytes()
                    lo = np.where(hi == I64.max, I64.min, -hi).astype(np.int64)
                    out = {"block": [row["block"]], "slice": pa.array([i // SLICE], pa.int32()), "dim": pa.array([row["dim"]], pa.int32()), "ids": [own.tobytes()], "cells": [some.tobytes()], "norm": [row["norm"]], "top": [row["top"]]}
                    out |= {"lo": [lo.tobytes()], "hi": [hi.tobytes()], "above": [full(0)], "idlo": [full(id_low)], "idhi": [full(id_high)], "mode": [full(0)], "open": pa.array([n], pa.int32())}
                    yield pa.RecordBatch.from_pydict(out)

    return start


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates within each query's final bounds."""
    for row, s, ids, scores in pairs(batches):
        inside = (ids[None, :] != s["ids"][:, None]) & (scores >= s["lo"][:, None])
        inside &= (scores > s["hi"][:, None]) | (s["lo"] < s["hi"])[:, None] | (ids[None, :] <= s["idhi"][:, None])
        r, c = np.nonzero(inside)
        if len(r):
            where = r + row["slice"] * SLICE
            yield pa.RecordBatch.from_pydict({"block": [row["block"]] * len(r), "place": where.astype(np.int64), "query_id": s["ids"][r], "vec_id": ids[c], "score": scores[r, c]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = 4096, slack: int = 64) -> DataFrame:
    """The ``k`` best candidates of each query row: query_id, rank (from 1), vec_id, score.

    ``queries`` has the columns of ``vectors``.  A query's own row is what shares its
    id.  Ties go to the smaller id; repeated rows with equal id and score share
    ranks next to each other.  Queries with fewer than k candidates get them all;
    vectors of unequal dimension have no score.  Empty input gives no rows.
    """
    columns = quantised(vectors, id_col, vector_col, scale)
    base = stored(columns.mapInArrow(packer(block_rows), BLOCK), "topk-candidates")
    asked = quantised(queries, id_col, vector_col, scale)
    # so that query blocks are full: a query set is a small share of the rows
    parts = max(1, -(-asked.count() // block_rows))
    asked = asked.repartition(parts).mapInArrow(packer(block_rows), BLOCK)
    bounds = columns.agg(F.min("id"), F.max("id")).first()
    top_norm = base.agg(F.max("norm")).first()[0]
    state = stored(asked.mapInArrow(starter(top_norm or 0.0, bounds[0] or 0, bounds[1] or 0), STATE), "topk-state")
    right = base.select(F.col("dim").alias("c_dim"), F.col("ids").alias("c_ids"), F.col("cells").alias("c_cells"), F.col("top").alias("c_top"))
    keys = ["block", "slice"]
    for _ in range(32):  # 64 bits of score and of id in steps of 9
        if not state.where("open > 0").limit(1).count():
            break
        found = right.crossJoin(state.where("open > 0")).mapInArrow(histograms, "block string, slice int, bins binary")
        both = state.withColumn("bins", F.lit(None).cast("binary")).unionByName(found, allowMissingColumns=True)
        both = both.repartition(*keys).sortWithinPartitions(*keys)
        state = stored(both.mapInArrow(refiner(k, slack), STATE), "topk-state")
    hits = right.crossJoin(state).mapInArrow(chosen, "block string, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
