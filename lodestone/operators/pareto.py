"""Skylines: first fronts by window and by dominance, full peeling into fronts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import kept

from .selection import ranks

#: Rows that local fronts may leave for one task to merge; more are compared by a join.
MERGED = 100_000


def front1_2d(df: DataFrame, by: list[str], high: str, low: str) -> DataFrame:
    """Rows that no row of their group dominates (``high`` larger is better, ``low`` smaller is better, null is +inf).

    Aggregated to one row for each value of ``high`` first, so the window is over distinct values, not rows."""
    v = F.coalesce(F.col(low).cast("double"), F.lit(float("inf")))
    rows = df.withColumn("__v", v)
    best = rows.groupBy(*by, high).agg(F.min("__v").alias("__m"))
    above = F.min("__m").over(Window.partitionBy(*by).orderBy(F.desc(high)).rowsBetween(Window.unboundedPreceding, -1))
    steps = best.withColumn("__above", above).where(F.col("__above").isNull() | (F.col("__m") < F.col("__above"))).select(*by, high, F.col("__m").alias("__v"))
    return rows.join(steps, [*by, high, "__v"], "left_semi").drop("__v").select(*df.columns)


def dominates(a: str, b: str, high: list[str], low: list[str]) -> Column:
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    weak = [x(c) >= y(c) for c in high] + [x(c) <= y(c) for c in low]
    strict = [x(c) > y(c) for c in high] + [x(c) < y(c) for c in low]
    out, some = weak[0], strict[0]
    for w in weak[1:]:
        out = out & w
    for s in strict[1:]:
        some = some | s
    return out & some


def local_front(high: list[str], low: list[str]):
    """mapInPandas: the front of each task's rows, folded batch by batch; the front of a whole is the front of such parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for frame in frames:
            both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            m = np.column_stack([*[-both[c].to_numpy(float) for c in high], *[both[c].to_numpy(float) for c in low]])
            order = np.lexsort(m.T[::-1])
            front: list[int] = []
            for i in order:  # in this order a row can only be dominated by earlier ones
                f = m[front]
                if not len(front) or not ((f <= m[i]).all(axis=1) & (f < m[i]).any(axis=1)).any():
                    front.append(i)
            kept = both.iloc[np.sort(front)]
        if kept is not None:
            yield kept

    return run


def front1(df: DataFrame, high: list[str], low: list[str], merged: int = MERGED) -> DataFrame:
    """The first front over any number of measures (nulls must be gone): local fronts first, computed once, then the front of what they leave.

    Up to ``merged`` rows are folded by one task, more in blocks (see :func:`blockwise`)."""
    part = kept(df.mapInPandas(local_front(high, low), df.schema))
    if part.count() <= merged:
        return part.coalesce(1).mapInPandas(local_front(high, low), df.schema)
    return blockwise(part, high, low, max(1, merged // 32))


def blockwise(df: DataFrame, high: list[str], low: list[str], size: int) -> DataFrame:
    """The front of rows in blocks of up to ``size``: sorted by the first measure, so that blocks are narrow in it, and compared only where a block's best corner dominates another's worst.

    A row meets each such block once, as a message of at most ``size`` points; it stays if none of them dominates it."""
    measures = [*high, *low]
    best = F.desc(high[0]) if high else F.asc(low[0])
    place = F.monotonically_increasing_id()
    rows = kept(df.orderBy(best, *[F.col(c) for c in measures]).withColumn("__id", place))
    rows = rows.withColumn("__block", F.concat_ws(":", F.shiftright("__id", 33), F.floor(F.col("__id").bitwiseAND((1 << 33) - 1) / size)))
    good = lambda c: -F.col(c) if c in high else F.col(c)
    corners = rows.groupBy("__block").agg(*[F.min(good(c)).alias(f"best_{c}") for c in measures], *[F.max(good(c)).alias(f"worst_{c}") for c in measures])
    a, b = corners.alias("a"), corners.alias("b")
    near = F.lit(True)
    for c in measures:
        near = near & (F.col(f"a.best_{c}") <= F.col(f"b.worst_{c}"))
    meets = kept(a.join(b, near).select(F.col("a.__block").alias("__of"), F.col("b.__block").alias("__block")))  # names of blocks
    # each block's points once, as arrays of plain numbers
    packed = rows.groupBy("__block").agg(F.collect_list(F.array(*[good(c).cast("double") for c in measures])).alias("__points")).withColumnRenamed("__block", "__of")
    rivals = meets.join(packed, "__of").drop("__of")
    mine = rows.groupBy("__block").agg(F.collect_list(F.struct("__id", F.array(*[good(c).cast("double") for c in measures]).alias("m"))).alias("__own"))

    def beaten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, points in zip(frame["__own"], frame["__points"], strict=True):
                m, p = np.array([list(x["m"]) for x in own]), np.array([list(x) for x in points])
                lost = np.zeros(len(m), bool)
                for k in range(0, len(m), 256):
                    some = m[k : k + 256, None, :]
                    lost[k : k + 256] = ((p[None] <= some).all(axis=2) & (p[None] < some).any(axis=2)).any(axis=1)
                yield pd.DataFrame({"__id": [x["__id"] for x, out in zip(own, lost, strict=True) if out]}, dtype="int64")

    out = mine.join(rivals, "__block").select("__own", "__points").mapInPandas(beaten, "__id long").distinct()
    return rows.join(out, "__id", "left_anti").select(*df.columns)


def depth(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Front numbers from 1 of points (high: larger better, low: smaller better) in O(n log n).

    In order of falling ``high`` and rising ``low`` a point belongs to the first front
    whose least ``low`` so far doesn't dominate it; equal points share a front."""
    order = np.lexsort((low, -high))
    out = np.zeros(len(high), np.int32)
    tails: list[float] = []  # the least low of each front, rising
    last: tuple[float, float] | None = None
    at = 0
    for i in order:
        point = (high[i], low[i])
        if point != last:
            at = bisect_right(tails, low[i])
            tails[at : at + 1] = [low[i]]
            last = point
        out[i] = at + 1
    return out


def open_fronts(low: np.ndarray, opened: np.ndarray, tails: list[float]) -> tuple[np.ndarray, list[int]]:
    """One block of a group's points in order of falling ``high`` and rising ``low``; ``opened``: places where a front opened among smaller values.

    Where ``opened`` is true the row is no point: a smaller value has come to stand for a
    front, so the block's least tail, if there is one, goes, else the news goes on.
    ``tails``: the block's values that stand for fronts, rising; changed in place.  Gives
    each row's number of fronts among the block's own values, itself included, and the places that go on."""
    own, on = np.zeros(len(low), np.int64), []
    for n, (value, news) in enumerate(zip(low.tolist(), opened.tolist(), strict=True)):
        if news:
            if tails:
                del tails[0]
            else:
                on.append(n)
            continue
        at = bisect_right(tails, value)
        if at == len(tails):
            on.append(n)
        tails[at : at + 1] = [value]
        own[n] = at + 1
    return own, on


BLOCK = "h double, v double, i int, j int, kind string, tails array<double>, seen long, pareto_front int"


def peeled(points: DataFrame, group: str, size: int) -> DataFrame:
    """(group, __h, __v, pareto_front) of distinct points of large groups, in blocks of about ``size`` points.

    A group's points are cut into ranges of ``high`` (i) and of ``low`` (j).  Within a range of
    ``low`` the rule of :func:`depth` needs the range's own tails, which the block before
    in i left, and the moments at which a front opened below it, which the block before
    in j passes on; a point's front is the number of such moments up to it plus its place
    among the range's own tails.  So all blocks with the same i + j run at once, of all
    groups, and each wave's messages are written before the next."""
    spark = points.sparkSession
    counts = points.groupBy(group).agg(F.count("*").alias("n"))
    parts = F.least(F.lit(64), F.ceil(F.sqrt(F.col("n") / size))).cast("int")
    marks = points.join(counts.select(group, parts.alias("p")), group).groupBy(group).agg(F.max("p").alias("p"), F.percentile_approx(-F.col("__h"), F.lit([k / 64 for k in range(1, 64)]), 1000).alias("hs"), F.percentile_approx("__v", F.lit([k / 64 for k in range(1, 64)]), 1000).alias("vs"))
    place = lambda value, bounds: F.size(F.filter(F.transform(F.sequence(F.lit(1), F.col("p")), lambda k: F.get(bounds, F.floor(k * 64 / F.col("p")).cast("int") - 1)), lambda b: b < value))
    cut = kept(points.join(marks, group).select(group, F.col("__h").alias("h"), F.col("__v").alias("v"), place(-F.col("__h"), F.col("hs")).alias("i"), place(F.col("__v"), F.col("vs")).alias("j")))
    last = cut.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    schema = T.StructType([cut.schema[group], *T._parse_datatype_string(BLOCK).fields])
    empty = {"kind": None, "tails": None, "seen": None, "pareto_front": None}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, i, j = frame[group].iloc[0], int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        state = frame[frame["kind"] == "state"]
        tails = list(state["tails"].iloc[0]) if len(state) else []
        seen = int(state["seen"].iloc[0]) if len(state) else 0
        rows = frame[frame["kind"] != "state"].sort_values(["h", "v"], ascending=[False, True])
        news = (rows["kind"] == "news").to_numpy()
        own, on = open_fronts(rows["v"].to_numpy(float), news, tails)
        out = rows[["h", "v"]].assign(i=i, j=j, kind="done", tails=None, seen=None, pareto_front=seen + np.cumsum(news) + own)[~news]
        parts = [out]
        if i < last.i:
            parts.append(pd.DataFrame([{"h": None, "v": None, "i": i + 1, "j": j, **empty, "kind": "state", "tails": tails, "seen": seen + int(news.sum())}]))
        if j < last.j and on:
            parts.append(rows[["h", "v"]].iloc[on].assign(i=i, j=j + 1, **empty | {"kind": "news"}))
        both = pd.concat(parts, ignore_index=True).assign(**{group: key})
        return both[[f.name for f in schema.fields]]

    done, messages = [], None
    for wave in range(last.i + last.j + 1):
        own = cut.where(F.col("i") + F.col("j") == wave).select(group, "h", "v", "i", "j", F.lit("point").alias("kind"), F.lit(None).cast("array<double>").alias("tails"), F.lit(None).cast("long").alias("seen"), F.lit(None).cast("int").alias("pareto_front"))
        here = own if messages is None else own.unionByName(messages.where(F.col("i") + F.col("j") == wave))
        out = kept(here.groupBy(group, "i", "j").applyInPandas(run, schema))
        done.append(out.where("kind = 'done'").select(group, F.col("h").alias("__h"), F.col("v").alias("__v"), "pareto_front"))
        sent = out.where("kind <> 'done'")
        # a block reads what the blocks beside it sent in the wave before
        messages = sent
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every if done else spark.createDataFrame([], points.schema)


def fronts(df: DataFrame, group: str, high: str, low: str, block: int = MERGED) -> DataFrame:
    """With ``pareto_front``, by peeling each group; a null ``low`` is +inf.

    Groups are cavities with their candidates.  Only distinct points travel to the
    kernel: rows that share both values share a front.  Groups of more than ``block``
    points are peeled in blocks (see :func:`peeled`), the others one to a task."""
    v = F.coalesce(F.col(low).cast("double"), F.lit(float("inf")))
    rows = df.withColumn("__v", v)
    points = rows.select(group, F.col(high).cast("double").alias("__h"), "__v").distinct()
    schema = T.StructType([*points.schema.fields, T.StructField("pareto_front", T.IntegerType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(pareto_front=depth(frame["__h"].to_numpy(float), frame["__v"].to_numpy(float)))

    points = kept(points)
    large = kept(points.groupBy(group).count().where(F.col("count") > block).select(group))
    if large.isEmpty():
        ranked = points.groupBy(group).applyInPandas(run, schema)
    else:
        small = points.join(large, group, "left_anti").groupBy(group).applyInPandas(run, schema)
        ranked = small.unionByName(peeled(points.join(large, group, "left_semi"), group, block))
    return rows.withColumn("__h", F.col(high).cast("double")).join(ranked, [group, "__h", "__v"]).select(*df.columns, "pareto_front")


def rank_in_front(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return ranks(df, [group, "pareto_front"], order, "pareto_rank")
