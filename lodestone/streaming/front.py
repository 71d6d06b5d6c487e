"""A growing folder of runs as a stream: first-seen rows, and first fronts kept up to date.

State is kept by key: :func:`first_by_key` (whose state leaves with the watermark,
if it has one) and :func:`front_by_key` touch only the keys of a batch and give out
changes, which :func:`collected` and :func:`standing` read back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.operators.pareto import front1


def runs(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", per_trigger).csv(folder)


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def keep_front(stream: DataFrame, folder: str, checkpoint: str, high: list[str], low: list[str]) -> StreamingQuery:
    """Keep the first front of all rows so far in ``folder``/v<batch>; the front of a union is the front of the fronts.

    A batch that runs again writes the same folder again, so a restart changes nothing."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch
        if number > 0:
            both = spark.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}").unionByName(batch)
        front1(both, high, low).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The latest front."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return spark.read.parquet(f"{folder}/v{max(int(n[1:]) for n in names if n.startswith('v'))}")


def files(spark: SparkSession, folder: str, schema: str | StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def micros(time: pd.Series) -> pd.Series:
    return time.astype("datetime64[us]").astype("int64")


def first_by_key(stream: DataFrame, key: str, time: str, item: str, delay: str | None = None) -> DataFrame:
    """(key, n, first, item): after each batch, of the keys in it, how many rows came so far, and the first of them by time and item.

    Without ``delay`` no state leaves, so it is an aggregate, folded before its rows are shuffled; rows of
    null time come last there, and those of null item are counted only. With ``delay``, rows later than the
    watermark are left out by it and a key's state goes once the watermark passes its last row; a key that
    comes again then starts anew. This takes a call of Python for each key of a batch."""
    if not delay:
        place = F.when(F.col(item).isNotNull(), F.struct(F.col(time).isNull(), F.col(time), F.col(item).alias("own")))
        ahead = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.min(place).alias("ahead"))
        return ahead.select(key, "n", "first", F.col("ahead.own").alias(item))

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, own, last = state.get if state.exists else (0, None, None, 0)
        for frame in frames:
            at = micros(frame[time])
            best = min(zip(at.tolist(), frame[item].tolist(), strict=True))
            n, last = n + len(frame), max(last, int(at.max()))
            if first is None or best < (first, own):
                first, own = best
        state.update((n, first, own, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [name[0]], "n": [n], "first": pd.to_datetime([first], unit="us", utc=True), item: [own]})

    rows = stream.select(key, time, item).withWatermark(time, delay)
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, n long, first timestamp, {item} long", "n long, first long, own long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def front_by_key(stream: DataFrame, key: str, high: str, low: str, item: str) -> DataFrame:
    """(key, item, high, low, stands): changes of each key's first front (``high`` larger, ``low`` smaller is better): rows that join it, and rows that leave it.

    The state of a key is its front; points that equal one on it stand beside it."""

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        highs, lows, items = (list(x) for x in state.get) if state.exists else ([], [], [])
        before = set(items)
        for frame in frames:
            both = sorted(zip([*highs, *frame[high].tolist()], [*lows, *frame[low].tolist()], [*items, *frame[item].tolist()], strict=True), key=lambda p: (-p[0], p[1], p[2]))
            kept_: list[tuple] = []
            for p in both:
                if not kept_ or p[1] < kept_[-1][1] or p[:2] == kept_[-1][:2]:
                    kept_.append(p)
            gone = {p[2]: p for p in both if p[2] in before}
            highs, lows, items = ([p[i] for p in kept_] for i in range(3))
            joined = [(p, True) for p in kept_ if p[2] not in before]
            left = [(p, False) for i, p in gone.items() if i not in set(items)]
            before = set(items)
            if joined or left:
                yield pd.DataFrame([(name[0], p[2], p[0], p[1], stands) for p, stands in [*left, *joined]], columns=[key, item, high, low, "stands"])
        state.update((highs, lows, items))

    rows = stream.select(key, F.col(high).cast("double").alias(high), F.col(low).cast("double").alias(low), F.col(item).cast("long").alias(item))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} string, {item} long, {high} double, {low} double, stands boolean", "highs array<double>, lows array<double>, items array<long>", "update", GroupStateTimeout.NoTimeout)


def written(changes: DataFrame, folder: str) -> str:
    """Run a stream of changes to its end, each batch into folder/out/batch=<n>; a batch that runs again writes the same folder again."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    changes.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def collected(changes: DataFrame, folder: str, keys: list[str], newest: str) -> DataFrame:
    """The last change of each key: the one with the largest ``newest``."""
    spark = changes.sparkSession
    rows = spark.read.schema(changes.schema).parquet(written(changes, folder))
    names = [c for c in changes.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), newest).alias("__last")).select(*keys, "__last.*")


def standing(changes: DataFrame, folder: str, key: str, item: str) -> DataFrame:
    """Rows whose last change says that they stand."""
    spark = changes.sparkSession
    rows = spark.read.option("basePath", f"{folder}/out").schema(changes.schema.add("batch", "long")).parquet(written(changes, folder))
    order = F.row_number().over(Window.partitionBy(key, item).orderBy(F.desc("batch"), "stands"))
    return rows.withColumn("__rn", order).where("__rn = 1 and stands").drop("__rn", "batch", "stands")
