"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def session(app: str = "lodestone", **conf: str) -> SparkSession:
    """Sizes (memory, shuffle partitions, broadcast threshold) stay with the cluster; only semantics are set here."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own where it is unset, in local mode only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; what is built on it doesn't compute it again, whichever executor is lost.

    (A checkpoint would compute it twice unless it were cached.)"""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    void = {f.name for f in df.schema if isinstance(f.dataType, NullType)}  # columns of no type, which files can't hold
    stored = df.drop(*void)
    stored.write.parquet(path)
    back = spark.read.schema(stored.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else back


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to three times as many tasks as there are cores: for rows that are few but dear, which a small file would leave to one task."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *columns)


def each_once(df: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute`` of the different values of ``column`` (a table of that one column), each computed once however many rows hold it; written."""
    return kept(compute(kept(spread(df.select(column).distinct(), column))))


def met(df: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Each row with the other columns of ``found`` for its ``column`` (null meets null); a found table that Spark holds for small is broadcast."""
    own = found.withColumnRenamed(column, "__met")
    return df.join(own, F.col(column).eqNullSafe(F.col("__met"))).drop("__met")
