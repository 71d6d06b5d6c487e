"""Where queries are registered, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **types: str):
    """Register a function under its name, with its SQL; ``types``: columns that the SQL has to cast (type="column column")."""
    casts = ", ".join(f"{c}::{t} AS {c}" for t, names in types.items() for c in names.split())

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
