"""Named queries with their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def text_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so results compare the same in any client."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema]
    )


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return text_dates(fn(spark, sf))

        QUERIES[name] = run
        if sql:
            TWINS[name] = sql
        return fn

    return add
