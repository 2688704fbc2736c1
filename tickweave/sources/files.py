"""Readers and writers for bars, typed text files and result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.session import shared_folder


def read_bars(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where=None,
) -> DataFrame:
    """Parquet scan; the filter and the column list reach the file reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def write_bars(df: DataFrame, path: str, symbol: str = "symbol", files_per_symbol: int = 8) -> None:
    """One folder per symbol. Rows of a symbol go to several writers, so a hot symbol is no single task."""
    slot = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_symbol))
    df.repartition(F.col(symbol), slot).write.mode("overwrite").partitionBy(symbol).parquet(path)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV read as text, each column then cast; text that does not fit becomes NULL."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return coerce(spark.read.schema(text).option("header", True).csv(path), schema)


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the named columns, unreadable values to NULL; other columns are kept."""
    wanted = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(c).try_cast(wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def universe_metadata(bars: DataFrame, symbol: str = "symbol", ts: str = "ts", fields: Sequence[str] = ("market_cap", "sector", "company_name")) -> DataFrame:
    """One row per symbol with the metadata of its earliest bar."""
    row = F.min_by(F.struct(*fields), F.col(ts)).alias("_m")
    return bars.groupBy(symbol).agg(row).select(symbol, *[F.col(f"_m.{f}") for f in fields])
