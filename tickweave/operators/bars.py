"""Bars: building, resampling onto a minute grid, coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.plans.series import lagged

PRICES = ("open", "high", "low", "close", "vwap")
FLOWS = ("volume", "transactions")


def bars_from_ticks(ticks: DataFrame, unit: str = "hour", price: str = "price", qty: str = "qty", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Trades → OHLCV bars. One aggregate, merged before the shuffle."""
    at = F.struct(*order)
    p, q = F.col(price), F.col(qty)
    return (
        ticks.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by(p, at).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, at).alias("close"),
            F.try_divide(F.sum(p * q), F.sum(q).cast("double")).alias("vwap"),
            F.sum(q).alias("volume"),
            F.count(F.lit(1)).alias("transactions"),
        )
    )


def minute_last(bars: DataFrame, prices: Sequence[str] = PRICES, flows: Sequence[str] = FLOWS, meta: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Per symbol and minute: last known prices (NULLs skipped), summed flows."""
    at = F.struct(*order)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in prices]
    total = [F.sum(c).alias(c) for c in flows]
    first = [F.min_by(F.struct(*meta), at).alias("_meta")] if meta else []
    return bars.groupBy("symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(*last, *total, *first)


def _fill(bars, start, end, prices, flows, meta, order, back):
    """Repeat each observed minute until the next one: forward fill without a grid join.

    All windows run per (symbol, day), at most one row per minute of a day.
    """
    observed = minute_last(bars, prices, flows, meta, order).withColumn("day", F.to_date("minute"))
    by_day = W.partitionBy("symbol", "day")
    w = by_day.orderBy("minute")
    if meta:
        observed = observed.withColumn("_meta", F.first("_meta").over(w))
    if start:
        lo = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.lit(f"{start}:00")))
        hi = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.lit(f"{end}:00")))
        observed = observed.withColumns({"_lo": lo, "_hi": hi}).filter(F.col("minute").between(F.col("_lo"), F.col("_hi")))
    else:
        observed = observed.withColumns({"_lo": F.min("minute").over(by_day), "_hi": F.max("minute").over(by_day)})
    step = F.expr("INTERVAL 1 MINUTE")
    seen = w.rowsBetween(W.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    filled = {}
    for c in prices:
        past = F.last(c, ignorenulls=True).over(seen)
        filled[c] = F.coalesce(past, F.first(c, ignorenulls=True).over(ahead)) if back else past
    first_row = F.row_number().over(w) == 1
    until = F.coalesce(F.lead("minute").over(w) - step, F.col("_hi"))
    since = F.when(first_row, F.col("_lo")).otherwise(F.col("minute")) if back else F.col("minute")
    rows = observed.withColumns({**filled, "_since": since, "_until": until})
    grid = rows.withColumn("ts", F.explode(F.sequence("_since", "_until", step)))
    here = F.col("ts") == F.col("minute")
    return grid.select(
        "symbol",
        "day",
        "ts",
        *prices,
        *[F.when(here, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast(bars.schema[c].dataType).alias(c) for c in flows],
        *[F.col(f"_meta.{m}").alias(m) for m in meta],
    )


def resample_grid(bars, start="09:15", end="16:00", prices=PRICES, flows=FLOWS, meta=(), order=("ts",)) -> DataFrame:
    """Full minute grid per symbol-day with data in the session: prices forward then back filled, flows 0."""
    return _fill(bars, start, end, prices, flows, meta, order, back=True)


def resample_observed(bars, prices=PRICES, flows=FLOWS, meta=(), order=("ts",)) -> DataFrame:
    """Minute grid from the first to the last bar of each symbol-day, forward fill only."""
    return _fill(bars, None, None, prices, flows, meta, order, back=False)


def coverage(bars: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    return bars.groupBy(symbol).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.to_date(ts)).alias("n_days"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def gap_histogram(bars: DataFrame, symbol: str = "symbol", ts: str = "ts", order: Sequence[str] | None = None) -> DataFrame:
    """How often each step (seconds) between neighbouring bars occurs."""
    steps = lagged(bars, [symbol], list(order or [ts]), {"_prev": (ts, 1)})
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("_prev").cast("timestamp"))
    return steps.filter(F.col("_prev").isNotNull()).groupBy(gap.alias("gap_seconds")).agg(F.count(F.lit(1)).alias("n"))


def bars_per_day(bars: DataFrame, expected: int = 406) -> DataFrame:
    return (
        bars.groupBy("symbol", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_bars"))
        .withColumn("complete", F.col("n_bars") == expected)
    )


def last_per_day(bars: DataFrame, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    return bars.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by(value, ts).alias(value))
