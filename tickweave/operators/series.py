"""Returns, rolling and cumulative values, edges, runs and early slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickweave.functions.scalars import ratio, safe_corr, safe_log_ratio
from tickweave.plans.series import BLOCK, UNMEASURED, affine_scan, index_rows, lagged, measure, over_series, running

# --- window expressions ----------------------------------------------------------


def change(c: Column | str, previous: Column, kind: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if kind == "simple":
        return ratio(c, previous) - 1
    if kind == "log":
        return safe_log_ratio(c, previous)
    return c - previous


_ROLL = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}


def rolled(fn: str, c: Column | str, n: int, w: WindowSpec) -> Column:
    """Rolling aggregate of the last n rows, NULL until n non-null values are there."""
    c = F.col(c) if isinstance(c, str) else c
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, _ROLL[fn](c).over(frame))


# --- operators --------------------------------------------------------------------


def returns(df: DataFrame, kind: str = "simple", price: str = "close", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), out: str = "ret", bounded: bool = False) -> DataFrame:
    """Row-to-row return ("simple", "log" or "diff"), not reset at day borders."""
    prev = lagged(df, keys, order, {"_prev": (price, 1)}, bounded=bounded)
    return prev.withColumn(out, change(price, F.col("_prev"), kind)).drop("_prev")


def rolling(df: DataFrame, specs: dict[str, tuple[str, str, int]], keys=("symbol",), order=("ts",), bounded: bool = False) -> DataFrame:
    """{new: (mean|std|max|min|sum, column, n)}; all columns share one shuffle."""
    reach = max(n for _, _, n in specs.values()) - 1

    def build(d, w):
        return d.withColumns({k: rolled(fn, c, n, w) for k, (fn, c, n) in specs.items()})

    return over_series(df, keys, order, build, before=reach, bounded=bounded)


def forward_returns(df: DataFrame, horizons: Sequence[int] = (5, 15, 30, 60), price: str = "close", keys=("symbol",), order=("ts",)) -> DataFrame:
    """P[t+h]/P[t]-1 by rows, across days."""
    ahead = lagged(df, keys, order, {f"_f{h}": (price, -h) for h in horizons})
    done = ahead.withColumns({f"fwd_{h}": ratio(f"_f{h}", price) - 1 for h in horizons})
    return done.drop(*[f"_f{h}" for h in horizons])


def rising_edge(df: DataFrame, flag: str, keys: Sequence[str], order=("ts",), out: str = "start") -> DataFrame:
    """True where the flag holds and did not hold on the previous row of the same day."""
    day = df.withColumn("_day", F.to_date(order[0]))
    prev = lagged(day, [*keys, "_day"], order, {"_prev": (flag, 1)})
    now, before = F.coalesce(F.col(flag), F.lit(False)), F.coalesce(F.col("_prev"), F.lit(False))
    return prev.withColumn(out, now & ~before).drop("_prev", "_day")


def equity_curve(pnl: DataFrame, value: str, capital: float, keys: Sequence[str] = (), order=("ts",), bounded: bool = False) -> DataFrame:
    """Capital plus the running sum of PnL."""
    return running(pnl, keys, order, {"_cum": ("sum", value)}, bounded).withColumn("equity", F.lit(float(capital)) + F.col("_cum")).drop("_cum")


def drawdown(df: DataFrame, value: str = "equity", keys: Sequence[str] = (), order=("ts",), bounded: bool = False) -> DataFrame:
    peaked = running(df, keys, order, {"peak": ("max", value)}, bounded)
    return peaked.withColumn("drawdown", ratio(value, "peak") - 1)


def smoothing(x: Column, alpha: float, gap: Column) -> tuple[Column, Column]:
    """One step of an exponential mean as (a, b) of y = a * y_before + b.

    ``gap`` is the number of rows since the value before, NULL at the first: rows without a value keep the mean, and their weight fades all the same.
    """
    old = F.pow(F.lit(1.0 - alpha), gap)
    a = F.when(x.isNull() | gap.isNull(), 1.0).otherwise(old / (old + alpha))
    b = F.when(x.isNull(), 0.0).when(gap.isNull(), x).otherwise(x * alpha / (old + alpha))
    return a, b


def ewm(df: DataFrame, spans: dict[str, tuple[str, int]], keys=("symbol",), order=("ts",), bounded: bool = False, block: int = BLOCK, cells=UNMEASURED) -> DataFrame:
    """Exponential means {new: (column, span)}: α = 2/(span+1), y₀ = x₀, no bias adjustment.

    A row without a value (NULL, NaN) has the mean of the rows before, NULL before the first value.
    """
    if not bounded and cells is UNMEASURED:
        cells = measure(df, keys, order, block)
    how = {"bounded": bounded, "block": block, "cells": cells}
    names = {c: f"_x{i}" for i, c in enumerate(sorted({c for c, _ in spans.values()}))}
    value = {x: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c, x in names.items()}
    # every step below looks at the same cells
    rows = cells.place(df) if cells else df
    rows = index_rows(rows.withColumns(value), keys, order, pos="_at", **how)
    rows = running(rows, keys, order, {f"_seen{x}": ("last", F.when(F.col(x).isNotNull(), F.col("_at"))) for x in names.values()}, **how)
    rows = lagged(rows, keys, order, {f"_prev{x}": (f"_seen{x}", 1) for x in names.values()}, **how)
    gap = {x: F.col("_at") - F.col(f"_prev{x}") for x in names.values()}
    steps = {n: smoothing(F.col(names[c]), 2 / (span + 1), gap[names[c]]) for n, (c, span) in spans.items()}
    out = affine_scan(rows, keys, order, steps, **how)
    known = {n: F.when(F.col(f"_seen{names[c]}").isNotNull(), F.col(n)) for n, (c, _) in spans.items()}
    return out.withColumns(known).select(*df.columns, *spans)


def autocorr1(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], min_rows: int = 10, out: str = "autocorr") -> DataFrame:
    """Lag-1 autocorrelation per key over non-null values; NULL under ``min_rows``."""
    rows = df.filter(F.col(column).isNotNull())
    pairs = lagged(rows, keys, order, {"_prev": (column, 1)})
    return pairs.groupBy(*keys).agg(
        F.when(F.count(column) >= min_rows, safe_corr(column, "_prev")).alias(out)
    )


def run_length(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], ts: str = "ts", bounded: bool = False, opening: str | None = None) -> DataFrame:
    """Consecutive count of equal values and the time the run began; ``opening`` marks the first run of each series."""

    def build(d, w):
        prev = F.lag(column).over(w)
        return d.withColumn("_new", (F.row_number().over(w) == 1) & (F.col("_pos") == 0) | ~F.col(column).eqNullSafe(prev))

    marked = over_series(df, keys, order, build, before=1, bounded=bounded, keep_pos="_at")
    start = running(
        marked, keys, order,
        {"_start": ("last", F.when(F.col("_new"), F.col("_at"))), "run_start": ("last", F.when(F.col("_new"), F.col(ts)))},
        bounded=bounded,
    )
    marks = {"run_count": F.col("_at") - F.col("_start") + 1} | ({opening: F.col("_start") == 0} if opening else {})
    return start.withColumns(marks).drop("_new", "_at", "_start")


def early_slice(df: DataFrame, horizons: Sequence[float], variant: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First part of each series for every horizon.

    "floor5" keeps max(int(n·h), 5) rows, "ceil2" keeps max(ceil(n·h), 2).
    """
    n, h = F.col("total_n_obs"), F.col("horizon")
    cutoff = F.greatest(F.floor(n * h), F.lit(5)) if variant == "floor5" else F.greatest(F.ceil(n * h), F.lit(2))
    numbered = index_rows(df, keys, order, total="total_n_obs")
    return (
        numbered.withColumn("horizon", F.explode(F.array(*[F.lit(float(x)) for x in horizons])))
        .filter(F.col("_pos") < cutoff)
    )


def early_shares(sliced: DataFrame, full: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Activity and time covered by each early slice."""
    life = full.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    seen = sliced.groupBy(*keys, "horizon").agg(
        F.max("total_n_obs").alias("total_n_obs"), F.count(F.lit(1)).alias("early_n_obs"), F.max(ts).alias("_e")
    )
    span = lambda x, y: (F.unix_micros(F.col(y).cast("timestamp")) - F.unix_micros(F.col(x).cast("timestamp"))) / F.lit(1e6)
    return (
        seen.join(life, list(keys))
        .withColumns({"total_time_seconds": span("_a", "_b"), "early_time_seconds": span("_a", "_e")})
        .withColumns(
            {
                "early_obs_share": F.col("early_n_obs") / F.col("total_n_obs"),
                "early_time_share": ratio("early_time_seconds", "total_time_seconds"),
            }
        )
        .drop("_a", "_b", "_e")
    )


def frame_windows(df: DataFrame, width: int, cols: Sequence[str], target: str, keys=("symbol",), order=("ts",)) -> DataFrame:
    """Supervised framing: the previous ``width`` rows of all columns → the target of this row."""

    def build(d, w):
        frame = w.rowsBetween(-width, -1)
        return d.withColumn("window", F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(frame))

    framed = over_series(df, keys, order, build, before=width)
    return framed.filter(F.size("window") == width).select(*keys, *order, "window", F.col(target).alias("target"))


def temporal_split(df: DataFrame, key: str, frac: float = 0.8, out: str = "is_train") -> DataFrame:
    """First ``frac`` of the distinct ordered keys is train."""
    ranked = index_rows(df.select(key).distinct(), [], [key], total="_n")
    marked = ranked.select(F.col(key).alias("_k"), (F.col("_pos") < F.floor(F.col("_n") * frac)).alias(out))
    return df.join(marked, df[key] == F.col("_k")).drop("_k")


def market_state_features(bars: DataFrame, keys=("symbol",), order=("ts",)) -> DataFrame:
    """Momentum, relative volume, spread proxy and rolling volatility."""

    def build(d, w):
        d = d.withColumn("_ret", safe_log_ratio("close", F.lag("close").over(w)))
        return d.withColumns(
            {
                "momentum": F.col("close") - rolled("mean", "close", 5, w),
                "rel_volume": ratio("volume", rolled("mean", "volume", 20, w)),
                "spread_proxy": F.col("high") - F.col("low"),
                "spread_pct": ratio(F.col("high") - F.col("low"), "close"),
                "rolling_vol": rolled("std", "_ret", 20, w),
            }
        ).drop("_ret")

    return over_series(bars, keys, order, build, before=21)


def minute_profile(bars: DataFrame, value: str, ts: str = "ts", out: str = "profile") -> DataFrame:
    """Mean of a value per minute of the day, attached to every row (1,440 profile rows at most)."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    rows = bars.withColumn("_minute", minute)
    profile = rows.groupBy("_minute").agg(F.avg(value).alias(out))
    return rows.join(F.broadcast(profile), "_minute", "left").drop("_minute")
