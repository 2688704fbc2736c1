"""Group summaries; every one merges partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio, safe_corr
from tickweave.plans.order_stats import medians, quantiles_wide, value_ranks
from tickweave.plans.spread import beside


def trajectory_summary(paths: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "p", ts: str = "ts") -> DataFrame:
    """Market summary: times, count, first/last non-null value, mean, median, min, max, std."""
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    main = paths.groupBy(*keys).agg(
        F.min(ts).alias("start_date"),
        F.max(ts).alias("last_observed_date"),
        F.count(value).alias("n_observations"),
        F.min_by(value, at).alias("first_probability"),
        F.max_by(value, at).alias("final_probability"),
        F.avg(value).alias("mean_probability"),
        F.min(value).alias("min_probability"),
        F.max(value).alias("max_probability"),
        F.stddev_samp(value).alias("probability_volatility"),
    )
    return main.join(medians(paths, {"median_probability": value}, keys), list(keys), "left")


def value_share(df: DataFrame, column: str) -> DataFrame:
    total = df.select(F.count(column).alias("n")).scalar()
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total)


def class_share_by(df: DataFrame, group: str, label: str, classes: Sequence, prefix: str = "share_") -> DataFrame:
    """Share of each class per group, 0 where a class is absent."""
    return df.groupBy(group).agg(
        *[F.avg(F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0)).alias(f"{prefix}{c}".replace("-", "m")) for c in classes]
    )


def crosstab_norm(df: DataFrame, rows: str, cols: str, values: Sequence, prefix: str = "p_") -> DataFrame:
    """Counts by two labels, each row divided by its total over the listed values."""
    counts = df.groupBy(rows).agg(*[F.count(F.when(F.col(cols) == F.lit(v), 1)).alias(f"_{v}") for v in values])
    total = sum((F.col(f"_{v}") for v in values[1:]), F.col(f"_{values[0]}"))
    return counts.select(rows, *[ratio(f"_{v}", total).alias(f"{prefix}{v}") for v in values])


def describe_ext(df: DataFrame, column: str, qs: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """describe() plus chosen percentiles as one row."""
    basics = df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )
    marks = quantiles_wide(df, {f"p{round(q * 1000):03d}": (column, q) for q in qs})
    return beside(basics, marks)


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """Most frequent class (smallest on ties) and the accuracy of always guessing it."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("n").agg(F.min(label).alias("_label"), F.count(F.lit(1)).alias("_classes"))
    return sizes.agg(
        F.max_by("_label", "n").alias("majority_class"),
        (F.max("n") / F.sum(F.col("n") * F.col("_classes"))).alias("baseline_accuracy"),
    )


def cond_share(df: DataFrame, keys: Sequence[str], shares: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c.cast("int").cast("double")).alias(k) for k, c in shares.items()])


def market_state(panel: DataFrame, day: str, ret: str, vol: str, entity: str) -> DataFrame:
    """Cross-section per day: median return, median volatility, breadth, number of entities."""
    breadth = panel.groupBy(day).agg(
        F.avg((F.col(ret) > 0).cast("double")).alias("breadth"), F.countDistinct(entity).alias("n_entities")
    )
    return breadth.join(medians(panel, {"median_return": ret, "median_vol": vol}, [day]), day, "left")


def sector_pair_counts(universe: DataFrame, sector: str = "sector", symbol: str = "symbol") -> DataFrame:
    n = F.countDistinct(symbol)
    return universe.groupBy(sector).agg(n.alias("n_symbols"), F.floor(n * (n - 1) / 2).cast("bigint").alias("n_pairs"))


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", row_id: Sequence[str] = ()) -> DataFrame:
    """Upper triangle in long form (a, b, value)."""
    if method == "spearman":
        df = average_ranks(df, cols, row_id)
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("value")) for a, b in combinations(cols, 2)
    ]
    return df.agg(F.array(*cells).alias("_m")).select(F.inline("_m"))


def average_ranks(df: DataFrame, cols: Sequence[str], row_id: Sequence[str] = ()) -> DataFrame:
    """``row_id`` and the columns replaced by their average ranks; NULL and NaN have none.

    A rank table has one row per distinct value, so it is joined to the wide rows column by column: small where values repeat, and a
    value that many rows share is a skewed join, which Spark splits.
    """
    out = df.select(*row_id, *[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        ranks = value_ranks(df, c).select(F.col("value").alias("_value"), F.col("rank").alias("_rank"))
        out = out.join(ranks, F.col(c) == F.col("_value"), "left").withColumn(c, F.col("_rank")).drop("_value", "_rank")
    return out


def moments(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"))


def trend(indexed: DataFrame, value: str, pos: str, keys: Sequence[str], out: str = "trend") -> DataFrame:
    """Least-squares slope against the row position."""
    return indexed.groupBy(*keys).agg(F.regr_slope(F.col(value), F.col(pos).cast("double")).alias(out))


def by_period(df: DataFrame, ts: str, unit: str, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(F.date_trunc(unit, ts)).alias("period")).agg(*aggs)


def path_fan(paths: DataFrame, step: str, value: str) -> DataFrame:
    """Median, 5/10/90/95 percentiles and dispersion per step over many paths."""
    marks = quantiles_wide(paths, {f"p{round(q * 100):02d}": (value, q) for q in (0.05, 0.1, 0.5, 0.9, 0.95)}, [step])
    spread = paths.groupBy(step).agg(F.stddev_samp(value).alias("dispersion"), F.count(value).alias("n_paths"))
    return spread.join(marks, step, "left")


def execution_summary(history: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Per run: final cost, total shares, final inventory, participation, number of steps."""

    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(t)))

    return history.groupBy(*keys).agg(
        last("cumulative_cost").alias("cumulative_cost"),
        F.sum("shares_traded").alias("total_shares_traded"),
        last("inventory_remaining").alias("final_inventory"),
        F.avg("participation_rate").alias("avg_participation"),
        F.max("participation_rate").alias("max_participation"),
        F.count(t).alias("num_steps"),
    )


def mean_by_step(history: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return history.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def corr_by(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "corr") -> DataFrame:
    return df.groupBy(*keys).agg(safe_corr(x, y).alias(out))


