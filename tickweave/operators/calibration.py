"""Probability calibration, Beta-Binomial fair values, median-split comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.plans.order_stats import medians

# fixed values: bin edges as produced by steps of 0.1 in floating point
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def brier(df: DataFrame, p: str, y: str, out: str = "brier") -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias(out))


def bin_index(p: Column | str, edges: Sequence[float] = EDGES) -> Column:
    """Right-closed bin number; the first bin includes its lower edge; outside → NULL."""
    p = F.col(p) if isinstance(p, str) else p
    index = sum(((p > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when(p.between(edges[0], edges[-1]), index)


def bin_probability(df: DataFrame, p: str, edges: Sequence[float] = EDGES, out: str = "bin") -> DataFrame:
    return df.withColumn(out, bin_index(p, edges))


def calibration_table(df: DataFrame, p: str, y: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """Per bin: count, mean probability, observed rate, gap. Empty bins stay."""
    spark = df.sparkSession
    bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    stats = bin_probability(df, p, edges).groupBy("bin").agg(
        F.count(p).alias("n"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate"), F.sum(F.col(y).cast("bigint")).alias("successes")
    )
    table = bins.join(stats, "bin", "left").fillna(0, subset=["n", "successes"])
    return table.withColumn("gap", F.col("observed_rate") - F.col("mean_probability"))


def ece(table: DataFrame) -> DataFrame:
    """Σ n/N·|gap| over bins with data."""
    n = F.col("n")
    return table.agg(ratio(F.sum(n * F.abs("gap")), F.sum(n)).alias("ece"))


def beta_fair_value(table: DataFrame, a: float = 1.0, b: float = 1.0, out: str = "fair") -> DataFrame:
    """Posterior mean per bin under a Beta(a, b) prior."""
    return table.withColumn(out, (F.col("successes") + a) / (F.col("n") + a + b))


def apply_curve(df: DataFrame, curve: DataFrame, p: str, value: str = "fair", edges: Sequence[float] = EDGES) -> DataFrame:
    """Bin → fair value on every row; the curve has one row per bin."""
    binned = bin_probability(df, p, edges, "_bin")
    side = F.broadcast(curve.select(F.col("bin").alias("_bin"), F.col(value).alias("bayesian_fair_probability")))
    return binned.join(side, "_bin", "left").drop("_bin")


def mispricing(df: DataFrame, curve: DataFrame, p: str, value: str = "fair", edges: Sequence[float] = EDGES) -> DataFrame:
    priced = apply_curve(df, curve, p, value, edges)
    gap = F.col("bayesian_fair_probability") - F.col(p)
    return priced.withColumns({"mispricing": gap, "abs_mispricing": F.abs(gap)})


def brier_improvement(df: DataFrame, p: str, fair: str, y: str) -> DataFrame:
    """Both Brier scores and the improvement in percent."""
    scores = df.agg(
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier_market"), F.avg((F.col(fair) - F.col(y)) ** 2).alias("brier_fair")
    )
    return scores.withColumn("improvement_pct", ratio(F.col("brier_market") - F.col("brier_fair"), "brier_market") * 100)


def above_median(df: DataFrame, column: str, out: str) -> DataFrame:
    cut_at = medians(df, {"m": column}).select("m").scalar()
    return df.withColumn(out, F.col(column) > cut_at)


def efficient_label(df: DataFrame, column: str = "abs_surprise", out: str = "efficient_market") -> DataFrame:
    """1 where the surprise is at most the median."""
    flagged = above_median(df, column, "_high")
    return flagged.withColumn(out, (~F.col("_high")).cast("int")).drop("_high")


def median_split(df: DataFrame, by: str, y: str) -> DataFrame:
    """Mean and median of y in the low and the high half of ``by``."""
    halves = above_median(df, by, "high").filter(F.col("high").isNotNull())
    means = halves.groupBy("high").agg(F.count(y).alias("n"), F.avg(y).alias("mean"))
    return means.join(medians(halves, {"median": y}, ["high"]), "high")
