"""Features of probability paths and of event activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio, safe_corr, seconds
from tickweave.plans.order_stats import quantiles_wide
from tickweave.plans.series import lagged, over_series, running
from tickweave.plans.spread import salted_join
from tickweave.session import cut

BINS = 10


def path_rows(paths: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "p", bounded: bool = False) -> DataFrame:
    """Per-row state of each path, valid for the whole path and for every prefix of it.

    pos, diff, prev_diff, peak, flip_zeros (sign change, zeros count as a sign)
    and flip (sign change, zeros left out).
    """

    def build(d, w):
        d = d.withColumn("diff", F.col(value) - F.lag(value).over(w))
        d = d.withColumn("prev_diff", F.lag("diff").over(w))
        return d.withColumn("flip_zeros", F.coalesce((F.signum("diff") != F.signum("prev_diff")).cast("int"), F.lit(0)))

    rows = over_series(paths, keys, order, build, before=2, bounded=bounded, keep_pos="pos")
    earlier_sign = F.when(F.col("prev_diff") != 0, F.signum("prev_diff"))
    rows = running(rows, keys, order, {"peak": ("max", value), "_sign": ("last", earlier_sign)}, bounded)
    turn = (F.col("diff") != 0) & (F.signum("diff") != F.col("_sign"))
    return rows.withColumn("flip", F.coalesce(turn.cast("int"), F.lit(0))).drop("_sign")


def _core(value: str) -> dict:
    p, d = F.col(value), F.col("diff")
    fall = F.when(F.col("peak") != 0, (F.col("peak") - p) / F.col("peak"))
    return {
        "n_obs": F.count(p),
        "probability_range": F.max(p) - F.min(p),
        "trend": F.regr_slope(p, F.col("pos").cast("double")),
        "max_drawdown": F.max(fall),
        "sum_sq": F.sum(d * d),
        "std_diff": F.stddev_samp(d),
        "flips_zeros": F.sum("flip_zeros"),
        "flips": F.sum("flip"),
        "n_up": F.count(F.when(d > 0, 1)),
        "n_down": F.count(F.when(d < 0, 1)),
    }


def _sign_entropy():
    n = (F.col("n_up") + F.col("n_down")).cast("double")

    def term(c):
        share = F.try_divide(F.col(c).cast("double"), n)
        return F.when(share > 0, -share * F.ln(share)).otherwise(0.0)

    return term("n_up") + term("n_down")


def histogram_entropy(rows: DataFrame, keys: Sequence[str], column: str, out: str = "entropy", bins: int = BINS) -> DataFrame:
    """Entropy (nats) over equal-width bins from min to max; NULL with fewer than 10 values."""
    seen = rows.filter(F.col(column).isNotNull()).select(*keys, column)
    bounds = seen.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    counts = salted_join(seen, bounds, list(keys), [column]).groupBy(*keys, slot.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    share = F.col("_c") / F.col("_n")
    return counts.groupBy(*keys).agg(F.when(F.max("_n") >= 10, F.sum(-share * F.ln(share))).alias(out))


def _pick(variant: str, prefix: str = "") -> dict:
    if variant == "a":
        chosen = {"realized_volatility": F.col("sum_sq"), "reversals": F.col("flips_zeros")}
    else:
        chosen = {"realized_volatility": F.coalesce("std_diff", F.lit(0.0)), "reversals": F.col("flips"), "entropy": _sign_entropy()}
    shared = {c: F.col(c) for c in ("probability_range", "trend", "max_drawdown")}
    return {f"{prefix}{k}": v for k, v in (shared | chosen).items()}


def trajectory_features(paths: DataFrame, keys: Sequence[str], order: Sequence[str], variant: str = "a", value: str = "p", bounded: bool = False) -> DataFrame:
    """Features of whole paths.

    "a": squared-change volatility, zeros count as a direction, histogram
    entropy, moments and autocorrelation. "b": standard-deviation volatility,
    zeros left out, entropy of the direction.
    """
    rows = path_rows(paths, keys, order, value, bounded)
    if variant == "b":
        return rows.groupBy(*keys).agg(*[e.alias(k) for k, e in _core(value).items()]).select(*keys, "n_obs", *[e.alias(k) for k, e in _pick("b").items()])
    rows = cut(rows.select(*keys, value, "pos", "diff", "prev_diff", "peak", "flip_zeros", "flip"))
    extra = {
        "skewness": F.skewness("diff"),
        "kurtosis": F.kurtosis("diff"),
        "autocorrelation": F.when(F.count("diff") >= 10, safe_corr("diff", "prev_diff")),
    }
    agg = rows.groupBy(*keys).agg(*[e.alias(k) for k, e in (_core(value) | extra).items()])
    main = agg.select(*keys, "n_obs", *[e.alias(k) for k, e in _pick("a").items()], *extra)
    return main.join(histogram_entropy(rows, keys, "diff", "shannon_entropy"), list(keys), "left")


def early_features(paths: DataFrame, horizons: Sequence[float], variant: str, keys: Sequence[str], order: Sequence[str], value: str = "p", bounded: bool = False) -> DataFrame:
    """Features of the first part of each path for several horizons at once.

    All per-row state holds for prefixes too, so the path is walked once and
    only the aggregation runs per horizon.
    """
    rows = path_rows(paths, keys, order, value, bounded)
    n = paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cutoff = F.col("_n") * F.col("horizon")
    cutoff = F.greatest(F.floor(cutoff), F.lit(5)) if variant == "a" else F.greatest(F.ceil(cutoff), F.lit(2))
    part = (
        salted_join(rows, n, list(keys), ["pos"])
        .withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
        .filter(F.col("pos") < cutoff)
    )
    group = [*keys, "horizon"]
    if variant == "a":
        part = cut(part.select(*group, *[c for c in (value, "pos", "diff", "peak", "flip_zeros", "flip")]))
        agg = part.groupBy(*group).agg(*[e.alias(k) for k, e in _core(value).items()])
        main = agg.select(*group, *[e.alias(k) for k, e in _pick("a", "early_").items()])
        return main.join(histogram_entropy(part, group, "diff", "early_entropy"), group, "left")
    at = F.struct("pos")
    p = F.col(value)
    edge = F.least(p, 1 - p)
    levels = {
        "early_first_probability": F.min_by(p, at),
        "early_last_probability": F.max_by(p, at),
        "early_mean_probability": F.avg(p),
        "early_std_probability": F.stddev_samp(p),
        "early_distance_to_boundary": F.max_by(edge, at),
        "early_mean_distance_to_boundary": F.avg(edge),
        "early_min_distance_to_boundary": F.min(edge),
    }
    agg = part.groupBy(*group).agg(*[e.alias(k) for k, e in (_core(value) | levels).items()])
    last = F.col("early_last_probability")
    near = ((last <= 0.05) | (last >= 0.95)).cast("int").alias("early_near_boundary")
    return agg.select(*group, F.col("n_obs").alias("early_n_obs"), *levels, near, *[e.alias(k) for k, e in _pick("b", "early_").items()])


# fixed values: quantiles of the inter-event time kept per trader
ACTIVITY_QS = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def activity_stats(events: DataFrame, key: str, ts: str, order: Sequence[str]) -> DataFrame:
    """Inter-event times and activity per second of each trader."""
    prev = lagged(events.select(key, *order), [key], order, {"_prev": (ts, 1)})
    gaps = prev.select(key, (seconds(ts) - seconds("_prev")).alias("gap"))
    basics = gaps.groupBy(key).agg(F.min("gap").alias("min_gap"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    marks = quantiles_wide(gaps, {f"{n}_gap": ("gap", q) for n, q in ACTIVITY_QS.items()}, [key])
    per_second = events.groupBy(key, F.date_trunc("second", ts).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    busy = per_second.groupBy(key).agg(
        F.max("_c").alias("max_per_second"), ratio(F.sum("_c"), F.count("_c")).alias("mean_per_second"), F.count("_c").alias("active_seconds")
    )
    return basics.join(marks, key, "left").join(busy, key, "left")
