"""Fit-on-train transforms of return panels, quantile buckets, clip audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.panel import clean
from tickweave.functions.scalars import clip, ratio
from tickweave.plans.order_stats import quantiles, quantiles_long
from tickweave.plans.spread import beside


def long_panel(df: DataFrame, arr: str, ids: Sequence[str] = ()) -> DataFrame:
    """One row per id and interval; missing values are kept as NULL."""
    return df.select(*ids, F.posexplode(clean(arr)).alias("interval", "value"))


def fit_intervals(train: DataFrame, arr: str, qs: dict[str, float]) -> DataFrame:
    """One row with an array per quantile, one element per interval (53 at most)."""
    cells = long_panel(train, arr).filter(F.col("value").isNotNull()).withColumnRenamed("interval", "column")
    marks = quantiles_long(cells, sorted(set(qs.values())))

    def as_array(q):
        points = F.array_sort(F.collect_list(F.when(F.col("q") == float(q), F.struct("column", "value"))))
        return F.transform(points, lambda e: e["value"])

    return marks.agg(*[as_array(q).alias(name) for name, q in qs.items()])


def fit_winsor(train: DataFrame, arr: str, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    return fit_intervals(train, arr, {"lo": lo, "hi": hi})


def apply_winsor(df: DataFrame, arr: str, bounds: DataFrame) -> DataFrame:
    """Clip each interval to the bounds learnt on train; NULL stays NULL."""
    with_bounds = beside(df.withColumn("_x", clean(arr)), bounds, {"_lo": "lo", "_hi": "hi"})
    pairs = F.arrays_zip("_x", "_lo", "_hi")
    clipped = with_bounds.withColumn(arr, F.transform(pairs, lambda e: clip(e["_x"], e["_lo"], e["_hi"])))
    return clipped.drop("_x", "_lo", "_hi")


def fit_robust(train: DataFrame, arr: str) -> DataFrame:
    """Median and inter-quartile range per interval."""
    q = fit_intervals(train, arr, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return q.withColumn("iqr", F.zip_with("q75", "q25", lambda a, b: a - b))


def scale_robust(df: DataFrame, arr: str, params: DataFrame, out: str | None = None) -> DataFrame:
    """(x - median) / IQR per interval, missing kept."""
    with_params = beside(df.withColumn("_x", clean(arr)), params, {"_m": "median", "_s": "iqr"})
    scaled = F.transform(F.arrays_zip("_x", "_m", "_s"), lambda e: ratio(e["_x"] - e["_m"], e["_s"]))
    return with_params.withColumn(out or arr, scaled).drop("_x", "_m", "_s")


def apply_robust(df: DataFrame, arr: str, params: DataFrame, limit: float = 20.0) -> DataFrame:
    """Robust scaling, clipping to ±limit, missing → 0."""
    scaled = scale_robust(df, arr, params)
    return scaled.withColumn(arr, F.transform(arr, lambda x: F.coalesce(clip(x, -limit, limit), F.lit(0.0))))


def clip_audit(before: DataFrame, arr: str, limit: float = 20.0) -> DataFrame:
    """Number and share of cells outside ±limit, largest size before and after clipping."""
    x = F.abs("value")
    over = F.count(F.when(x > limit, 1))
    return long_panel(before, arr).agg(
        F.count("value").alias("n_values"),
        over.alias("n_clipped"),
        ratio(over * 100, F.count("value")).alias("pct_clipped"),
        F.max(x).alias("max_before"),
        F.least(F.max(x), F.lit(float(limit))).alias("max_after"),
    )


def extreme_concentration(df: DataFrame, arr: str, ids: Sequence[str], q: float = 0.999) -> DataFrame:
    """Share of the distinct ids touched by returns whose size exceeds the q-quantile."""
    cells = long_panel(df, arr, ids).withColumn("size", F.abs("value"))
    threshold = quantiles(cells, ["size"], [q]).select("value").scalar()
    extreme = cells.filter(F.col("size") > threshold)
    everyone = df.agg(*[F.countDistinct(c).alias(f"_{c}") for c in ids])
    touched = extreme.agg(F.count(F.lit(1)).alias("n_extreme"), *[F.countDistinct(c).alias(c) for c in ids])
    both = beside(touched, everyone)
    return both.select("n_extreme", *[ratio(F.col(c) * 100, F.col(f"_{c}")).alias(f"pct_{c}") for c in ids])


def extremes_by(df: DataFrame, arr: str, ids: Sequence[str], by: str, q: float = 0.999) -> DataFrame:
    cells = long_panel(df, arr, ids).withColumn("size", F.abs("value"))
    threshold = quantiles(cells, ["size"], [q]).select("value").scalar()
    return cells.groupBy(by).agg(F.count(F.when(F.col("size") > threshold, 1)).alias("n_extreme"))


def fit_edges(train: DataFrame, column: str, qs: Sequence[float]) -> Column:
    """Sorted distinct quantile edges as a scalar array."""
    marks = quantiles(train, [column], qs)
    return marks.agg(F.array_sort(F.array_distinct(F.collect_list("value"))).alias("edges")).scalar()


def bucket(df: DataFrame, column: str, edges: Column, out: str, open_ends: bool = False) -> DataFrame:
    """Right-closed bucket index: number of edges below the value.

    Closed form (like a quantile cut of the same data) leaves values outside the
    edges NULL; with ``open_ends`` the outer edges count as infinite.
    """
    df = df.withColumn("_edges", edges)
    x = F.col(column)
    below = F.size(F.filter("_edges", lambda e: e < x))
    k = F.size("_edges")
    if open_ends:
        index = F.greatest(F.least(below - 1, k - 2), F.lit(0))
        return df.withColumn(out, F.when(x.isNotNull(), index)).drop("_edges")
    inside = x.between(F.array_min("_edges"), F.array_max("_edges"))
    return df.withColumn(out, F.when(inside, F.greatest(below - 1, F.lit(0)))).drop("_edges")


def surface(df: DataFrame, bx: str, by: str, y: Column, values: Sequence[int]) -> DataFrame:
    """Mean of y over two bucket columns, the second one across."""
    return df.groupBy(bx).agg(*[F.avg(F.when(F.col(by) == v, y)).alias(f"{by}_{v}") for v in values])
