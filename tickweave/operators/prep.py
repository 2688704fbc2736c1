"""Feature preparation: everything is fit as one small row and applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import clip, ratio
from tickweave.plans.order_stats import medians, quantiles_wide
from tickweave.plans.series import index_rows, join_same, running
from tickweave.plans.spread import DRAWS, beside, hash_draw, hash_unit
from tickweave.session import cut


def _row(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """The one fitted row as a struct column ``_fit``."""
    return df.withColumn("_fit", fitted.select(F.struct("*").alias("f")).scalar())


def fit_impute(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return medians(train, {c: c for c in cols})


def apply_impute(df: DataFrame, fitted: DataFrame) -> DataFrame:
    cols = fitted.columns
    return _row(df, fitted).withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col("_fit")[c]) for c in cols}).drop("_fit")


def fill_defaults(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Fill NULLs per column with its "mean", "median" or "mode" (smallest value on ties)."""
    fitted = None
    means = [c for c, r in rules.items() if r == "mean"]
    mids = [c for c, r in rules.items() if r == "median"]
    parts = []
    if means:
        parts.append(df.agg(*[F.avg(c).alias(c) for c in means]))
    if mids:
        parts.append(medians(df, {c: c for c in mids}))
    for c in (c for c, r in rules.items() if r == "mode"):
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        top = counts.orderBy(F.desc("_n"), F.asc(c)).limit(1)
        parts.append(top.agg(F.max(c).alias(c)))
    for p in parts:
        fitted = p if fitted is None else beside(fitted, p)
    return _row(df, fitted).withColumns({c: F.coalesce(F.col(c), F.col("_fit")[c]) for c in rules}).drop("_fit")


def fit_scale(train: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    return train.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *[std(c).alias(f"std_{c}") for c in cols])


def standardise(df: DataFrame, cols: Sequence[str], fitted: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    """(x - mean) / std; a constant column becomes 0."""
    fitted = fitted if fitted is not None else fit_scale(df, cols, ddof)

    def scaled(c):
        gap = F.col(c) - F.col("_fit")[f"mean_{c}"]
        return F.when(F.col("_fit")[f"std_{c}"] == 0, gap).otherwise(ratio(gap, F.col("_fit")[f"std_{c}"]))

    return _row(df, fitted).withColumns({c: scaled(c) for c in cols}).drop("_fit")


def fit_minmax(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return train.agg(*[F.min(c).alias(f"min_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in cols])


def minmax(df: DataFrame, cols: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    fitted = fitted if fitted is not None else fit_minmax(df, cols)
    lo, hi = (lambda c: F.col("_fit")[f"min_{c}"]), (lambda c: F.col("_fit")[f"max_{c}"])
    return _row(df, fitted).withColumns({c: ratio(F.col(c) - lo(c), hi(c) - lo(c)) for c in cols}).drop("_fit")


def inverse_minmax(df: DataFrame, cols: Sequence[str], fitted: DataFrame) -> DataFrame:
    lo, hi = (lambda c: F.col("_fit")[f"min_{c}"]), (lambda c: F.col("_fit")[f"max_{c}"])
    return _row(df, fitted).withColumns({c: F.col(c) * (hi(c) - lo(c)) + lo(c) for c in cols}).drop("_fit")


def cap_quantiles(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99, log: bool = True) -> DataFrame:
    """Bound each column to its quantiles, then log(1 + x)."""
    fitted = quantiles_wide(df, {f"{side}_{c}": (c, q) for c in cols for side, q in (("lo", lo), ("hi", hi))})
    capped = {c: clip(c, F.col("_fit")[f"lo_{c}"], F.col("_fit")[f"hi_{c}"]) for c in cols}
    return _row(df, fitted).withColumns({c: F.log1p(x) if log else x for c, x in capped.items()}).drop("_fit")


def encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Integer codes in the sorted order of the labels, NULL for NULL.

    Labels are numbered where they are, by measured blocks of the distinct ones, and joined back; none reaches the driver.
    """
    labels = index_rows(df.select(F.col(column).alias("_label")).filter("_label IS NOT NULL").distinct(), [], ["_label"], pos="_code")
    return df.join(labels, F.col(column) == F.col("_label"), "left").withColumn(out, F.col("_code").cast("int")).drop("_label", "_code")


def threshold_flag(df: DataFrame, column: str, cut_at: float, out: str) -> DataFrame:
    return df.withColumn(out, (F.col(column) >= cut_at).cast("int"))


def group_split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 0, out: str = "is_train") -> DataFrame:
    """Random split by group: all rows of a key are on one side."""
    return df.withColumn(out, hash_unit(F.col(key), seed=seed) < frac)


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Fold number by shuffled position inside the class, so every fold has the class shares."""
    drawn = df.withColumn("_draw", hash_draw(F.col(row_id), seed=seed))
    ranked = index_rows(drawn, [label], ["_draw", row_id])
    return ranked.withColumn(out, F.pmod("_pos", F.lit(k)).cast("int")).drop("_pos", "_draw")


def stratified_split(df: DataFrame, label: str, row_id: str, frac: float = 0.7, seed: int = 0, out: str = "is_train") -> DataFrame:
    """The first ``frac`` of each class in hash order is train.

    Only the last train row of a class is looked for: hash draws are uniform, so it lies within a few standard deviations of ``frac``, and rows are
    ranked in that narrow range alone. One pass counts, one ranks, and every row compares itself with that row.
    A class of which the range misses it, or in which that row's id stands several times, is numbered row by row instead.
    """
    draw = hash_draw(F.col(row_id), seed=seed)
    drawn = df.withColumn("_draw", draw)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.floor(F.col("_n") * frac)
    share, gap = wanted / F.col("_n"), 8 * F.sqrt(F.lit(0.25) / F.col("_n"))
    # a row a class
    ends = cut(sizes.withColumn("_k", wanted).withColumns({"_low": ((share - gap) * float(DRAWS)).cast("bigint"), "_high": ((share + gap) * float(DRAWS)).cast("bigint")}))
    placed = join_same(drawn.select(label, row_id, "_draw"), F.broadcast(ends), [label])
    below = placed.groupBy(label).agg(F.count(F.when(F.col("_draw") < F.col("_low"), 1)).alias("_below"))
    near = placed.filter(F.col("_draw").between(F.col("_low"), F.col("_high"))).groupBy(label, "_draw", row_id, "_k").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(join_same(cut(near), F.broadcast(cut(below)), [label]), [label], ["_draw", row_id], {"_through": ("sum", "_c")})
    # so many rows of the range belong to train: the last of them is the row that completes the number
    place = F.col("_k") - F.col("_below")
    last = cut(ranked.filter((F.col("_through") >= place) & (F.col("_through") - F.col("_c") < place)).select(label, F.col("_draw").alias("_last"), F.col(row_id).alias("_last_id"), (F.col("_through") == place).alias("_whole")))
    found = join_same(ends.select(label, "_k"), last, [label])
    if not found.filter((F.col("_k") > 0) & ~F.coalesce("_whole", F.lit(False))).isEmpty():
        ranked = index_rows(drawn, [label], ["_draw", row_id], total="_n")
        return ranked.withColumn(out, F.col("_pos") < F.floor(F.col("_n") * frac)).drop("_pos", "_draw", "_n")
    # NULL ids come first in the order
    upto = (F.col("_draw") < F.col("_last")) | ((F.col("_draw") == F.col("_last")) & (F.col(row_id).isNull() | (F.col(row_id) <= F.col("_last_id"))))
    met = join_same(drawn, F.broadcast(last.drop("_whole")), [label])
    return met.withColumn(out, F.coalesce(upto, F.lit(False))).drop("_draw", "_last", "_last_id")
