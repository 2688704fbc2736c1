"""Trajectory features of a return panel held as an array column (NULL = missing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import nan_to_null, ratio

# windows of the 53 five-minute returns (fixed values)
EARLY, MIDDLE, LATE = (0, 18), (18, 18), (36, 17)
FIRST_HALF, SECOND_HALF = (0, 26), (26, 27)
INTERVALS = 53


def clean(arr: Column | str) -> Column:
    """NaN elements to NULL."""
    return F.transform(arr, lambda x: nan_to_null(x.cast("double")))


def part(arr: Column | str, window: tuple[int, int]) -> Column:
    return F.slice(arr, window[0] + 1, window[1])


def observed(arr: Column | str) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def total(arr: Column | str, f=lambda x: x) -> Column:
    """Sum of f over observed elements; nothing observed → 0."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(f(x), F.lit(0.0)))


def share_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def missingness(df: DataFrame, arr: str) -> DataFrame:
    n = F.size(observed(arr))
    return df.withColumns({"n_obs": n, "missing_count": F.size(arr) - n}).withColumn(
        "missing_share", F.col("missing_count") / F.size(arr)
    )


def path_features(df: DataFrame, arr: str) -> DataFrame:
    """Displacement, volatility, efficiency, sign persistence and asymmetry of each path."""
    r = F.col(arr)
    sq = lambda x: x * x
    df = df.withColumns(
        {
            "n_obs": F.size(observed(r)),
            "path_return_bps": total(r),
            "return_early_bps": total(part(r, EARLY)),
            "return_middle_bps": total(part(r, MIDDLE)),
            "return_late_bps": total(part(r, LATE)),
            "_sq": total(r, sq),
            "_abs": total(r, F.abs),
            "_first": total(part(r, FIRST_HALF), F.abs),
            "_second": total(part(r, SECOND_HALF), F.abs),
        }
    )
    n, path, energy = F.col("n_obs"), F.col("path_return_bps"), F.col("_sq")
    same = F.size(F.filter(observed(r), lambda x: F.signum(x) == F.signum(path)))
    both = F.col("_first") + F.col("_second")
    return df.withColumns(
        {
            "abs_path_return_bps": F.abs(path),
            "early_late_change_bps": F.col("return_late_bps") - F.col("return_early_bps"),
            "realized_vol_bps": F.sqrt(energy),
            "adjusted_vol_bps": F.sqrt(ratio(F.lit(float(INTERVALS)), n) * energy),
            "path_efficiency": share_or_zero(F.abs(path), F.col("_abs")),
            "early_vol_share": share_or_zero(total(part(r, EARLY), sq), energy),
            "late_vol_share": share_or_zero(total(part(r, LATE), sq), energy),
            "vol_concentration": share_or_zero(F.array_max(F.transform(r, sq)), energy),
            "sign_persistence": F.when(n > 0, same / n),
            "path_asymmetry": F.when(both > 0, (F.col("_second") - F.col("_first")) / both),
        }
    ).drop("_sq", "_abs", "_first", "_second")


def compounded_return_bps(arr: Column | str) -> Column:
    """(∏(1+r/10⁴) - 1)·10⁴ for complete paths, NULL where a return is missing."""
    grown = F.aggregate(arr, F.lit(1.0), lambda acc, x: acc * (1 + x / 10_000))
    return (grown - 1) * 10_000


def _signs(arr: Column | str) -> Column:
    return F.filter(F.transform(observed(arr), lambda x: F.signum(x)), lambda s: s != 0)


def count_reversals(arr: Column | str) -> Column:
    """Sign changes with zero returns left out."""
    s = _signs(arr)
    n = F.size(s)
    flips = F.zip_with(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    return F.when(n < 2, 0).otherwise(F.aggregate(flips, F.lit(0), lambda acc, x: acc + x))


def reversal_intensity(arr: Column | str) -> Column:
    """Reversals per possible reversal; NULL with fewer than two signs."""
    n = F.size(_signs(arr))
    return F.when(n >= 2, count_reversals(arr) / (n - 1))


def sign_share(arr: Column | str, positive: bool = True) -> Column:
    seen = observed(arr)
    hits = F.filter(seen, (lambda x: x > 0) if positive else (lambda x: x < 0))
    return ratio(F.size(hits), F.size(seen))


# fixed values: labels of the early → late direction
TRANSITIONS = {(-1, -1): "Neg → Neg", (-1, 1): "Neg → Pos", (1, -1): "Pos → Neg", (1, 1): "Pos → Pos"}
NO_DIRECTION = "Con cero"


def path_transition(early: Column | str, late: Column | str) -> Column:
    """Label of the early → late direction; a zero on either side has its own label."""
    key = F.concat_ws("/", *[F.signum(c).cast("int").cast("string") for c in (early, late)])
    table = F.create_map(*[F.lit(x) for (e, l), v in TRANSITIONS.items() for x in (f"{e}/{l}", v)])
    return F.coalesce(F.try_element_at(table, key), F.lit(NO_DIRECTION))


def late_momentum_consistency(arr: Column | str) -> Column:
    """Share of observed late returns with the sign of the late sum."""
    late = part(arr, LATE)
    seen = observed(late)
    direction = F.signum(total(late))
    return ratio(F.size(F.filter(seen, lambda x: F.signum(x) == direction)), F.size(seen))


def late_trend(arr: Column | str) -> Column:
    """Slope of the running sum over observed late returns; NULL with fewer than two."""
    seen = observed(part(arr, LATE))
    n = F.size(seen).cast("double")
    # the j-th return enters the sums y_j .. y_{n-1}: closed forms for Σy and Σj·y
    weighted = F.zip_with(seen, F.sequence(F.lit(0), F.greatest(F.size(seen), F.lit(1)) - 1), lambda x, j: F.struct(x.alias("x"), j.cast("double").alias("j")))
    sum_y = F.aggregate(weighted, F.lit(0.0), lambda acc, e: acc + e["x"] * (n - e["j"]))
    sum_ty = F.aggregate(weighted, F.lit(0.0), lambda acc, e: acc + e["x"] * (n * (n - 1) - e["j"] * (e["j"] - 1)) / 2)
    sum_t, sum_tt = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    return F.when(n >= 2, (n * sum_ty - sum_t * sum_y) / (n * sum_tt - sum_t * sum_t))
