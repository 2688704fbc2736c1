"""Pair statistics: rolling correlation per day, lead-lag scores, the daily universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.scalars import corr_from_moments, safe_corr
from tickweave.operators.joins import assign_roles, shift_to_next_day
from tickweave.operators.select import top_n_per
from tickweave.plans.series import over_series
from tickweave.session import cut

PAIR = ("stock_a", "stock_b")


def rolling_corr(aligned: DataFrame, window: int, keys: Sequence[str] = PAIR, ts: str = "ts", x: str = "x_a", y: str = "x_b", bounded: bool = False) -> DataFrame:
    """Correlation over the last ``window`` joined rows, NULL until the window is full.

    Linear work for windows of any length: series are cut into chunks of ``window`` rows, so a window is the end of one chunk
    and the start of the next. Sums grow inside a chunk about the chunk's own mean; what a window
    leaves out of the chunk before is subtracted there, and the two parts are brought to one centre. No sum
    reaches further than two windows, however long the series, so differences stay exact.
    """
    rows = aligned.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    full = float(window)

    def build(d, w):
        grow = w.rowsBetween(W.unboundedPreceding, 0)
        # changes of either side up to each row: none inside a window means a constant side
        turns = {f"_turn_{c}": F.coalesce((F.col(c) != F.lag(c).over(w)).cast("int"), F.lit(0)) for c in (x, y)}
        d = d.withColumns(turns).withColumns({t: F.sum(t).over(grow) for t in turns})
        varies = [F.col(t) > F.coalesce(F.lag(t, window - 1).over(w), F.lit(0)) for t in turns]
        d = d.withColumns({"_varies": varies[0] & varies[1], "_part": F.floor(F.col("_pos") / window)})
        part = W.partitionBy(*keys, "_block", "_part")
        inside = part.orderBy(ts)
        # the same order as w, sorted as the parts are
        along = W.partitionBy(*keys, "_block").orderBy("_part", ts)
        d = d.withColumns({"_mx": F.avg(x).over(part), "_my": F.avg(y).over(part)})
        d = d.withColumns({"_x": F.col(x) - F.col("_mx"), "_y": F.col(y) - F.col("_my")})
        terms = {"sx": F.col("_x"), "sy": F.col("_y"), "sxx": F.col("_x") ** 2, "syy": F.col("_y") ** 2, "sxy": F.col("_x") * F.col("_y")}
        d = d.withColumns({f"_{k}": F.sum(e).over(inside.rowsBetween(W.unboundedPreceding, 0)) for k, e in terms.items()})
        # the whole part before: what its last row has come to, known to the first row of this one
        kept = [f"_{k}" for k in terms] + ["_mx", "_my"]
        d = d.withColumns({f"_l{k}": F.lag(k).over(along) for k in kept}).withColumns({f"_l{k}": F.first(f"_l{k}").over(inside) for k in kept})
        sx, sy, sxx, syy, sxy = [F.col(f"_l_{k}") - F.coalesce(F.lag(f"_{k}", window).over(along), F.lit(0.0)) for k in terms]
        n = full - 1 - (F.col("_pos") % window)
        dx, dy = F.col("_l_mx") - F.col("_mx"), F.col("_l_my") - F.col("_my")
        moved = [sx + n * dx, sy + n * dy, sxx + 2 * dx * sx + n * dx * dx, syy + 2 * dy * sy + n * dy * dy, sxy + dx * sy + dy * sx + n * dx * dy]
        sums = [F.col(f"_{k}") + F.when(n > 0, m).otherwise(0.0) for k, m in zip(terms, moved, strict=True)]
        d = d.withColumn("_corr", corr_from_moments(F.lit(full), *sums))
        known = F.when((F.col("_pos") >= window - 1) & F.col("_varies"), F.col("_corr"))
        return d.withColumn("rolling_corr", known).drop("_x", "_y", "_corr", "_varies", "_part", *turns, *kept, *[f"_l{k}" for k in kept])

    return over_series(rows, keys, [ts], build, before=window, bounded=bounded)


def rolling_corr_daily(aligned: DataFrame, window: int, keys: Sequence[str] = PAIR, ts: str = "ts", bounded: bool = False) -> DataFrame:
    """The last rolling correlation of each day."""
    rolled = rolling_corr(aligned, window, keys, ts, bounded=bounded)
    return rolled.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by("rolling_corr", ts).alias("rolling_corr"))


def daily_universe(aligned: DataFrame, pairs: DataFrame, universe: DataFrame, window: int, top: int = 50, bounded: bool = False) -> DataFrame:
    """Tradable pairs per day: correlation known the day before, roles by size, best ``top`` per day."""
    # read for its rows and for its days
    daily = cut(rolling_corr_daily(aligned, window, bounded=bounded))
    shifted = shift_to_next_day(daily, "day", "trading_day").filter(F.col("rolling_corr").isNotNull())
    roles = assign_roles(pairs, universe)
    order = [F.col("rolling_corr").desc(), F.col("stock_a"), F.col("stock_b")]
    return top_n_per(shifted.join(roles, list(PAIR)), ["trading_day"], order, top)


def lead_lag(aligned: DataFrame, lags: Sequence[int] = (1, 5, 15, 30), keys: Sequence[str] = PAIR, ts: str = "ts", x: str = "x_a", y: str = "x_b", bounded: bool = False) -> DataFrame:
    """Per pair and lag: corr(a[t], b[t+k]), corr(b[t], a[t+k]), their difference, the leader."""

    def build(d, w):
        cols = {f"_y{k}": F.lead(y, k).over(w) for k in lags}
        cols |= {f"_x{k}": F.lead(x, k).over(w) for k in lags}
        return d.withColumns(cols)

    rows = aligned.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ahead = over_series(rows, keys, [ts], build, after=max(lags), bounded=bounded)
    stats = [
        F.struct(
            F.lit(k).alias("lag"),
            safe_corr(x, f"_y{k}").alias("forward"),
            safe_corr(y, f"_x{k}").alias("reverse"),
        )
        for k in lags
    ]
    long = ahead.groupBy(*keys).agg(F.array(*stats).alias("_s")).select(*keys, F.inline("_s"))
    score = F.col("forward") - F.col("reverse")
    return long.withColumns(
        {"lead_score": score, "leader": F.when(score > 0, F.col(keys[0])).when(score.isNotNull(), F.col(keys[1]))}
    )
