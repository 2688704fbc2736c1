"""Exact quantiles and ranks that stay distributed for hot groups.

Equal values merge first, by an aggregate that combines before its shuffle; all that follows sees each distinct value of a group
once, with its count. The rank of a value is then a running sum of counts in value order. Groups of up to a block of
rows are one window each. Longer ones go through the measured blocks of ``plans.series``: a histogram over the bit pattern of the
values, whose heavy cells are cut again, between their own ends, until they are small, so that neither narrow ranges nor
heavy tails fill a task. No group is gathered in one task and results are exact.

Quantiles of a longer group need no ranks of all its values: a sketch gives two values that each wanted rank lies between, a pass counts the
rows below the first, and only values in between are ranked. The counts show whether a rank lies there; if one does not, all values are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.plans.series import BLOCK, join_same, running
from tickweave.session import cut

#: Parts of a group that a sketch tells apart, and how many of them a wanted rank may lie to either side.
SKETCH, MARGIN = 10_000, 3


def _numbers(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    long = df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.column", "_cell.value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _small(rows: DataFrame, group: Sequence[str], block: int) -> bool:
    """Whether no group has more than ``block`` rows, and so no more distinct values."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).isEmpty()


def _upto(counts: DataFrame, group: Sequence[str], n: str, small: bool, block: int) -> DataFrame:
    """``_through``: rows of the group with this value or a smaller one; ``_all``: rows of the group."""
    out = running(counts, group, ["value"], {"_through": ("sum", n)}, bounded=small, block=block)
    if small:
        return out.withColumn("_all", F.sum(n).over(W.partitionBy(*group)))
    return join_same(out, counts.groupBy(*group).agg(F.sum(n).alias("_all")), group)


def _picked(ranked: DataFrame, group: Sequence[str], qs: Sequence[float], of: Column | None = None) -> DataFrame:
    """(group, q, value) from values with ``_c``, ``_through`` and ``_all``; with ``of``, a row serves that quantile alone."""
    # the two ranks that each q lies between, where this value holds one of them
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    holds = lambda k: (k >= F.col("_through") - F.col("_c")) & (k < F.col("_through"))
    mine = lambda q: F.lit(True) if of is None else of == F.lit(float(q))
    each = [F.struct(F.lit(float(q)).alias("q"), (place(q) - F.floor(place(q))).alias("_frac"), (mine(q) & holds(F.floor(place(q)))).alias("_low"), (mine(q) & holds(F.ceil(place(q)))).alias("_high")) for q in dict.fromkeys(qs)]
    found = ranked.select(*group, "value", F.inline(F.filter(F.array(*each), lambda x: x["_low"] | x["_high"])))
    low, high = F.max(F.when(F.col("_low"), F.col("value"))), F.max(F.when(F.col("_high"), F.col("value")))
    # the second part is 0 for a rank that is a row's own, whatever the values
    between = F.when(F.max("_frac") == 0, low).otherwise(low + (high - low) * F.max("_frac"))
    return found.groupBy(*group, "q").agg(between.alias("value"), ((F.count(F.when(F.col("_low"), 1)) > 0) & (F.count(F.when(F.col("_high"), 1)) > 0)).alias("_both"))


def _all_ranked(long: DataFrame, group: Sequence[str], qs: Sequence[float], small: bool, block: int) -> DataFrame:
    counts = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_c"))
    return _picked(_upto(counts, group, "_c", small, block), group, qs).drop("_both")


def _bracketed(long: DataFrame, group: Sequence[str], qs: Sequence[float], sizes: DataFrame, block: int) -> DataFrame:
    """(group, q, value, _both) of the groups in ``sizes`` (group, _all), each longer than a block, so few enough to broadcast."""
    qs = list(dict.fromkeys(float(q) for q in qs))
    rows = join_same(long, F.broadcast(sizes), group, "inner")
    # the sketch errs by one of SKETCH parts of the rows
    near = [min(max(q + step, 0.0), 1.0) for step in (-MARGIN / SKETCH, MARGIN / SKETCH) for q in qs]
    marks = F.percentile_approx("value", F.array(*[F.lit(q) for q in near]), F.lit(SKETCH))
    ends = rows.groupBy(*group, "_all").agg(marks.alias("_marks"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    side = {}
    for i, q in enumerate(qs):
        side[f"_lo{i}"] = F.col("_min") if q <= MARGIN / SKETCH else F.col("_marks")[i]
        side[f"_hi{i}"] = F.col("_max") if q >= 1 - MARGIN / SKETCH else F.col("_marks")[len(qs) + i]
    ends = cut(ends.select(*group, "_all", *[x.alias(n) for n, x in side.items()]))
    placed = join_same(long, F.broadcast(ends), group, "inner")
    v, inside = F.col("value"), [F.col("value").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(qs))]
    below = placed.groupBy(*group).agg(F.array(*[F.count(F.when(v < F.col(f"_lo{i}"), 1)) for i in range(len(qs))]).alias("_below"))
    near = placed.filter(reduce(lambda a, b: a | b, inside)).groupBy(*group, "_all", "value").agg(F.count(F.lit(1)).alias("_c"), *[F.first(x).alias(f"_in{i}") for i, x in enumerate(inside)])
    cells = F.array(*[F.when(F.col(f"_in{i}"), F.struct(F.lit(q).alias("_q"), F.lit(i).alias("_i"))) for i, q in enumerate(qs)])
    near = cut(near.select(*group, "_all", "value", "_c", F.inline(F.array_compact(cells))))
    ranked = join_same(running(near, [*group, "_q"], ["value"], {"_upto": ("sum", "_c")}, block=block), F.broadcast(cut(below)), group)
    return _picked(ranked.withColumn("_through", F.col("_upto") + F.col("_below")[F.col("_i")]), group, qs, F.col("_q"))


def quantiles_long(long: DataFrame, qs: Sequence[float], keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(keys, column, value) rows → (keys, column, q, value), linear interpolation."""
    group = [*keys, "column"]
    sizes = long.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    if sizes.filter(F.col("_all") > block).isEmpty():
        return _all_ranked(long, group, qs, True, block)
    sizes = cut(sizes)
    hot = sizes.filter(F.col("_all") > block)
    found = cut(_bracketed(long, group, qs, hot, block))
    if found.filter("_both").count() < hot.count() * len(dict.fromkeys(qs)):
        return _all_ranked(long, group, qs, False, block)
    out = found.drop("_both")
    if sizes.filter(F.col("_all") <= block).isEmpty():
        return out
    rest = join_same(long, F.broadcast(hot.withColumn("_hot", F.lit(1)).drop("_all")), group).filter("_hot IS NULL").drop("_hot")
    return out.unionByName(_all_ranked(rest, group, qs, True, block))


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of several columns in long form (keys, column, q, value)."""
    return quantiles_long(_numbers(df, cols, keys), qs, keys)


def quantiles_wide(
    df: DataFrame, wanted: dict[str, tuple[str, float]], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per group: {alias: (column, q)}."""
    cols = sorted({c for c, _ in wanted.values()})
    qs = sorted({float(q) for _, q in wanted.values()})
    long = quantiles(df, cols, qs, keys)
    picks = [
        F.max(F.when((F.col("column") == c) & (F.col("q") == float(q)), F.col("value"))).alias(a)
        for a, (c, q) in wanted.items()
    ]
    return long.groupBy(*keys).agg(*picks)


def medians(df: DataFrame, cols: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """{alias: column} medians, one row per group."""
    return quantiles_wide(df, {a: (c, 0.5) for a, c in cols.items()}, keys)


def value_ranks(df: DataFrame, column: str, keys: Sequence[str] = (), extra: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per distinct value: ties ``n``, average rank ``rank``, extra aggregates."""
    keys = list(keys)
    value = F.col(column).cast("double")
    rows = df.filter(F.col(column).isNotNull() & ~F.isnan(value))
    counts = rows.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), *[a.alias(k) for k, a in (extra or {}).items()])
    out = running(counts, keys, ["value"], {"_through": ("sum", "n")}, bounded=_small(rows, keys, block), block=block)
    return out.withColumn("rank", F.col("_through") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).drop("_through")
