"""Filters, projections, tagging and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import contains_any, finite
from tickweave.plans.spread import one_of

# --- filters ---------------------------------------------------------------


def session_filter(df: DataFrame, start: str = "09:30", end: str = "16:00", ts: str = "ts") -> DataFrame:
    """Keep rows whose time of day lies in [start, end], both ends included."""
    clock = F.date_format(F.col(ts), "HH:mm:ss.SSSSSS")
    return df.filter(clock.between(f"{start}:00.000000", f"{end}:00.000000"))


def date_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def exclude_periods(df: DataFrame, periods: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Drop rows of listed symbols with start ≤ ts ≤ midnight of the end day.

    ``periods`` has start, end (dates) and symbols (array). Bars after midnight
    of the end day stay, as in the source of these rules.
    """
    kind = df.schema[ts].dataType
    ban = periods.select(
        F.col("start").cast(kind).alias("_from"), F.col("end").cast(kind).alias("_to"), F.explode("symbols").alias("_symbol")
    )
    hit = (df[symbol] == F.col("_symbol")) & df[ts].between(F.col("_from"), F.col("_to"))
    return df.join(ban, hit, "left_anti")


def keyword_filter(df: DataFrame, cols: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Rows whose joined, lower-cased text holds any of the words."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols if c in df.columns]
    return df.filter(contains_any(F.lower(F.concat_ws(" ", *present)), words))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in the subset."""
    return df.dropna(subset=list(subset) if subset else None)


def tradable(df: DataFrame, max_spread=0.05, min_depth=100, min_mid=0.05, max_mid=0.95) -> DataFrame:
    d = lambda v: F.lit(str(v)).cast("decimal(18,6)")
    return df.filter(
        (F.col("spread") <= d(max_spread))
        & (F.col("depth") >= d(min_depth))
        & F.col("mid_price").between(d(min_mid), d(max_mid))
    )


def trailing(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows within ``interval`` of the latest timestamp."""
    latest = df.select(F.max(ts).alias("latest")).scalar()
    return df.filter(F.col(ts) >= latest - F.expr(f"INTERVAL {interval}"))


def trailing_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


# --- projections -------------------------------------------------------------


def project_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def _lookup(mapping: dict, key: str) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(key))


def override(df: DataFrame, key: str, column: str, mapping: dict) -> DataFrame:
    """Replace ``column`` for the listed keys."""
    return df.withColumn(column, F.coalesce(_lookup(mapping, key), F.col(column)))


def tag(df: DataFrame, key: str, mapping: dict, out: str) -> DataFrame:
    """Dictionary tag; unlisted keys get NULL."""
    return df.withColumn(out, _lookup(mapping, key))


def book_flags(df: DataFrame) -> DataFrame:
    bid, ask = F.col("best_bid"), F.col("best_ask")
    both = bid.isNotNull() & ask.isNotNull()
    return df.withColumns(
        {
            "is_valid": both & F.coalesce(ask - bid > 0, F.lit(False)),
            "is_crossed": both & F.coalesce(bid >= ask, F.lit(False)),
        }
    )


def in_bounds(df: DataFrame, column: str, lo: float = 0.0, hi: float = 1.0, out: str = "in_bounds") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(column).between(lo, hi), F.lit(False)))


# --- order and top-k -----------------------------------------------------------


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key; Spark limits each group before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def argmax_row(df: DataFrame, column: str, tie: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The row with the largest value; ties go to the smallest ``tie`` columns."""
    # one row per key and value first, the one of the smallest ties (of any type), then the largest value
    rest = [c for c in df.columns if c not in keys]
    first = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_best")).agg(F.min_by(F.struct(*rest), F.struct(*tie) if tie else F.lit(0)).alias("_r"))
    return first.groupBy(*keys).agg(F.max_by("_r", "_best").alias("_r")).select(*keys, "_r.*")


def keep_top_categories(df: DataFrame, column: str, n: int, other: str = "otro") -> DataFrame:
    """The n most frequent values stay, every other value becomes ``other``."""
    counts = df.groupBy(column).count()
    kept = counts.orderBy(F.desc("count"), F.asc(column)).limit(n)
    # n rows at most
    marked = F.broadcast(kept.select(F.col(column).alias("_kept")))
    joined = df.join(marked, df[column] == F.col("_kept"), "left")
    return joined.withColumn(column, F.coalesce("_kept", F.lit(other))).drop("_kept")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return one_of(df, keys, order, last=True)


# --- set operations and shape ---------------------------------------------------


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    return one_of(df, keys, order, last=keep == "last")


def key_overlap(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per key column: distinct values in a, in b and in both. One aggregate per column."""
    from functools import reduce

    def one(c):
        sides = a.select(F.col(c).cast("string").alias("v"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
            b.select(F.col(c).cast("string").alias("v"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
        )
        seen = sides.groupBy("v").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
        return seen.agg(
            F.lit(c).alias("key"),
            F.sum("in_a").alias("n_a"),
            F.sum("in_b").alias("n_b"),
            F.sum(F.col("in_a") * F.col("in_b")).alias("n_both"),
        )

    return reduce(lambda x, y: x.unionByName(y), [one(c) for c in cols])


def same_keys(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: do both frames hold the same keys, equally often."""
    x = a.select(column)
    y = b.select(column)
    tagged = x.withColumn("_d", F.lit(1)).unionByName(y.withColumn("_d", F.lit(-1)))
    per_key = tagged.groupBy(column).agg(F.sum("_d").alias("_d"))
    return per_key.agg(
        F.coalesce(F.max(F.abs("_d")), F.lit(0)).cast("bigint").alias("max_difference"),
        (F.coalesce(F.max(F.abs("_d")), F.lit(0)) == 0).alias("same"),
    )


def same_order(a: DataFrame, b: DataFrame, column: str, order: Sequence[str], order_b: Sequence[str] | None = None) -> DataFrame:
    """One row: number of positions at which the ordered key columns differ; ``order_b`` is b's own order, if it has another."""
    from tickweave.plans.series import index_rows

    x = index_rows(a, [], order).select("_pos", F.col(column).alias("_x"))
    y = index_rows(b, [], order_b or order).select("_pos", F.col(column).alias("_y"))
    differs = x.join(y, "_pos", "full_outer").filter(~F.col("_x").eqNullSafe(F.col("_y")))
    return differs.agg(F.count(F.lit(1)).alias("n_differ"))


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def to_wide(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: Column, prefix: str = "") -> DataFrame:
    """Pivot over a known value list: one aggregate per value, no extra pass."""
    picks = [value_for(value, F.col(column) == F.lit(v)).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*index).agg(*picks)


def value_for(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    prefix = column if prefix is None else prefix
    return df.withColumns(
        {f"{prefix}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values}
    )


def fill_not_finite(df: DataFrame, cols: Sequence[str], value: float | None = None) -> DataFrame:
    """NaN and ±inf to NULL, or to a constant."""
    clean = {c: finite(c) if value is None else F.coalesce(finite(c), F.lit(value)) for c in cols}
    return df.withColumns(clean)


def placeholder_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values and stand-ins (blank, "--", ".") per column."""
    def counts(c):
        text = F.trim(F.col(c).cast("string"))
        flags = {
            "n_null": F.col(c).isNull(),
            "n_blank": text == "",
            "n_dashes": text == "--",
            "n_dot": text == ".",
        }
        return F.struct(F.lit(c).alias("column"), *[F.sum(F.coalesce(f.cast("bigint"), F.lit(0))).alias(k) for k, f in flags.items()])

    return df.agg(F.array(*[counts(c) for c in cols]).alias("_a")).select(F.inline("_a"))
