"""Data-quality audits: uniqueness, missingness, zeros, balance, schema, shift."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions.scalars import ratio
from tickweave.plans.order_stats import quantiles


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows of a key; counted per key first, so copies merge early."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.lit(",".join(keys)).alias("key"), F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("_n") - 1).alias("n_surplus")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    return uniqueness(df, df.columns).withColumn("key", F.lit("all columns"))


def infinite_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.abs(F.col(c)) == F.lit(float("inf")), 1)).alias("n_infinite")) for c in cols]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def integrity_report(a: DataFrame, b: DataFrame, key: str, tuple_key: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Nine checks of a data table against its label table as rows (check, value)."""
    ida, idb = uniqueness(a, [key]), uniqueness(b, [key])
    both = a.select(key, F.lit(1).alias("_a")).distinct().join(b.select(key, F.lit(1).alias("_b")).distinct(), key, "full_outer")
    overlap = both.agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_in_data"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_in_labels")
    )
    infinite = infinite_counts(a, numeric).agg(F.sum("n_infinite").alias("infinite_values"))

    def rows(df, names):
        pairs = F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).cast("bigint").alias("value")) for c, name in names.items()])
        return df.select(F.inline(pairs))

    parts = [
        rows(ida, {"n_rows": "data_rows", "n_surplus": "data_repeated_ids"}),
        rows(idb, {"n_rows": "label_rows", "n_surplus": "label_repeated_ids"}),
        rows(uniqueness(a, tuple_key), {"n_surplus": "repeated_tuples"}),
        rows(duplicate_rows(a), {"n_surplus": "repeated_rows"}),
        rows(overlap, {"only_in_data": "only_in_data", "only_in_labels": "only_in_labels"}),
        rows(infinite, {"infinite_values": "infinite_values"}),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count and percentage per column."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"), (F.count(F.when(F.col(c).isNull(), 1)) * 100 / F.count(F.lit(1))).alias("pct_missing")) for c in cols]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def panel_missing(df: DataFrame, arr: str) -> DataFrame:
    """One row: cells, missing cells, rows with any / all missing of an array panel."""
    n, gone = F.size(arr), F.size(F.filter(arr, lambda x: x.isNull()))
    return df.agg(
        F.sum(n).alias("n_cells"), F.sum(gone).alias("n_missing"), (F.sum(gone) * 100 / F.sum(n)).alias("pct_missing"),
        F.count(F.when(gone > 0, 1)).alias("rows_any"), F.count(F.when(gone == n, 1)).alias("rows_all"),
    )


def panel_missing_by_interval(df: DataFrame, arr: str) -> DataFrame:
    long = df.select(F.posexplode(arr).alias("interval", "x"))
    return long.groupBy("interval").agg(F.count(F.when(F.col("x").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("x") == 0, 1)).alias("n_zero"), F.count(F.lit(1)).alias("n_cells"))


def panel_missing_quantiles(df: DataFrame, arr: str, qs: Sequence[float]) -> DataFrame:
    per_row = df.select(F.size(F.filter(arr, lambda x: x.isNull())).alias("missing_count"))
    return quantiles(per_row, ["missing_count"], qs)


def zero_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zeros next to missing values per column."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c) == 0, 1)).alias("n_zero"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing")) for c in cols]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def balance_report(df: DataFrame, y: str, gap: float = 0.1) -> DataFrame:
    """Largest and smallest class share; balanced when they differ by less than ``gap``."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.agg(ratio(F.max("_n"), F.sum("_n")).alias("max_share"), ratio(F.min("_n"), F.sum("_n")).alias("min_share"))
    return shares.withColumn("balanced", F.col("max_share") - F.col("min_share") < gap)


def schema_check(df: DataFrame, spec: T.StructType | Sequence[str]) -> list[tuple[str, str]]:
    """Differences between the columns of a frame and a specification; metadata only."""
    wanted = spec.fieldNames() if isinstance(spec, T.StructType) else list(spec)
    issues = [("missing", c) for c in wanted if c not in df.columns] + [("extra", c) for c in df.columns if c not in wanted]
    if not issues and list(df.columns) != wanted:
        issues.append(("order", ",".join(df.columns)))
    if isinstance(spec, T.StructType):
        kinds = {f.name: f.dataType for f in df.schema}
        issues += [("type", f.name) for f in spec if f.name in kinds and kinds[f.name] != f.dataType]
    return issues


def shift_report(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median, IQR, mean and missing share of each column side by side."""

    def side(df, name):
        q = quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("column").agg(
            F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias(f"median_{name}"),
            (F.max(F.when(F.col("q") == 0.75, F.col("value"))) - F.max(F.when(F.col("q") == 0.25, F.col("value")))).alias(f"iqr_{name}"),
        )
        return q.join(missing_report(df, cols).select("column", F.col("pct_missing").alias(f"missing_{name}")), "column")

    return side(train, "train").join(side(test, "test"), "column")


def class_shift(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Class shares of both sets side by side."""
    rows = train.select(y, F.lit(1).alias("_t")).unionByName(test.select(y, F.lit(0).alias("_t")))
    counts = rows.groupBy(y).agg(F.count(F.when(F.col("_t") == 1, 1)).alias("_a"), F.count(F.when(F.col("_t") == 0, 1)).alias("_b"))
    total = counts.agg(F.struct(F.sum("_a").alias("a"), F.sum("_b").alias("b"))).scalar()
    return counts.withColumn("_s", total).select(y, ratio("_a", F.col("_s.a")).alias("share_train"), ratio("_b", F.col("_s.b")).alias("share_test"))
