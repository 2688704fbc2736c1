"""Pair building, roles, validated joins, day shifts and parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.scalars import pair_key
from tickweave.plans.spread import SALTS, one_of, salted_join


def align_pairs(bars: DataFrame, pairs: DataFrame, value: str = "close", ts: str = "ts", a: str = "stock_a", b: str = "stock_b") -> DataFrame:
    """Both sides of every pair on exactly equal timestamps: (pair columns, ts, x_a, x_b).

    Bars of a hot symbol are split by timestamp before they meet the pair list.
    """
    left = bars.select(F.col("symbol").alias(a), ts, F.col(value).alias("x_a"))
    right = bars.select(F.col("symbol").alias(b), ts, F.col(value).alias("x_b"))
    return salted_join(left, pairs, [a], [ts]).join(right, [b, ts])


def _unique(df: DataFrame, on: Sequence[str], side: str) -> DataFrame:
    """One row per key; a repeated key stops the job.

    The check is part of a filter, so it runs whatever columns are read later.
    """
    rest = [c for c in df.columns if c not in on]
    grouped = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest, F.lit(1).alias("_one"))).alias("_row"))
    message = F.concat(F.lit(f"repeated key on the {side} side: "), F.to_json(F.struct(*on)))
    single = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return grouped.filter(single).select(*on, *[F.col("_row")[c].alias(c) for c in rest])


def join_1to1(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails on repeated keys of either side. The check shares the join's shuffle."""
    return _unique(a, list(on), "left").join(_unique(b, list(on), "right"), list(on), how)


def candidate_pairs(universe: DataFrame, group: str = "sector", symbol: str = "symbol") -> DataFrame:
    """Symbols of one sector as unordered pairs a < b; a missing sector is an error.

    The input is the symbol list, not bars; a large sector is spread over tasks.
    """
    sector = F.when(F.col(group).isNull(), F.raise_error(F.concat(F.lit("no sector for symbol "), F.col(symbol)))).otherwise(F.col(group))
    names = universe.select(sector.alias(group), symbol).distinct()
    salt = F.pmod(F.xxhash64(symbol), F.lit(SALTS)).cast("int")
    a = names.select(group, F.col(symbol).alias("stock_a")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    b = names.select(group, F.col(symbol).alias("stock_b"), salt.alias("_salt"))
    return a.join(b, [group, "_salt"]).filter(F.col("stock_a") < F.col("stock_b")).select("stock_a", "stock_b", group)


def assign_roles(pairs: DataFrame, universe: DataFrame, symbol: str = "symbol", cap: str = "market_cap") -> DataFrame:
    """The larger market cap leads; equal caps → stock_a."""
    caps = universe.select(symbol, cap)
    joined = pairs.join(caps.select(F.col(symbol).alias("stock_a"), F.col(cap).alias("cap_a")), "stock_a").join(
        caps.select(F.col(symbol).alias("stock_b"), F.col(cap).alias("cap_b")), "stock_b"
    )
    a_leads = F.col("cap_a") >= F.col("cap_b")
    return joined.withColumns(
        {
            "leader": F.when(a_leads, F.col("stock_a")).otherwise(F.col("stock_b")),
            "follower": F.when(a_leads, F.col("stock_b")).otherwise(F.col("stock_a")),
        }
    ).drop("cap_a", "cap_b")


def flag_member(df: DataFrame, members: DataFrame, keys: Sequence[str], out: str = "is_member") -> DataFrame:
    marks = members.select(*keys).distinct().withColumn("_in", F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_in")


def shift_to_next_day(df: DataFrame, day: str = "day", out: str = "trading_day") -> DataFrame:
    """Key of the next trading day over the union of all days; the last day drops out."""
    days = df.select(day).distinct().withColumn(out, F.lead(day).over(W.orderBy(day)))
    return df.join(days.filter(F.col(out).isNotNull()), day)


def align_benchmark(strategy: DataFrame, benchmark: DataFrame, day: str = "day") -> DataFrame:
    return strategy.join(benchmark, day)


def sweep(df: DataFrame, grid: dict[str, Sequence[float]]) -> DataFrame:
    """Every row once per parameter combination; the grid is a literal, so no join."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def attach_results(left: DataFrame, results: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Update columns of the left table where the natural key has a result."""
    renamed = results.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = left.join(renamed, list(key), "left")
    for c in cols:
        old = F.col(c) if c in left.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old))
    return joined.drop(*[f"_new_{c}" for c in cols])


def empirical_pairs(tests: DataFrame, leader: str = "empirical_leader", max_p: float | None = None) -> DataFrame:
    """Roles as found by the lead tests, one row per unordered pair (best p first)."""
    required = {"stock_a", "stock_b", leader, "p_value"}
    missing = required - set(tests.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = tests.filter(F.col(leader).isNotNull())
    if max_p is not None:
        rows = rows.filter(F.col("p_value") < max_p)
    keyed = rows.withColumn("pair", pair_key("stock_a", "stock_b"))
    best = one_of(keyed, ["pair"], ["p_value", "stock_a", "stock_b"])
    follower = F.when(F.col(leader) == F.col("stock_a"), F.col("stock_b")).otherwise(F.col("stock_a"))
    return best.select("pair", "stock_a", "stock_b", F.col(leader).alias("leader"), follower.alias("follower"), "p_value")
