"""Portfolio analytics on long tables: returns, mean and covariance, scored weight vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.operators.select import argmax_row
from tickweave.operators.series import returns
from tickweave.session import cut

PERIODS = 252


def return_panel(prices: DataFrame, asset: str = "symbol", day: str = "ts", price: str = "close", bounded: bool = False) -> DataFrame:
    """Simple returns on the dates where every asset has one."""
    # read for its rows and for its complete dates; an asset of one price has no return, and so no complete date
    moves = cut(returns(prices, "simple", price, [asset], [day], bounded=bounded).select(asset, day, "ret"))
    rets = moves.filter(F.col("ret").isNotNull())
    n_assets = moves.select(F.countDistinct(asset).alias("n")).scalar()
    full = rets.groupBy(day).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_assets).select(day)
    return rets.join(full, day)


def mean_returns(rets: DataFrame, asset: str = "symbol") -> DataFrame:
    return rets.groupBy(asset).agg(F.avg("ret").alias("mean"))


def _block_moments(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the shared days of one block of days, for every asset of the one strip with every asset of the other."""

    def wide(side):
        strips = rows.loc[rows["side"] == side, ["days", "assets", "values"]]
        cells = pd.DataFrame({c: np.concatenate(strips[c].to_list()) for c in strips}) if len(strips) else pd.DataFrame(columns=["days", "assets", "values"])
        return cells.pivot(index="days", columns="assets", values="values")

    left = wide(0)
    # a block meets itself in one strip
    right = left if rows["left"].iloc[0] == rows["right"].iloc[0] else wide(1)
    days = left.index.intersection(right.index)
    x, y = left.loc[days], right.loc[days]
    has_x, has_y = x.notna().to_numpy(float), y.notna().to_numpy(float)
    vx, vy = x.fillna(0.0).to_numpy(float), y.fillna(0.0).to_numpy(float)
    sums = {"n": has_x.T @ has_y, "sx": vx.T @ has_y, "sy": has_x.T @ vy, "sxy": vx.T @ vy}
    out = pd.DataFrame({"a": np.repeat(x.columns, len(y.columns)), "b": np.tile(y.columns, len(x.columns))} | {k: v.ravel() for k, v in sums.items()})
    return out[out["n"] > 0]


def covariance(rets: DataFrame, asset: str = "symbol", day: str = "ts", block: int = 64, days: int = 256) -> DataFrame:
    """Sample covariance as rows (a, b, cov) over the dates that both assets have; the assets are those of the data.

    A blocked Gram matrix: about ``block`` assets by ``days`` dates form a strip, strips of the same dates meet for every
    pair of asset blocks once, and a matrix product per pair of strips gives d² sums a block of dates
    instead of d² rows a date. Strips travel d / block times; no task holds more than two. Returns are first centred at their
    asset's mean, so that the sums do not cancel. A pair of fewer than two shared dates has a NULL; one
    without any has no row. A repeated (asset, date) is an error; rows without asset, date or return count for nothing.
    """
    rows = rets.filter(F.col(asset).isNotNull() & F.col(day).isNotNull() & F.col("ret").isNotNull()).select(F.col(asset).alias("a"), F.col(day).alias("d"), F.col("ret").cast("double").alias("x"))
    rows = cut(rows)
    size = rows.agg(F.approx_count_distinct("a", 0.01).alias("assets"), F.approx_count_distinct("d", 0.01).alias("days")).first()
    k, chunks = max(1, math.ceil(size["assets"] / block)), max(1, math.ceil(size["days"] / days))
    kind = rows.schema["a"].dataType.simpleString()
    means = rows.groupBy("a").agg(F.avg("x").alias("_m"))
    cells = rows.join(means, "a").select(
        F.pmod(F.xxhash64("a"), F.lit(k)).cast("int").alias("i"), F.pmod(F.xxhash64("d"), F.lit(chunks)).cast("int").alias("chunk"), F.col("d").cast("string").alias("d"), "a", (F.col("x") - F.col("_m")).alias("x")
    )
    # one array per field: strips are read without a Python object a cell
    strips = cells.groupBy("i", "chunk").agg(F.collect_list(F.struct("d", "a", "x")).alias("_c")).select("i", "chunk", F.col("_c.d").alias("days"), F.col("_c.a").alias("assets"), F.col("_c.x").alias("values"))
    # strip i is the left one of the pairs (i, i), (i, i + 1), … and the right one of (0, i), (1, i), …
    meets = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(F.least("i", j).alias("left"), F.greatest("i", j).alias("right"), (j < F.col("i")).cast("int").alias("side")))
    placed = strips.select("chunk", "days", "assets", "values", F.inline(meets))
    parts = placed.groupBy("left", "right", "chunk").applyInPandas(_block_moments, f"a {kind}, b {kind}, n double, sx double, sy double, sxy double")
    sums = parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")))
    cov = F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1))
    half = sums.select("a", "b", cov.alias("cov"), F.pmod(F.xxhash64("a"), F.lit(k)).alias("_i"), F.pmod(F.xxhash64("b"), F.lit(k)).alias("_j"))
    # pairs inside one block stand in both orders already
    return half.withColumn("_o", F.when(F.col("_i") == F.col("_j"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).select(
        "a", "b", "cov", F.explode("_o").alias("_turn")
    ).select(F.when(F.col("_turn"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("_turn"), F.col("a")).otherwise(F.col("b")).alias("b"), "cov")


def normalise_weights(weights: DataFrame) -> DataFrame:
    """Candidates (candidate, symbol, weight) with weights summing to one."""
    totals = weights.groupBy("candidate").agg(F.sum("weight").alias("_t"))
    return weights.join(totals, "candidate").withColumn("weight", ratio("weight", "_t")).drop("_t")


def score_portfolios(weights: DataFrame, mean: DataFrame, cov: DataFrame, rf: float = 0.0, annualise_mean: bool = True) -> DataFrame:
    """Annual return, risk and Sharpe of each candidate.

    Weights meet the covariance rows of their asset; the sums per (candidate, other
    asset) then meet that asset's weight, so no matrix stands in one row.
    ``annualise_mean=False`` keeps the source's daily mean over annual risk.
    """
    held = weights.select("candidate", "symbol", "weight")
    ret = held.join(mean, "symbol").groupBy("candidate").agg((F.sum(F.col("weight") * F.col("mean")) * PERIODS).alias("portfolio_return"))
    half = held.join(cov.withColumnRenamed("a", "symbol"), "symbol").groupBy("candidate", F.col("b").alias("symbol")).agg(F.sum(F.col("weight") * F.col("cov")).alias("_half"))
    risk = half.join(held, ["candidate", "symbol"]).groupBy("candidate").agg(F.sqrt(F.sum(F.col("weight") * F.col("_half")) * PERIODS).alias("portfolio_risk"))
    scored = ret.join(risk, "candidate")
    top = F.col("portfolio_return") if annualise_mean else F.col("portfolio_return") / PERIODS
    return scored.withColumn("sharpe", ratio(top - rf, "portfolio_risk"))


def best_portfolio(scores: DataFrame, decimals: int = 10) -> DataFrame:
    """The candidate of the largest Sharpe ratio. Ratios that agree to ``decimals`` are ties, which go to the smallest candidate.

    Equal weights give equal ratios only up to the order in which a cluster adds them, so the last digits must not choose.
    """
    marked = scores.withColumn("_sharpe", F.round("sharpe", decimals))
    return argmax_row(marked, "_sharpe", ["candidate"]).drop("_sharpe")
