"""Execution schedules, impact, shortfall and calibration over tables of orders.

An order row has: order_id, quantity, horizon, slices, sigma, eta, risk_aversion.
Schedules are rows (order_id, slice_idx, t, shares, inventory); the rows of one
order are its slices, a number set by the order itself.

Spark sizes a table of slices like the orders that it comes from, and would broadcast it. Slices therefore
meet by shuffles of as many parts as their number asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio, safe_log_ratio
from tickweave.plans.series import lagged
from tickweave.plans.spread import dealt, salted_join


def guard(condition: Column, message: str, value: Column) -> Column:
    """The value, or an error that stops the job."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def vwap(bars: DataFrame, keys: Sequence[str] = ("symbol",), price: str = "close", volume: str = "volume") -> DataFrame:
    """Σpv / Σv per group; a group without volume is an error."""
    total = F.sum(F.col(volume)).cast("double")
    rows = bars.groupBy(*keys).agg(F.sum(F.col(price) * F.col(volume)).alias("_pv"), total.alias("_v"))
    return rows.withColumn("vwap", guard(F.col("_v") > 0, "total volume must be positive", ratio("_pv", "_v"))).drop("_pv", "_v")


def _slices(orders: DataFrame) -> DataFrame:
    return orders.withColumn("slice_idx", F.explode(F.sequence(F.lit(1), F.col("slices").cast("int"))))


def twap(orders: DataFrame) -> DataFrame:
    """Equal slices and what is left after each."""
    n, q, k = F.col("slices"), F.col("quantity"), F.col("slice_idx")
    return _slices(orders).withColumns(
        {"t": k * F.col("horizon") / n, "shares": q / n, "inventory": q * (1 - k / n)}
    ).select("order_id", "slice_idx", "t", "shares", "inventory")


def vwap_schedule(orders: DataFrame, profile: DataFrame) -> DataFrame:
    """Shares by volume weight. ``profile``: order_id, slice_idx, volume; negative or zero-sum is an error."""
    w = W.partitionBy("order_id").orderBy("slice_idx")
    v = guard(F.col("volume") >= 0, "volume profile must not be negative", F.col("volume").cast("double"))
    n = profile.count()
    rows = dealt(profile.select("order_id", "slice_idx", v.alias("_v")), n, "order_id")
    # one sort serves both windows: a hash join keeps the order of its larger side
    rows = rows.withColumn("_sum", F.sum("_v").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = guard(F.col("_sum") > 0, "volume profile must have a positive sum", ratio("_v", "_sum"))
    quantities = dealt(orders.select("order_id", "quantity"), n, "order_id").hint("shuffle_hash")
    done = rows.join(quantities, "order_id").withColumn("shares", F.col("quantity") * share)
    left = F.col("quantity") - F.sum("shares").over(w.rowsBetween(W.unboundedPreceding, 0))
    return done.withColumn("inventory", left).select("order_id", "slice_idx", "shares", "inventory")


def _remaining(t: Column, linear_below: float) -> Column:
    """Inventory at time t: Q·sinh(κ(T-t))/sinh(κT), linear for negligible risk aversion."""
    q, horizon, lam = F.col("quantity"), F.col("horizon"), F.col("risk_aversion")
    kappa = F.sqrt(lam * F.col("sigma") ** 2 / F.col("eta"))
    curve = q * F.try_divide(F.sinh(kappa * (horizon - t)), F.sinh(kappa * horizon))
    return F.when(lam < linear_below, q * (1 - t / horizon)).otherwise(curve)


def ac_schedule(orders: DataFrame, linear_below: float = 1e-12, keep: Sequence[str] = ()) -> DataFrame:
    """Risk-averse schedule with linear impact; each slice sells the drop of the inventory curve. ``keep``: columns of the order to carry along."""
    tau = F.col("horizon") / F.col("slices")
    k = F.col("slice_idx")
    rows = _slices(orders).withColumns(
        {"t": k * tau, "inventory": _remaining(k * tau, linear_below), "_before": _remaining((k - 1) * tau, linear_below)}
    )
    return rows.withColumn("shares", F.col("_before") - F.col("inventory")).select("order_id", "slice_idx", "t", "shares", "inventory", *keep)


def blend(ac: DataFrame, vw: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """α·risk-averse + (1-α)·volume schedule for each α, rescaled to the full quantity."""
    if any(not 0 <= a <= 1 for a in alphas):
        raise ValueError("alpha must lie in [0, 1]")
    n, on = ac.count(), ["order_id", "slice_idx"]
    left, right = ac.select(*on, F.col("shares").alias("_a")), vw.select(*on, F.col("shares").alias("_v"))
    both = dealt(dealt(left, n, *on).join(dealt(right, n, *on).hint("merge"), on), n, "order_id")
    w = W.partitionBy("order_id")
    raw = [F.lit(float(a)) * F.col("_a") + (1 - F.lit(float(a))) * F.col("_v") for a in alphas]
    # all alphas share one window, so that rows are repeated only after it
    rows = both.withColumns({f"_t{i}": F.sum(x).over(w) for i, x in enumerate(raw)} | {"_q": F.sum("_a").over(w)})
    cells = [F.struct(F.lit(float(a)).alias("alpha"), (x * ratio("_q", f"_t{i}")).alias("shares")) for i, (a, x) in enumerate(zip(alphas, raw, strict=True))]
    return rows.select(*on, F.inline(F.array(*cells))).select("order_id", "alpha", "slice_idx", "shares")


def inventory(schedule: DataFrame, keys: Sequence[str] = ("order_id",)) -> DataFrame:
    """N+1 points: the full quantity, then what is left after each slice."""
    w = W.partitionBy(*keys)
    total = F.sum("shares").over(w)
    sold = F.sum("shares").over(w.orderBy("slice_idx").rowsBetween(W.unboundedPreceding, 0))
    rows = schedule.withColumns({"_total": total, "_left": total - sold})
    # the first slice also gives the point before it, so the schedule is read once
    after = F.struct(F.col("slice_idx"), F.col("_left").alias("inventory"))
    start = F.struct(F.lit(0).cast(schedule.schema["slice_idx"].dataType).alias("slice_idx"), F.col("_total").alias("inventory"))
    return rows.select(*keys, F.inline(F.when(F.col("slice_idx") == 1, F.array(start, after)).otherwise(F.array(after))))


def impact_prices(schedule: DataFrame, mids: DataFrame, gamma: float, eta: float, tau: float, keys: Sequence[str] = ("order_id",)) -> DataFrame:
    """Fill price: mid + permanent impact of the shares before + temporary impact of this slice."""
    before = F.sum("shares").over(W.partitionBy(*keys).orderBy("slice_idx").rowsBetween(W.unboundedPreceding, -1))
    n, on = mids.count(), [*keys, "slice_idx"]
    rows = dealt(dealt(schedule, n, *on).join(dealt(mids, n, *on).hint("merge"), on), n, *keys)
    price = F.col("mid") + gamma * F.coalesce(before, F.lit(0.0)) + eta * F.col("shares") / tau
    return rows.withColumn("price", price)


def shortfall(fills: DataFrame, keys: Sequence[str] = ("order_id",), arrival: str = "arrival") -> DataFrame:
    """Σn(P - S₀), the average price and the shortfall per share."""
    n, p = F.col("shares"), F.col("price")
    rows = fills.groupBy(*keys).agg(
        F.sum(n * (p - F.col(arrival))).alias("shortfall"), ratio(F.sum(n * p), F.sum(n)).alias("avg_price"), ratio(F.sum(n * (p - F.col(arrival))), F.sum(n)).alias("shortfall_per_share")
    )
    return rows


def timing_risk(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """σ·√(τ·Σx²) over the inventory after each slice; ``path`` carries sigma and tau."""
    return path.groupBy(*keys).agg((F.max("sigma") * F.sqrt(F.max("tau") * F.sum(F.col("inventory") ** 2))).alias("timing_risk"))


def calibrate(orders: DataFrame, lambdas: Sequence[float], delta: float = 0.02) -> DataFrame:
    """Grid over the risk aversion: lowest timing risk among costs within (1+δ) of the even schedule.

    Cost is the temporary impact Σ η·n²/τ. The grid repeats orders, and all of
    it is one aggregate per (order, λ).
    """
    grid = orders.withColumn("risk_aversion", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    tau = F.col("horizon") / F.col("slices")
    k = F.col("slice_idx")
    path = _slices(grid).withColumns({"inventory": _remaining(k * tau, 1e-12), "_before": _remaining((k - 1) * tau, 1e-12)})
    sold = F.col("_before") - F.col("inventory")
    scored = path.groupBy("order_id", "risk_aversion").agg(
        F.sum(F.col("eta") * sold**2 / tau).alias("cost"),
        (F.max("sigma") * F.sqrt(F.max(tau) * F.sum(F.col("inventory") ** 2))).alias("timing_risk"),
        F.max(F.col("eta") * F.col("quantity") ** 2 / F.col("slices") / tau).alias("even_cost"),
    )
    allowed = F.col("cost") <= (1 + delta) * F.col("even_cost")
    best = F.min_by(F.struct("risk_aversion", "cost", "timing_risk", "even_cost"), F.when(allowed, F.struct("timing_risk", "risk_aversion")))
    return scored.groupBy("order_id").agg(best.alias("_b")).select("order_id", "_b.*")


def volume_profile(bars: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Volume weight of each bar in its group."""
    totals = bars.groupBy(*keys).agg(F.sum("volume").alias("_total"))
    return salted_join(bars, totals, list(keys), list(order)).withColumn("weight", ratio("volume", "_total")).drop("_total")


def volatility(bars: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Standard deviation of log returns and of price changes."""
    prev = lagged(bars, keys, order, {"_prev": ("close", 1)})
    return prev.groupBy(*keys).agg(
        F.stddev_samp(safe_log_ratio("close", "_prev")).alias("sigma_return"), F.stddev_samp(F.col("close") - F.col("_prev")).alias("sigma_price")
    )
