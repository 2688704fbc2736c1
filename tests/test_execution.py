"""Schedules of slices: values against plain loops, and joins that never broadcast a table of slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.catalog import analytics
from tickweave.operators import execution as E
from tickweave.plans import spread

ROWS = [(i, 1000.0 * (i + 1), 1.0, 3 + i % 4, 0.3, 0.05, (i % 3) / 10) for i in range(20)]


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(ROWS, "order_id long, quantity double, horizon double, slices int, sigma double, eta double, risk_aversion double")


@pytest.fixture
def profile(orders):
    slices = orders.select("order_id", F.explode(F.sequence(F.lit(1), F.col("slices"))).alias("slice_idx"))
    return slices.withColumn("volume", 1 + (F.col("order_id") + 3 * F.col("slice_idx")) % 11)


def shares_of(i, n):
    v = np.array([1 + (i + 3 * k) % 11 for k in range(1, n + 1)], dtype=float)
    return 1000.0 * (i + 1) * v / v.sum()


def parts_of(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    return plan


def test_volume_schedule_and_inventory(orders, profile, monkeypatch):
    monkeypatch.setattr(spread, "PART", 16)
    s = E.vwap_schedule(orders, profile)
    # rows, not the session, set the number of tasks: 90 slices or so, 16 a task
    assert s.rdd.getNumPartitions() == -(-profile.count() // 16)
    parts_of(s)
    points = E.inventory(s)
    got = {(r["order_id"], r["slice_idx"]): r["inventory"] for r in points.collect()}
    assert len(got) == points.count() == sum(r[3] + 1 for r in ROWS)
    for i, q, _, n, *_ in ROWS:
        np.testing.assert_allclose([got[i, k] for k in range(n + 1)], q - np.r_[0, np.cumsum(shares_of(i, n))], atol=1e-8)


def test_blend(orders, profile):
    b = E.blend(E.ac_schedule(orders), E.vwap_schedule(orders, profile), [0.0, 0.5, 1.0])
    parts_of(b)
    assert b.columns == ["order_id", "alpha", "slice_idx", "shares"]
    got = {(r["order_id"], r["alpha"], r["slice_idx"]): r["shares"] for r in b.collect()}
    ac = {(r["order_id"], r["slice_idx"]): r["shares"] for r in E.ac_schedule(orders).collect()}
    assert len(got) == 3 * len(ac)
    for i, _, _, n, *_ in ROWS:
        a = np.array([ac[i, k] for k in range(1, n + 1)])
        for alpha in (0.0, 0.5, 1.0):
            x = alpha * a + (1 - alpha) * shares_of(i, n)
            np.testing.assert_allclose([got[i, alpha, k] for k in range(1, n + 1)], x * a.sum() / x.sum())


def test_impact_prices_and_shortfall(orders, profile):
    mids = profile.select("order_id", "slice_idx", (100.0 + F.col("slice_idx")).alias("mid"))
    fills = E.impact_prices(E.vwap_schedule(orders, profile), mids, 1e-6, 1e-5, 0.1)
    parts_of(fills)
    got = {(r["order_id"], r["slice_idx"]): r["price"] for r in fills.collect()}
    lost = {r["order_id"]: r["shortfall"] for r in E.shortfall(fills.withColumn("arrival", F.lit(100.0))).collect()}
    for i, _, _, n, *_ in ROWS:
        s = shares_of(i, n)
        price = 100 + np.arange(1, n + 1) + 1e-6 * np.r_[0, np.cumsum(s)[:-1]] + 1e-4 * s
        np.testing.assert_allclose([got[i, k] for k in range(1, n + 1)], price)
        assert lost[i] == pytest.approx((s * (price - 100)).sum())


def test_timing_risk_needs_no_join(spark, tmp_path):
    spark.createDataFrame([(i, 100.0 + i) for i in range(30)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    risk = analytics.timing_risk(spark, str(tmp_path))
    assert "Join" not in parts_of(risk)
    path = E.ac_schedule(analytics.orders(spark, str(tmp_path))).groupBy("order_id").agg(F.sum(F.col("inventory") ** 2).alias("x")).collect()
    want = {r["order_id"]: round(0.3 * np.sqrt(r["x"] / (5 + r["order_id"] % 10)), 3) for r in path}
    assert {r["order_id"]: r["timing_risk"] for r in risk.collect()} == pytest.approx(want)
