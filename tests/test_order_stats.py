"""Exact quantiles, ranks, draws and joins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import stats as H
from tickweave.operators.evaluate import roc_auc
from tickweave.operators.aggregates import average_ranks
from tickweave.plans import series as P
from tickweave.plans.order_stats import quantiles, quantiles_long, value_ranks
from tickweave.plans.spread import one_of, permuted, round_draws, salted_join

QS = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
CASES = {
    "normal": np.random.default_rng(1).normal(0, 1, 501),
    "ties": np.random.default_rng(2).integers(-3, 4, 400).astype(float),
    "constant": np.full(50, 3.25),
    "single": np.array([-7.5]),
    "heavy": np.random.default_rng(3).standard_cauchy(333) * 1e6,
    "close": 1_700_000_000 + np.arange(200) * 1e-3,
    "tiny": np.array([0.0, -1e-320, 1e-310, 5e-324, 1e300, -1e300]),
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles_equal_numpy(spark, name):
    x = CASES[name]
    df = spark.createDataFrame(pd.DataFrame({"x": np.append(x, np.nan)}))
    got = quantiles(df, ["x"], QS).toPandas().sort_values("q")["value"].to_numpy()
    np.testing.assert_allclose(got, np.quantile(x, QS), rtol=1e-12, atol=1e-322)


def test_grouped_quantiles(spark):
    pdf = pd.DataFrame({"k": ["a"] * 300 + ["b"] * 7, "x": np.random.default_rng(4).gamma(1.0, 100.0, 307)})
    got = quantiles(spark.createDataFrame(pdf), ["x"], [0.1, 0.5], ["k"]).toPandas()
    for (k, q), v in got.set_index(["k", "q"])["value"].items():
        assert v == pytest.approx(np.quantile(pdf[pdf.k == k].x, q), rel=1e-12)


def test_bit_image_keeps_order(spark):
    x = np.sort(np.concatenate([CASES["heavy"], CASES["normal"], CASES["tiny"], 2.0 ** np.arange(-1074, 1024, 7), np.nextafter(2.0 ** np.arange(-60, 60), 0), 10.0 ** np.arange(-5, 6), [0.0, np.inf, -np.inf]]))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    b = df.select("x", P.order_number(df, "x").alias("b"), P.bit_image(F.col("x")).alias("i")).toPandas().sort_values("x")
    assert (np.diff(b["b"].to_numpy()) >= 0).all()
    finite = np.isfinite(b["x"].to_numpy())
    bits = np.abs(b["x"].to_numpy()).view(np.int64).astype(float) * np.sign(b["x"].to_numpy())
    np.testing.assert_allclose(b["i"].to_numpy()[finite], bits[finite], rtol=1e-15, atol=1)


HARD = {
    "epoch microseconds": 1_700_000_000_000_000.0 + np.random.default_rng(8).permutation(4_000) * 977.0,
    "one narrow range": np.random.default_rng(9).uniform(0.990, 0.991, 4_000),
    "heavy tail": np.exp(np.random.default_rng(10).standard_cauchy(4_000).clip(-600, 600)),
    "one value and a few": np.append(np.full(3_900, 0.25), np.random.default_rng(11).normal(0, 1, 100)),
}


@pytest.mark.parametrize("name", HARD)
def test_hard_values_in_small_blocks(spark, name):
    x = HARD[name]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    got = quantiles_long(df.select(F.lit("x").alias("column"), F.col("x").alias("value")), QS, block=200).toPandas().sort_values("q")["value"].to_numpy()
    np.testing.assert_allclose(got, np.quantile(x, QS), rtol=1e-12)
    ranks = value_ranks(df, "x", block=200).toPandas().set_index("value")["rank"]
    np.testing.assert_array_equal(ranks.loc[x].to_numpy(), pd.Series(x).rank().to_numpy())
    # what one task orders: distinct values of a block
    counts = df.groupBy("x").count()
    cells = P.measure(counts, [], ["x"], 200)
    if cells:
        blocks = cells.spread(counts).groupBy("_block").count().toPandas()["count"]
        assert blocks.max() <= 200 * (1 + 2 / P.CELLS) and blocks.sum() == len(np.unique(x))
    else:
        assert len(np.unique(x)) <= 200


def test_rank_columns(spark):
    pdf = pd.DataFrame({"id": range(300), "a": np.random.default_rng(12).integers(0, 5, 300).astype(float), "b": np.random.default_rng(13).normal(0, 1, 300)})
    pdf.loc[::17, "a"] = np.nan
    got = average_ranks(spark.createDataFrame(pdf), ["a", "b"], ["id"]).toPandas().sort_values("id")
    np.testing.assert_array_equal(got["a"].to_numpy(), pdf["a"].rank().to_numpy())
    np.testing.assert_array_equal(got["b"].to_numpy(), pdf["b"].rank().to_numpy())


def test_ranks_and_auc(spark):
    x = CASES["ties"]
    y = (np.random.default_rng(5).random(len(x)) < 0.4).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = value_ranks(df, "x").toPandas().set_index("value")["rank"]
    want = pd.Series(x).rank()
    assert all(got[v] == r for v, r in zip(x, want))
    pairs = (x[y == 1][:, None] > x[y == 0]).mean() + 0.5 * (x[y == 1][:, None] == x[y == 0]).mean()
    assert roc_auc(df, "y", "x").first()["auc"] == pytest.approx(pairs)


def test_known_p_values(spark):
    df = spark.createDataFrame([(True, v) for v in (1.0, 2.0, 3.0, 4.0)] + [(False, v) for v in (2.0, 4.0, 6.0, 8.0)], "g boolean, y double")
    w = H.welch(df, "g", "y").first()
    assert w["statistic"] == pytest.approx(-1.7320508, abs=1e-6)
    assert w["df"] == pytest.approx(4.4117647, abs=1e-6)
    from tickweave.functions.distributions import _student_tail

    assert _student_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert _student_tail(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert _student_tail(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    m = H.mann_whitney(df, "g", "y").first()
    assert m["u"] == 3.0 and 0 < m["p_value"] < 1


def test_salted_join_equals_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    side = spark.createDataFrame([(0, "x"), (0, "y"), (3, "z")], "k bigint, v string")
    for how in ("inner", "left"):
        a = sorted(map(str, salted_join(big, side, ["k"], ["id"], how).select("k", "id", "v").collect()))
        b = sorted(map(str, big.join(side, "k", how).select("k", "id", "v").collect()))
        assert a == b


def test_one_of(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    assert {(r.k, r.v) for r in one_of(df, ["k"], ["t"], last=True).collect()} == {(1, "b"), (2, None)}
    assert {(r.k, r.v) for r in one_of(df, ["k"], ["t"]).collect()} == {(1, "a"), (2, None)}


@pytest.mark.parametrize("n", [1, 2, 3, 12, 257, 4001])
def test_permuted_takes_every_place_once(spark, n):
    rows = spark.range(n).withColumn("b", F.explode(F.array(*map(F.lit, range(4))))).withColumn("p", permuted(F.col("id"), F.lit(n).cast("long"), round_draws(F.col("b"), seed=7)))
    got = rows.toPandas().sort_values(["b", "id"])
    for _, g in got.groupby("b"):
        assert sorted(g["p"]) == list(range(n))
    orders = {tuple(g["p"]) for _, g in got.groupby("b")}
    assert n < 12 or (len(orders) == 4 and all(abs(np.corrcoef(o, range(n))[0, 1]) < 4 / np.sqrt(n) for o in orders))


def test_subsets_are_drawn_without_replacement(spark):
    df = spark.createDataFrame([(i * 3, float(2**i)) for i in range(20)], "id int, y double")
    means = H.subset_bootstrap(df, "y", "id", 4, 50).toPandas()["mean"]
    assert all(bin(int(m * 4)).count("1") == 4 for m in means) and means.nunique() > 40
    assert H.subset_bootstrap(df, "y", "id", 90, 2).toPandas()["mean"].tolist() == [pytest.approx((2**20 - 1) / 20)] * 2


def test_no_ranks_in_the_permutation_plan(spark, capsys):
    pdf = pd.DataFrame({"stock_a": "a", "stock_b": "b", "ts": pd.date_range("2024-01-01", periods=40, freq="6h"), "x_a": np.arange(40.0) % 7, "x_b": np.arange(40.0) % 5})
    H.permutation_lead_score(spark.createDataFrame(pdf), 1, 3, bounded=True).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_permutation_keeps_every_value(spark):
    """With B shuffles the null scores centre on zero and p is a share."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y = np.roll(x, 1) + rng.normal(scale=0.1, size=300)
    pdf = pd.DataFrame({"stock_a": "a", "stock_b": "b", "ts": pd.date_range("2024-01-01", periods=300, freq="6h"), "x_a": x, "x_b": y})
    r = H.permutation_lead_score(spark.createDataFrame(pdf), 1, 30).first()
    s = pd.Series(x).corr(pd.Series(y).shift(-1)) - pd.Series(y).corr(pd.Series(x).shift(-1))
    assert r["lead_score"] == pytest.approx(s, abs=1e-9)
    assert r["p_value"] == 0.0 and abs(r["random_mean"]) < 0.1 and r["n_obs"] == 300
