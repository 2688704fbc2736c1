"""Ordered plans against pandas, with tiny blocks and one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import indicators as I
from tickweave.operators import series as R
from tickweave.plans import series as P
from tickweave.plans.series import index_rows, lagged, over_series, running

RNG = np.random.default_rng(7)


def frame(n=600, nulls=True):
    """Key "a" owns most rows; gaps in time, some NULL values."""
    key = np.where(RNG.random(n) < 0.7, "a", RNG.choice(["b", "c", "d"], n))
    t = np.sort(RNG.choice(40 * 86_400, n, replace=False))
    x = np.round(RNG.normal(50, 10, n), 3)
    pdf = pd.DataFrame({"symbol": key, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, unit="s"), "id": np.arange(n), "x": x})
    if nulls:
        pdf.loc[RNG.random(n) < 0.05, "x"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf.sort_values("id"), df.repartition(5)


def back(df, cols):
    return df.select("id", *cols).toPandas().sort_values("id").set_index("id")[cols]


def same(got, want):
    np.testing.assert_allclose(got.astype(float).to_numpy(), want.astype(float).to_numpy(), rtol=1e-9, atol=1e-9)


def test_positions_and_length(data):
    pdf, df = data
    out = back(index_rows(df, ["symbol"], ["ts", "id"], total="n", block=40), ["_pos", "n"])
    same(out["_pos"], pdf.groupby("symbol").cumcount())
    same(out["n"], pdf.groupby("symbol")["id"].transform("size"))


@pytest.mark.parametrize("block", [8, 64, 10_000])
def test_rolling_blocks_match_pandas(data, block):
    pdf, df = data

    def build(d, w):
        return d.withColumns({"m": R.rolled("mean", "x", 5, w), "s": R.rolled("std", "x", 5, w), "ahead": F.lead("x", 3).over(w)})

    out = back(over_series(df, ["symbol"], ["ts", "id"], build, before=4, after=3, block=block), ["m", "s", "ahead"])
    g = pdf.groupby("symbol")["x"]
    same(out["m"], g.transform(lambda s: s.rolling(5).mean()))
    same(out["s"], g.transform(lambda s: s.rolling(5).std()))
    same(out["ahead"], g.shift(-3))
    assert len(out) == len(pdf)


def test_bounded_path_gives_the_same(data):
    _, df = data
    a = back(lagged(df, ["symbol"], ["ts", "id"], {"p": ("x", 2), "q": ("x", -2)}), ["p", "q"])
    b = back(lagged(df, ["symbol"], ["ts", "id"], {"p": ("x", 2), "q": ("x", -2)}, bounded=True), ["p", "q"])
    pd.testing.assert_frame_equal(a, b)


def test_running_values(data):
    pdf, df = data
    out = back(running(df, ["symbol"], ["ts", "id"], {"s": ("sum", "x"), "m": ("max", "x"), "l": ("last", "x"), "lo": ("min", "x")}), ["s", "m", "l", "lo"])
    g = pdf.groupby("symbol")["x"]
    same(out["s"], g.transform(lambda s: s.fillna(0).cumsum().where(s.notna().cumsum() > 0)))
    same(out["m"], g.transform(lambda s: s.cummax().ffill()))
    same(out["lo"], g.transform(lambda s: s.cummin().ffill()))
    same(out["l"], g.transform(lambda s: s.ffill()))


@pytest.mark.parametrize("block", [20, 100_000])
def test_ewm_blocks_match_pandas(data, block):
    pdf, df = data
    whole = pdf.assign(x=pdf["x"].fillna(50.0))
    out = back(R.ewm(df.fillna({"x": 50.0}), {"e": ("x", 5)}, order=["ts", "id"], block=block), ["e"])
    same(out["e"], whole.groupby("symbol")["x"].transform(lambda s: s.ewm(span=5, adjust=False).mean()))


def test_run_length(data):
    pdf, df = data
    state = pdf["x"].fillna(0) > 50
    changed = state.groupby(pdf["symbol"]).transform(lambda s: s != s.shift())
    run = changed.groupby(pdf["symbol"]).cumsum()
    want = pdf.groupby([pdf["symbol"], run]).cumcount() + 1
    out = back(R.run_length(df.withColumn("state", F.coalesce(F.col("x") > 50, F.lit(False))), "state", ["symbol"], ["ts", "id"]), ["run_count"])
    same(out["run_count"], want)


def test_parabolic_sar_is_independent_of_blocks(spark):
    n = 400
    close = 100 + np.cumsum(RNG.normal(0, 1, n))
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="1h"), "high": close + 0.7, "low": close - 0.7, "close": close})
    df = spark.createDataFrame(pdf)
    one = I.parabolic_sar(df).toPandas().sort_values("ts")["sar"].to_numpy()
    many = I.parabolic_sar(df, block=40, memory=4).toPandas().sort_values("ts")["sar"].to_numpy()
    np.testing.assert_allclose(one, many, rtol=0, atol=0)
    # a series without a name has borders of its own
    both = df.unionByName(df.withColumn("symbol", F.lit(None).cast("string")))
    got = I.parabolic_sar(both, block=40, memory=4).toPandas().sort_values("ts")
    assert len(got) == 2 * n
    for part in (got[got["symbol"].isna()], got[got["symbol"] == "a"]):
        np.testing.assert_allclose(one, part["sar"].to_numpy(), rtol=0, atol=0)


def test_empty_and_single_row(spark, data):
    _, df = data
    empty = df.filter("id < 0")
    assert R.rolling(empty, {"m": ("mean", "x", 3)}, order=["ts", "id"]).count() == 0
    one = R.rolling(df.filter("id = 5"), {"m": ("mean", "x", 3)}, order=["ts", "id"]).collect()
    assert len(one) == 1 and one[0]["m"] is None


def test_early_slices(data):
    pdf, df = data
    n = pdf.groupby("symbol").size()
    a = R.early_slice(df, [0.25], "floor5", ["symbol"], ["ts", "id"]).groupBy("symbol").count().toPandas().set_index("symbol")["count"]
    b = R.early_slice(df, [0.25], "ceil2", ["symbol"], ["ts", "id"]).groupBy("symbol").count().toPandas().set_index("symbol")["count"]
    for s in n.index:
        assert a[s] == max(int(n[s] * 0.25), 5)
        assert b[s] == max(int(np.ceil(n[s] * 0.25)), 2)


# --- measured blocks ------------------------------------------------------------------


def crowd(n=4_000):
    """One key, all rows inside one hour, half of them inside one second, and a NULL key and NULL times besides."""
    t = np.sort(np.where(RNG.random(n) < 0.5, RNG.random(n), RNG.random(n) * 3600))
    hot = [("a", float(x), i, float(RNG.normal())) for i, x in enumerate(t)]
    return hot + [("b", float(i), n + i, float(i)) for i in range(30)] + [(None, float(i % 7), n + 100 + i, float(i)) for i in range(300)] + [("a", None, n + 900 + i, float(i)) for i in range(40)]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = crowd()
    df = spark.createDataFrame(rows, "symbol string, at double, id long, x double").repartition(7)
    pdf = pd.DataFrame(rows, columns=["symbol", "at", "id", "x"]).sort_values(["at", "id"], na_position="first")
    return df.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))), pdf


def largest_block(rows):
    return rows.groupBy("symbol", "_block").count().agg(F.max("count")).first()[0]


def test_no_task_orders_more_than_a_block(crowded):
    df, _ = crowded
    cells = P.measure(df, ["symbol"], ["ts", "id"], block=100)
    assert {k for k, _ in cells.rows} == {("a",), (None,)}
    spread = cells.spread(df, before=5, after=3)
    assert spread.filter("_own").count() == df.count()
    # a block, a cell on each side, and the cell that begins in it
    assert largest_block(spread) <= 100 * (1 + 3 / P.CELLS) + 43
    assert P.measure(df, ["symbol"], ["ts", "id"], block=10_000) is None


def test_measured_blocks_equal_pandas(crowded):
    df, pdf = crowded
    g = pdf.groupby("symbol", dropna=False)["x"]

    def build(d, w):
        return d.withColumns({"back": F.lag("x", 4).over(w), "ahead": F.lead("x", 3).over(w), "mean": F.avg("x").over(w.rowsBetween(-4, 0)), "at_pos": F.col("_pos")})

    out = over_series(df, ["symbol"], ["ts", "id"], build, before=4, after=3, block=100).toPandas().set_index("id").loc[pdf["id"]]
    assert len(out) == len(pdf)
    same(out["back"], pd.Series(g.shift(4).to_numpy()))
    same(out["ahead"], pd.Series(g.shift(-3).to_numpy()))
    same(out["mean"], pd.Series(g.transform(lambda s: s.rolling(5, min_periods=1).mean()).to_numpy()))
    same(out["at_pos"], pd.Series(pdf.groupby("symbol", dropna=False).cumcount().to_numpy()))
    total = index_rows(df, ["symbol"], ["ts", "id"], total="n", block=100).toPandas().set_index("id").loc[pdf["id"]]
    same(total["_pos"], pd.Series(pdf.groupby("symbol", dropna=False).cumcount().to_numpy()))
    same(total["n"], pd.Series(g.transform("size").to_numpy()))
    run = running(df, ["symbol"], ["ts", "id"], {"s": ("sum", "x"), "m": ("max", "x"), "c": ("count", "x"), "l": ("last", F.when(F.col("id") % 50 == 0, F.col("id")))}, block=100)
    run = run.toPandas().set_index("id").loc[pdf["id"]]
    same(run["s"], pd.Series(g.cumsum().to_numpy()))
    same(run["m"], pd.Series(g.cummax().to_numpy()))
    same(run["l"], pd.Series(pdf.assign(l=pdf["id"].where(pdf["id"] % 50 == 0)).groupby("symbol", dropna=False)["l"].ffill().to_numpy()))


def test_strings_and_numbers_are_orders_too(spark):
    words = [f"{RNG.choice(['a', 'ab', 'é', 'zebra'])}{i % 211:04d}" for i in range(900)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, id long")
    out = index_rows(df, [], ["word", "id"], total="n", block=50).toPandas().sort_values("_pos")
    want = sorted(range(900), key=lambda i: (words[i].encode(), i))
    assert out["id"].tolist() == want and set(out["n"]) == {900} and out["_pos"].tolist() == list(range(900))
    assert largest_block(P.measure(df, [], ["word"], 50).spread(df.withColumn("symbol", F.lit(0)))) <= 100


def test_a_lag_is_one_exchange(crowded, capsys):
    df, _ = crowded
    for block in (100, 100_000):
        lagged(df, ["symbol"], ["ts", "id"], {"p": ("x", 1)}, block=block).explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") >= 1


def test_recursions_equal_one_unbroken_run(crowded):
    df, pdf = crowded
    for span in (1, 300):
        out = R.ewm(df.withColumn("x", F.when(F.col("id") % 11 > 0, F.col("x"))), {"e": ("x", span)}, ["symbol"], ["ts", "id"], block=350).toPandas().set_index("id").loc[pdf["id"]]
        want = pdf.assign(x=pdf["x"].where(pdf["id"] % 11 > 0)).groupby("symbol", dropna=False)["x"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
        np.testing.assert_allclose(out["e"].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_old_values_fade_exactly(spark):
    # 1e6 once, then nothing: only the carried value is left
    df = spark.createDataFrame([("a", i, 1e6 if i == 0 else 0.0) for i in range(3_000)], "symbol string, ts long, x double")
    out = R.ewm(df, {"e": ("x", 9)}, ["symbol"], ["ts"], block=250).orderBy("ts").toPandas()["e"].to_numpy()
    want = 1e6 * 0.8 ** np.arange(3_000)
    near = want > 1e-290
    np.testing.assert_allclose(out[near], want[near], rtol=1e-11)


def test_wilder_and_macd_equal_pandas(spark):
    n = 900
    close = 100 + np.cumsum(RNG.normal(0, 1, n))
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="1h"), "high": close + RNG.random(n), "low": close - RNG.random(n), "close": close})
    df = spark.createDataFrame(pdf)
    prev = pdf["close"].shift(1)
    tr = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - prev).abs(), (pdf["low"] - prev).abs()], axis=1).max(axis=1)
    x = tr.copy()
    x.iloc[:13], x.iloc[13] = np.nan, tr.iloc[:14].mean()
    atr = x.ewm(alpha=1 / 14, adjust=False).mean().to_numpy()
    fast, slow = (pdf["close"].ewm(span=s, adjust=False).mean() for s in (12, 26))
    for block in (200, 10_000):
        np.testing.assert_allclose(I.wilder_atr(df, block=block).toPandas().sort_values("ts")["atr"].to_numpy(), atr, rtol=1e-12)
        lines = I.macd(df, block=block).toPandas().sort_values("ts")
        np.testing.assert_allclose(lines["macd"], fast - slow, rtol=0, atol=1e-11)
        np.testing.assert_allclose(lines["macd_signal"], (fast - slow).ewm(span=9, adjust=False).mean(), rtol=0, atol=1e-11)
        np.testing.assert_allclose(I.sma_vs_ema(df, block=block).toPandas().sort_values("ts")["sma_vs_ema"], pdf["close"].rolling(10).mean() - pdf["close"].ewm(span=10, adjust=False).mean(), rtol=0, atol=1e-11)


@pytest.mark.parametrize("window", [3, 40, 2_500, 60 * 391])
def test_rolling_correlation_of_any_length(spark, window):
    n = 6_000 if window <= 2_500 else 50_000
    x = 1e4 + np.cumsum(RNG.normal(0, 1, n))  # drifts far from its start
    y = 0.3 * x + RNG.normal(0, 5, n)
    pdf = pd.DataFrame({"stock_a": "a", "stock_b": "b", "ts": pd.date_range("2024-01-01", periods=n, freq="1min"), "x_a": x, "x_b": y})
    from tickweave.operators.leadlag import rolling_corr

    want = pdf["x_a"].rolling(window).corr(pdf["x_b"]).to_numpy()
    whole = np.array([np.corrcoef(x[i - window + 1 : i + 1], y[i - window + 1 : i + 1])[0, 1] if i >= window - 1 else np.nan for i in range(n)]) if window <= 40 else want
    for how in ({"bounded": True}, {}):
        got = rolling_corr(spark.createDataFrame(pdf), window, **how).toPandas().sort_values("ts")["rolling_corr"].to_numpy()
        np.testing.assert_allclose(got, whole, rtol=0, atol=1e-8)
