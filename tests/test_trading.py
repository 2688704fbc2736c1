"""Grid resampling, trade matching and bracket exits against plain loops."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import backtest as K
from tickweave.operators import portfolio
from tickweave.operators.bars import resample_grid, resample_observed
from tickweave.operators.joins import candidate_pairs, join_1to1
from tickweave.plans import series as P

RNG = np.random.default_rng(11)


def minute_bars():
    rows = []
    for s in ("a", "b"):
        for d in ("2024-03-04", "2024-03-05", "2024-03-07"):
            minutes = np.sort(RNG.choice(np.arange(540, 990), RNG.integers(1, 60), replace=False))
            for m in minutes:
                for sec in (5, 40)[: RNG.integers(1, 3)]:
                    close = np.nan if RNG.random() < 0.2 else round(RNG.normal(100, 5), 2)
                    rows.append((s, pd.Timestamp(d) + pd.Timedelta(minutes=int(m), seconds=sec), close, int(RNG.integers(1, 9))))
    return pd.DataFrame(rows, columns=["symbol", "ts", "close", "volume"])


def test_grid_matches_pandas(spark):
    pdf = minute_bars()
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    inside = pdf[(pdf.ts.dt.hour * 60 + pdf.ts.dt.minute).between(555, 960)]
    want = []
    for (s, day), g in inside.groupby(["symbol", inside.ts.dt.date]):
        grid = pd.date_range(f"{day} 09:15", f"{day} 16:00", freq="1min")
        r = g.set_index("ts").resample("1min").agg({"close": "last", "volume": "sum"}).reindex(grid)
        r["close"] = r["close"].ffill().bfill()
        r["volume"] = r["volume"].fillna(0)
        want.append(r.assign(symbol=s).reset_index(names="ts"))
    want = pd.concat(want).sort_values(["symbol", "ts"]).reset_index(drop=True)
    got = resample_grid(df, prices=["close"], flows=["volume"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(got) == len(want)
    np.testing.assert_allclose(got["close"].astype(float), want["close"].astype(float))
    np.testing.assert_allclose(got["volume"].astype(float), want["volume"].astype(float))


def test_observed_grid_has_no_back_fill(spark):
    df = spark.createDataFrame([("a", "2024-03-04 10:00:10", None, 1), ("a", "2024-03-04 10:03:00", 7.0, 2)], "symbol string, t string, close double, volume int")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = resample_observed(df, prices=["close"], flows=["volume"]).orderBy("ts").collect()
    assert [r["close"] for r in got] == [None, None, None, 7.0]
    assert [r["volume"] for r in got] == [1, 0, 0, 2]


def loop_trades(pdf):
    """Row loop over one pair-day table."""
    out = []
    for (lead, foll, day), g in pdf.groupby(["leader", "follower", "trading_day"]):
        g = g.sort_values("ts").reset_index(drop=True)
        ls, fs = g.leader_price.rolling(15).mean(), g.follower_price.rolling(15).mean()
        held = None
        for i, r in g.iterrows():
            clock = r.ts.strftime("%H:%M")
            if not "09:30" <= clock <= "15:55" or r.follower_price <= 10:
                continue
            if held is None:
                long = r.leader_price > ls[i] * 1.006 and r.follower_price < fs[i] * 1.002
                short = r.leader_price < ls[i] * 0.994 and r.follower_price < fs[i] * 0.998
                if long or short:
                    held = ("long" if long else "short", r.ts, r.follower_price)
                continue
            crossed = r.leader_price < ls[i] if held[0] == "long" else r.leader_price > ls[i]
            if crossed or clock >= "15:55":
                sign = 1 if held[0] == "long" else -1
                n = 100_000 / held[2]
                out.append((lead, foll, held[0], held[1], r.ts, sign * n * (r.follower_price - held[2]) - 2 * n * 0.0035))
                break
    return sorted(out)


def test_trades_match_a_row_loop(spark):
    rows = []
    for k in range(40):
        start, stop = RNG.integers(550, 600), RNG.choice([700, 950, 955, 956, 961])
        minutes = [m for m in range(start, stop) if RNG.random() < 0.9]
        lead = 100 * np.exp(np.cumsum(RNG.normal(0, 0.004, len(minutes))))
        foll = RNG.choice([10.2, 50]) * np.exp(np.cumsum(RNG.normal(0, 0.004, len(minutes))))
        for m, x, y in zip(minutes, lead, foll):
            rows.append((f"L{k}", f"F{k}", pd.Timestamp("2024-03-04"), pd.Timestamp("2024-03-04") + pd.Timedelta(minutes=m), x, y))
    pdf = pd.DataFrame(rows, columns=["leader", "follower", "trading_day", "ts", "leader_price", "follower_price"])
    want = loop_trades(pdf)
    got = K.match_trades(K.pair_signals(spark.createDataFrame(pdf))).toPandas()
    got = sorted(got[["leader", "follower", "side", "entry_time", "exit_time", "net_pnl"]].itertuples(index=False, name=None))
    assert len(want) > 10
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("block", [4, 128])
def test_bracket_first_touch(spark, block):
    n = 200
    close = 100 + np.cumsum(RNG.normal(0, 1, n))
    ts = pd.date_range("2024-01-01", periods=n, freq="1h")
    pdf = pd.DataFrame({"symbol": "a", "ts": ts, "close": close, "high": close + 0.5, "low": close - 0.5, "atr": 2.0})
    df = spark.createDataFrame(pdf)
    got = K.bracket_exit(df.filter(F.hour("ts") % 5 == 0), df, [1.0, 3.0], [2.0, 50.0], block=block).toPandas()
    assert len(got) == 4 * sum(t.hour % 5 == 0 for t in ts)
    for r in got.itertuples():
        i = int(np.flatnonzero(ts == r.entry_ts)[0])
        stop, target = close[i] - r.k * 2, close[i] + r.m * 2
        later = [j for j in range(i + 1, n) if close[j] - 0.5 <= stop or close[j] + 0.5 >= target]
        if later:
            j = later[0]
            assert r.exit_ts == ts[j] and r.exit_reason == ("stop" if close[j] - 0.5 <= stop else "target")
        else:
            assert pd.isna(r.exit_ts) and r.exit_reason is None


def test_bracket_work_is_bounded(spark, capsys):
    """100,000 bars: orders that nothing touches, orders touched at the very end, and a bar without prices."""
    n = 100_000
    bars = spark.range(n).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), *[F.when(F.col("id") != 50, F.lit(100.0) + d).alias(c) for c, d in (("close", 0), ("high", 0.5), ("low", -0.5))])
    bars = bars.withColumn("high", F.when(F.col("ts") == F.timestamp_seconds(F.lit((n - 1) * 60)), 109.0).otherwise(F.col("high")))
    entries = bars.filter(F.unix_seconds("ts") % 600_000 == 0).withColumn("atr", F.lit(2.0))
    out = K.bracket_exit(entries, bars, [1.0], [4.0, 5.0])
    got = out.toPandas()
    assert len(got) == 20
    near = got[got.m == 4.0]
    assert (near.exit_reason == "target").all() and near.exit_ts.nunique() == 1 and (near.pnl == 8.0).all()
    assert got[got.m == 5.0].exit_ts.isna().all()
    levels = K.extremes_tree(P.index_rows(bars, ["symbol"], ["ts"]), 128)
    assert [lv.count() for lv in levels] == [782, 7, 1]
    assert max(lv.agg(F.max(F.size("_kids"))).first()[0] for lv in levels) == 128
    out.explain()
    keys = [[k for k in j.split(", ") if not k.startswith("symbol#")] for j in re.findall(r"Join \[([^\]]*)\]", capsys.readouterr().out)]
    assert len(keys) >= 5 and all(keys)  # no join on the symbol alone


def test_guards(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(Exception, match="repeated key"):
        join_1to1(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="no sector"):
        candidate_pairs(spark.createDataFrame([("s", None), ("t", "u")], "symbol string, sector string")).collect()


def test_performance_zero_divisors(spark):
    flat = spark.createDataFrame([(1, 100.0, 0.0), (2, 100.0, 0.0)], "trading_day int, strategy_equity double, strategy_return double")
    p = K.performance(flat).first()
    assert p["total_return"] == 0 and p["sharpe"] is None and p["sortino"] is None and p["calmar"] is None


def test_performance_of_each_key_equals_that_series_alone(spark):
    rows = [(s, (pd.Timestamp(f"2024-03-0{d}") + pd.Timedelta(hours=h)).to_pydatetime(), float(c)) for s, closes in {"a": (9, 7, 8, 6), "b": (5, 6, 4, 7), "c": (3, 3, 3, 3)}.items() for d, c in enumerate(closes, 4) for h in (10, 15)]
    both = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    held = K.buy_and_hold(both, "1900-01-01", "2999-01-01", keys=["symbol"])
    got = {r.symbol: r for r in K.performance(held, "benchmark_equity", "benchmark_return", keys=["symbol"]).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for symbol, row in got.items():
        alone = K.performance(K.buy_and_hold(both.filter(F.col("symbol") == symbol), "1900-01-01", "2999-01-01"), "benchmark_equity", "benchmark_return").first()
        assert [row[c] for c in alone.asDict()] == [x if x is None else pytest.approx(x) for x in alone]


def test_by_symbol_query_reports_every_symbol(spark):
    from __spark_entry__ import queries
    from tickweave.catalog.series import grid

    sf = "/root/testdata/sf0.001"
    got = queries()["b06_performance_by_symbol"](spark, sf).collect()
    assert sorted(r.symbol for r in got) == sorted(r.symbol for r in grid(spark, sf).select("symbol").distinct().collect())
    view = queries()["b06_performance"](spark, sf).first()
    assert [{c: r[c] for c in view.asDict()} for r in got if r.symbol == "view"] == [view.asDict()]


def test_blocked_covariance_equals_pairwise(spark):
    rng = np.random.default_rng(5)
    n_days, n_assets = 70, 23
    wide = pd.DataFrame(rng.normal(0, 0.02, (n_days, n_assets)) + 5, columns=[f"s{i}" for i in range(n_assets)])
    wide[rng.random(wide.shape) < 0.2] = np.nan
    wide["late"] = np.where(np.arange(n_days) > 66, 0.1, np.nan)
    wide["never"] = np.nan
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret")
    df = spark.createDataFrame(long).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))
    want = wide.cov(min_periods=1)
    for block, days in ((4, 16), (64, 256)):
        got = portfolio.covariance(df, block=block, days=days).toPandas()
        assert not got.duplicated(["a", "b"]).any() and "never" not in set(got["a"])
        assert len(got) == 24 * 24 - sum(2 for c in wide.columns[:23] if not (wide[c].notna() & wide["late"].notna()).any())
        for r in got.itertuples():
            shared = (wide[r.a].notna() & wide[r.b].notna()).sum()
            if shared < 2:
                assert r.cov is None or np.isnan(r.cov)
            else:
                assert abs(r.cov - wide[[r.a, r.b]].dropna().cov().to_numpy()[0, -1] if r.a != r.b else r.cov - want.loc[r.a, r.a]) < 1e-14


def test_blocked_covariance_meets_strips_not_days(spark):
    df = spark.range(600 * 40).selectExpr("id % 600 AS ts", "concat('s', id DIV 600) AS symbol", "sin(id) AS ret")
    plan = portfolio.covariance(df, block=8, days=64)._jdf.queryExecution().executedPlan().toString()
    # the only join is the one with the assets' means
    assert plan.count("Join ") + plan.count("Join[") <= 1 + plan.count("Final Plan") and portfolio.covariance(df, block=8, days=64).count() == 1600


def test_session_ends_to_the_second(spark):
    def trades(last):
        rows = [("a", "b", pd.Timestamp(f"2024-03-04 {t}"), p) for t, p in (("09:29:59", 50.0), ("09:30:00", 51.0), ("12:00:00", 52.0), (last, 53.0))]
        df = spark.createDataFrame(pd.DataFrame(rows, columns=["leader", "follower", "ts", "follower_price"]))
        df = df.withColumns({"trading_day": F.to_date("ts"), "leader_price": F.lit(100.0), "leader_sma": F.lit(99.0), "long_signal": F.lit(True), "short_signal": F.lit(False)})
        return [(r.entry_time.strftime("%H:%M:%S"), r.exit_time.strftime("%H:%M:%S"), r.exit_reason) for r in K.match_trades(df).collect()]

    assert trades("15:55:00") == [("09:30:00", "15:55:00", "forced_eod_exit")]
    # the session is over half a second before the bar
    assert trades("15:55:00.500") == [] and trades("15:55:30") == []
