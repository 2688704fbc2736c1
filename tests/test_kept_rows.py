"""Rows that earlier forms lost: NULL keys, repeated keys, payload kinds, text labels, constant windows, wide draws."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tickweave import session
from tickweave.operators import aggregates, leadlag, models, select, series
from tickweave.operators.joins import join_1to1
from tickweave.plans.series import index_rows, lagged, running
from tickweave.plans.spread import DRAWS, hash_draw
from tickweave.sources import payloads


@pytest.fixture(scope="module")
def bars(spark):
    start = dt.datetime(2024, 1, 1, 9)
    rows = [(s, start + dt.timedelta(minutes=20 * i), float(i % 7 + (3 if s else 5))) for s in ("a", None) for i in range(12)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_null_keys_are_series_in_every_mode(bars):
    for block in (4, 100):
        done = index_rows(bars, ["symbol"], ["ts"], total="_n", block=block)
        assert done.filter("symbol IS NULL").agg(F.max("_pos"), F.max("_n"), F.count("*")).first() == (11, 12, 12)
    values = {"s": ("sum", "close"), "m": ("max", "close"), "l": ("last", F.when(F.col("close") > 6, F.col("close")))}
    for op in (
        lambda **how: running(bars, ["symbol"], ["ts"], values, **how),
        lambda **how: lagged(bars, ["symbol"], ["ts"], {"p": ("close", 2), "q": ("close", -1)}, **how),
    ):
        assert rows(op(block=4)) == rows(op(bounded=True)) == rows(op()) and op(block=4).count() == 24
    for bounded in (False, True):
        assert series.rolling(bars, {"m": ("mean", "close", 3)}, ["symbol"], ["ts"], bounded=bounded).filter("symbol IS NULL AND m IS NOT NULL").count() == 10
        assert series.returns(bars, "simple", "close", ["symbol"], ["ts"], bounded=bounded).filter("symbol IS NULL AND ret IS NOT NULL").count() == 11


def test_repeated_keys_stop_the_join_whatever_is_read(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, u double")
    for read in (lambda d: d.count(), lambda d: d.select("k", "u").collect(), lambda d: d.select("k").collect()):
        with pytest.raises(Exception, match="repeated key on the left"):
            read(join_1to1(a, b, ["k"]))
    assert join_1to1(b, a.filter("k = 2"), ["k"], "left").count() == 2


@pytest.mark.parametrize("section", ["Time Series (Daily)", "Weekly Time Series", "Monthly Adjusted Time Series", "Time Series (5min)"])
def test_payload_kinds(spark, section):
    text = f'{{"Meta Data": {{"a": "b"}}, "{section}": {{"2024-01-05": {{"1. open": "1.5", "5. adjusted close": "2.5", "7. dividend amount": "0.1"}}}}}}'
    df = spark.createDataFrame([("s", text), ("t", '{"Error Message": "no"}')], "symbol string, payload string")
    row = payloads.parse_ohlcv_payload(df, "payload", ["symbol"], payloads.ADJUSTED_FIELDS).collect()
    assert [(r.symbol, r.open, r.adjusted_close, r.dividend_amount, r.high) for r in row] == [("s", 1.5, 2.5, 0.1, None)]


def test_text_labels_and_ties(spark):
    games = spark.createDataFrame([("W",), ("L",), ("W",), ("L",), ("D",)], "r string")
    assert aggregates.majority_baseline(games, "r").first() == ("L", 0.4)
    best = spark.createDataFrame([(1, 5.0, "b"), (1, 5.0, "a"), (1, 2.0, "c"), (2, None, "d")], "k int, v double, name string")
    assert [tuple(r) for r in select.argmax_row(best, "v", ["name"], ["k"]).collect()] == [(1, 5.0, "a")]


@pytest.mark.parametrize("bounded", [False, True])
def test_constant_windows_have_no_correlation(spark, bounded):
    start = dt.datetime(2024, 1, 1)
    data = [("a", "b", start + dt.timedelta(minutes=i), 0.1 if i < 60 else 0.1 * i, ((i * 37) % 11) / 3) for i in range(100)]
    df = spark.createDataFrame(data, "stock_a string, stock_b string, ts timestamp_ntz, x_a double, x_b double")
    got = leadlag.rolling_corr(df, 20, bounded=bounded).orderBy("ts").collect()
    assert [r.rolling_corr is None for r in got] == [i < 60 for i in range(100)]


def test_draws_are_wide(spark):
    low, high, n = spark.range(5000).select(hash_draw(F.col("id")).alias("d")).agg(F.min("d"), F.max("d"), F.count_distinct("d")).first()
    assert 0 <= low < DRAWS / 500 and DRAWS * 0.998 < high < DRAWS == 2**60 and n == 5000


def test_missing_features_are_an_error(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="null"):
        models.assemble(df, ["x"]).collect()


def test_no_private_folder_on_a_cluster():
    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
    assert session.shared_folder(fake("local[2]")).startswith("/tmp/spark-")
