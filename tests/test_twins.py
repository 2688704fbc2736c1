"""Queries next to their SQL on small tables that hold what the given ones lack: prices of zero, equal candidates."""

import datetime as dt

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tickweave.operators import portfolio
from tools.check import digest


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows, start = [], dt.datetime(2024, 1, 2, 9, 20)
    for i in range(1500):
        kind = ("click", "error", "view")[i % 3]
        rows.append((i, start + dt.timedelta(seconds=30 * i), i % 7, kind, 0.0 if i % 41 == 5 else float(round(rng.exponential(50) + 0.01, 2)), f'{{"k": {i % 9}}}'))
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["w01_returns", "w05_forward_returns", "f04_math_functions", "b09_event_study"])
def test_prices_of_zero(spark, events, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    got, want = __spark_entry__.queries()[name](spark, events).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert len(got) and not np.isinf(want.select_dtypes("number").to_numpy(float)).any()
    assert digest(got) == digest(want)


def test_equal_candidates_go_to_the_smallest(spark):
    # the same ratio, added in another order
    ratios = [(7, 0.1 + 0.2), (3, 0.3), (9, 0.3), (1, 0.29)]
    scores = spark.createDataFrame([(c, 0.1, 0.2, s) for c, s in ratios], "candidate long, portfolio_return double, portfolio_risk double, sharpe double")
    assert portfolio.best_portfolio(scores).select("candidate", "sharpe").collect() == [(3, 0.3)]
