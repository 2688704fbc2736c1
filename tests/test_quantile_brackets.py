"""Quantiles of long groups rank a narrow range of values only; the result is the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.plans import order_stats as O

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
RNG = np.random.default_rng(8)
GROUPS = {"normal": RNG.normal(size=4000), "ties": RNG.integers(0, 5, 3000) / 10, "tails": np.exp(RNG.normal(0, 30, 3000)), None: RNG.normal(size=2500), "short": RNG.normal(size=40), "one": np.array([2.5])}


@pytest.fixture
def long(spark):
    rows = [(k, "x", float(v)) for k, values in GROUPS.items() for v in values]
    return spark.createDataFrame(rows, "k string, column string, value double").repartition(7)


def check(found):
    got = {(r["k"], r["q"]): r["value"] for r in found.collect()}
    want = {(k, q): float(np.quantile(v, q)) for k, v in GROUPS.items() for q in QS}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12), key


@pytest.mark.parametrize("parts", [10_000, 50])
def test_only_a_range_is_ranked(long, monkeypatch, parts):
    # 50 parts: the range between two marks holds many values
    monkeypatch.setattr(O, "SKETCH", parts)
    seen = []
    monkeypatch.setattr(O, "running", lambda df, *a, run=O.running, **k: (seen.append(df.agg(F.sum(next(c for c in df.columns if c == "_c"))).first()[0]), run(df, *a, **k))[1])
    check(O.quantiles_long(long, QS, ["k"], block=500))
    # without the short groups, which are ranked whole
    assert max(seen[0], 1) < 12_500 * (1 if parts == 50 else 0.5) + 3_000 * len(QS)


def test_a_missed_range_ranks_all(long, monkeypatch):
    # ranges beside the wanted ranks
    monkeypatch.setattr(O, "MARGIN", -400)
    check(O.quantiles_long(long, QS, ["k"], block=500))


def test_long_groups_do_not_shuffle_their_values(spark, monkeypatch):
    monkeypatch.setattr(O, "_upto", lambda *a, **k: pytest.fail("ranks all values"))
    df = spark.range(20_000).select(F.lit("x").alias("column"), F.sqrt("id").alias("value"))
    got = {r["q"]: r["value"] for r in O.quantiles_long(df, QS, block=1000).collect()}
    assert got == pytest.approx({q: float(np.quantile(np.sqrt(np.arange(20_000)), q)) for q in QS})
