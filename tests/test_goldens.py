"""Published results of the 43-market study."""

import pytest
from pyspark.sql import functions as F

from tickweave.operators import backtest as K
from tickweave.operators import calibration as C
from tickweave.operators.aggregates import corr_by, corr_matrix

# fixed values: final probability, outcome, fair probability, processing regime, max drawdown, range, reversals
MARKETS = [
    (0.02, 0, 0.0384615384615384, 1, 0.983871, 0.915, 115), (0.55, 1, 0.6, 0, 0.358974, 0.28, 3), (0.36, 0, 0.3333333333333333, 0, 0.2125, 0.085, 8),
    (0.995, 1, 0.9, 1, 0.609929, 0.72, 81), (0.825, 1, 0.6666666666666666, 0, 0.472973, 0.53, 34), (0.06, 0, 0.0384615384615384, 0, 0.97619, 0.615, 178),
    (0.445, 0, 0.4, 0, 0.666667, 0.495, 39), (0.235, 1, 0.5, 0, 0.06, 0.015, 2), (0.01, 0, 0.0384615384615384, 0, 0.890909, 0.049, 19),
    (0.006, 0, 0.0384615384615384, 0, 0.890909, 0.049, 384), (0.005, 0, 0.0384615384615384, 1, 0.994595, 0.92, 76), (0.015, 0, 0.0384615384615384, 1, 0.977099, 0.64, 61),
    (0.954, 1, 0.9, 1, 0.486364, 0.491, 153), (0.0155, 0, 0.0384615384615384, 1, 0.968041, 0.4775, 152), (0.007, 0, 0.0384615384615384, 1, 0.99209, 0.878, 842),
    (0.9925, 1, 0.9, 1, 0.456522, 0.493, 70), (0.002, 0, 0.0384615384615384, 1, 0.996078, 0.508, 81), (0.0075, 0, 0.0384615384615384, 1, 0.988235, 0.504, 184),
    (0.565, 1, 0.6, 0, 0.008772, 0.04, 2), (0.235, 0, 0.5, 1, 0.971154, 0.505, 51), (0.775, 1, 0.6666666666666666, 1, 0.491979, 0.47, 116),
    (0.0005, 0, 0.0384615384615384, 1, 0.999012, 0.5055, 173), (0.0005, 0, 0.0384615384615384, 1, 0.999213, 0.6345, 604), (0.065, 0, 0.0384615384615384, 1, 0.965294, 0.8205, 256),
    (0.455, 1, 0.4, 1, 0.686131, 0.48, 192), (0.9995, 1, 0.9, 1, 0.515152, 0.8395, 2), (0.007, 0, 0.0384615384615384, 1, 0.986, 0.493, 200),
    (0.0055, 0, 0.0384615384615384, 1, 0.996053, 0.757, 250), (0.0035, 0, 0.0384615384615384, 1, 0.997041, 0.5055, 1538), (0.0005, 0, 0.0384615384615384, 1, 0.999248, 0.6645, 1244),
    (0.0005, 0, 0.0384615384615384, 1, 0.99913, 0.5745, 1147), (0.0005, 0, 0.0384615384615384, 1, 0.999194, 0.6195, 1652), (0.0005, 0, 0.0384615384615384, 1, 0.998901, 0.4545, 2134),
    (0.9995, 1, 0.9, 1, 0.878378, 0.977, 2421), (0.0005, 0, 0.0384615384615384, 1, 0.9988, 0.416, 2191), (0.0005, 0, 0.0384615384615384, 1, 0.998331, 0.299, 1824),
    (0.5, 0, 0.4, 0, 0.315385, 0.205, 392), (0.0075, 0, 0.0384615384615384, 1, 0.989209, 0.6875, 73), (0.05, 0, 0.0384615384615384, 1, 0.90099, 0.455, 77),
    (0.9865, 1, 0.9, 1, 0.78154, 0.7875, 1938), (0.9995, 1, 0.9, 1, 0.684323, 0.7045, 1349), (0.9995, 1, 0.9, 1, 0.556842, 0.5785, 1244), (0.535, 0, 0.6, 0, 0.070175, 0.04, 3),
]


@pytest.fixture(scope="module")
def markets(spark):
    df = spark.createDataFrame(MARKETS, "final_probability double, outcome int, expected double, processing int, max_drawdown double, probability_range double, reversals int")
    regime = F.when(F.col("processing") == 1, K.PROCESSING).otherwise(K.ANCHORED)
    df = df.withColumns({"market_regime": regime, "abs_surprise": F.abs(F.col("outcome") - F.col("final_probability"))})
    curve = C.beta_fair_value(C.calibration_table(df, "final_probability", "outcome"))
    return C.mispricing(df, curve, "final_probability").cache()


def test_scores(markets):
    table = C.calibration_table(markets, "final_probability", "outcome")
    assert table.count() == 10
    assert round(C.brier(markets, "final_probability", "outcome").first()[0], 4) == 0.0532
    assert round(C.ece(table).first()[0], 4) == 0.0559
    better = C.brier_improvement(markets, "final_probability", "bayesian_fair_probability", "outcome").first()
    assert round(better["brier_fair"], 4) == 0.0537
    assert round(better["improvement_pct"], 1) == -0.9


def test_fair_values(markets):
    worst = markets.agg(F.max(F.abs(F.col("expected") - F.col("bayesian_fair_probability")))).first()[0]
    assert worst < 1e-12


def test_signals(markets):
    counts = {r["signal"]: r["count"] for r in K.threshold_signal(markets).groupBy("signal").count().collect()}
    assert counts == {"BUY": 3, "SELL": 12, "NO TRADE": 28}


def test_strategy_accuracy(markets):
    s = K.regime_signal(markets)
    row = s.agg(*[K.correct_share(s, p).alias(p) for p in ("pred_original", "pred_contrarian", "pred_regime_aware")]).first()
    assert [round(100 * v, 1) for v in row] == [20.9, 79.1, 86.0]


def test_correlations(markets):
    by = corr_by(markets.withColumn("error", F.col("outcome") - F.col("final_probability")), ["market_regime"], "mispricing", "error")
    got = {r["market_regime"]: round(r["corr"], 3) for r in by.collect()}
    assert got == {K.ANCHORED: 0.554, K.PROCESSING: -0.455}
    m = {r["b"]: round(r["value"], 3) for r in corr_matrix(markets, ["abs_surprise", "max_drawdown", "probability_range", "reversals"]).filter("a = 'abs_surprise'").collect()}
    assert m == {"max_drawdown": -0.756, "probability_range": -0.587, "reversals": -0.37}
