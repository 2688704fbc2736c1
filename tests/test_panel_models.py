"""Return-panel features, audits and model helpers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions import panel as P
from tickweave.functions import scalars as S
from tickweave.operators import audit as D
from tickweave.operators import models as M
from tickweave.operators import panelprep as Z
from tickweave.operators import trajectory as Y

RNG = np.random.default_rng(21)


def paths():
    rows = RNG.normal(0, 20, (12, 53))
    rows[RNG.random(rows.shape) < 0.2] = np.nan
    rows[RNG.random(rows.shape) < 0.1] = 0.0
    rows[0] = np.nan
    rows[1] = 0.0
    rows[2, 36:] = np.nan
    rows[3, 37:] = np.nan
    return rows


@pytest.fixture(scope="module")
def panel(spark):
    raw = paths()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(raw)], "id int, r array<double>")
    return raw, df.withColumn("r", P.clean("r"))


def close(a, b):
    if b is None or np.isnan(b):
        assert a is None
    else:
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_features(panel):
    raw, df = panel
    got = {r["id"]: r for r in P.path_features(df, "r").withColumns({"rev": P.count_reversals("r"), "inten": P.reversal_intensity("r"), "trend": P.late_trend("r"), "late": P.late_momentum_consistency("r")}).collect()}
    for i, r in enumerate(raw):
        seen = r[~np.isnan(r)]
        g = got[i]
        close(g["path_return_bps"], seen.sum())
        close(g["realized_vol_bps"], np.sqrt((seen**2).sum()))
        close(g["path_efficiency"], abs(seen.sum()) / np.abs(seen).sum() if np.abs(seen).sum() > 0 else 0.0)
        close(g["sign_persistence"], np.mean(np.sign(seen) == np.sign(seen.sum())) if len(seen) else np.nan)
        a, b = np.nansum(np.abs(r[:26])), np.nansum(np.abs(r[26:]))
        close(g["path_asymmetry"], (b - a) / (a + b) if a + b > 0 else np.nan)
        signs = np.sign(seen)
        signs = signs[signs != 0]
        flips = int((signs[1:] != signs[:-1]).sum()) if len(signs) > 1 else 0
        assert g["rev"] == flips
        close(g["inten"], flips / (len(signs) - 1) if len(signs) > 1 else np.nan)
        late = r[36:][~np.isnan(r[36:])]
        close(g["trend"], np.polyfit(np.arange(len(late)), np.cumsum(late), 1)[0] if len(late) > 1 else np.nan)
        close(g["late"], np.mean(np.sign(late) == np.sign(late.sum())) if len(late) else np.nan)


def test_qcut_edges(spark):
    x = RNG.integers(0, 8, 200).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    qs = [0, 0.2, 0.4, 0.6, 0.8, 1]
    got = Z.bucket(df, "x", Z.fit_edges(df, "x", qs), "b").groupBy("x").agg(F.max("b").alias("b")).toPandas().set_index("x")["b"]
    want = pd.Series(pd.qcut(x, 5, labels=False, duplicates="drop"), index=x).groupby(level=0).max()
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_constant_path(spark):
    df = spark.createDataFrame([("m", i, 0.5) for i in range(20)], "market_id string, ts int, p double")
    a = Y.trajectory_features(df, ["market_id"], ["ts"], "a").first()
    assert a["realized_volatility"] == 0 and a["max_drawdown"] == 0 and a["reversals"] == 0
    assert a["shannon_entropy"] == 0 and a["skewness"] is None and a["autocorrelation"] is None
    b = Y.trajectory_features(df, ["market_id"], ["ts"], "b").first()
    assert b["entropy"] == 0 and b["realized_volatility"] == 0


def test_schema_check(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert D.schema_check(df, ["a", "b"]) == []
    assert D.schema_check(df, ["b", "a"]) == [("order", "a,b")]
    assert D.schema_check(df, ["a", "c"]) == [("missing", "c"), ("extra", "b")]
    assert D.schema_check(df, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])) == [("type", "a")]


def test_list_strings(spark):
    rows = [('["Yes", "No"]', '["1", "2"]', '["0.995", "0.005"]'), ('["A", "B"]', '["7", "8"]', '["0.4", "0.6"]'), ("junk", None, '["1"]'), (None, "[]", '["0", "1"]')]
    df = spark.createDataFrame(rows, "o string, t string, p string").coalesce(1)
    got = df.select(S.yes_token("o", "t").alias("y"), S.binary_outcome("p").alias("b")).collect()
    assert [(r.y, r.b) for r in got] == [("1", 1), ("7", None), (None, None), (None, 0)]


def test_leave_one_out_and_discriminant(spark):
    n = 14
    y = np.arange(n) % 2
    x1 = RNG.normal(0, 0.3, n) + y * 3
    x2 = RNG.normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "y": y, "x1": x1, "x2": x2}))
    # x1 alone separates the classes, so every left-out row must be right; x2 is noise
    out = M.cross_validate(df.filter("id < 6"), ["x1"], "y", "id", M.logistic(regParam=0.1), k=None)
    assert sorted(r["id"] for r in out.collect()) == list(range(6)) and out.filter("label = prediction").count() == 6
    scored = M.fit_lda2(df, ["x1", "x2"], "y")(df).toPandas()
    a, b = np.c_[x1, x2][y == 1], np.c_[x1, x2][y == 0]
    pooled = ((len(a) - 1) * np.cov(a.T) + (len(b) - 1) * np.cov(b.T)) / (n - 2)
    w = np.linalg.solve(pooled, a.mean(0) - b.mean(0))
    want = np.c_[x1, x2] @ w - 0.5 * w @ (a.mean(0) + b.mean(0))
    np.testing.assert_allclose(scored.sort_values("id")["score"], want, rtol=1e-8)


def test_leave_one_out_equals_refits(spark):
    n = 40
    y = (RNG.random(n) < 0.4).astype(int)
    x = RNG.normal(0, [1, 30, 0.01], (n, 3)) + np.outer(y, [1.2, 10, 0.0])
    frame = pd.DataFrame({"id": np.arange(n), "y": y, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2]})
    got = M.leave_one_out_lda2(spark.createDataFrame(frame), ["x1", "x2", "x3"], "y").toPandas().sort_values("id")
    want = []
    for i in range(n):
        rest = np.arange(n) != i
        a, b = x[rest & (y == 1)], x[rest & (y == 0)]
        pooled = ((len(a) - 1) * np.cov(a.T) + (len(b) - 1) * np.cov(b.T)) / (n - 3)
        w = np.linalg.solve(pooled, a.mean(0) - b.mean(0))
        want.append(x[i] @ w - 0.5 * w @ (a.mean(0) + b.mean(0)) + np.log(len(a) / len(b)))
    np.testing.assert_allclose(got["score"], want, rtol=1e-8, atol=1e-10)
    assert list(got["prediction"]) == [int(s > 0) for s in want] and list(got.columns) == ["id", "y", "x1", "x2", "x3", "score", "prediction"]


def test_leave_one_out_of_lone_and_missing_rows(spark):
    rows = [(1, 1, 5.0), (2, 0, 1.0), (3, 0, 2.0), (4, 0, 4.0), (5, 0, None), (6, None, 3.0)]
    got = {r["id"]: (r["score"], r["prediction"]) for r in M.leave_one_out_lda2(spark.createDataFrame(rows, "id int, y int, x double").filter("id < 5"), ["x"], "y").collect()}
    # without row 1 there is no class 1 left
    assert got[1] == (None, 0) and all(got[i][0] is not None for i in (2, 3, 4))
    full = spark.createDataFrame(rows, "id int, y int, x double")
    got = {r["id"]: r["prediction"] for r in M.leave_one_out_lda2(full.filter("id <> 5"), ["x"], "y").collect()}
    assert got[6] is None
    with pytest.raises(ValueError, match="rows of both"):
        M.leave_one_out_lda2(full.filter("y = 0"), ["x"], "y")


def test_leave_one_out_by_fits_is_bounded(spark):
    df = spark.range(30).selectExpr("id", "id % 2 AS y", "double(id) AS x")
    with pytest.raises(ValueError, match="30 fits"):
        M.cross_validate(df, ["x"], "y", "id", k=None, most_fits=29)


def test_two_stages_beat_the_majority(spark):
    n = 900
    kind = RNG.choice(3, n, p=[0.25, 0.5, 0.25])
    frame = pd.DataFrame({"id": np.arange(n), "label": kind.astype(float), "size": RNG.normal(0, 0.3, n) + (kind != 1), "sign": RNG.normal(0, 0.4, n) + np.where(kind == 1, 0, kind - 1)})
    data = M.assemble(spark.createDataFrame(frame), ["size", "sign"])
    train, test = data.filter("id % 3 <> 0"), data.filter("id % 3 = 0")
    scored = M.two_stage(max_iter=5).fit(train).transform(test)
    got = scored.toPandas()
    np.testing.assert_allclose(got[["p_down", "p_flat", "p_up"]].sum(axis=1), 1.0)
    best = got[["p_down", "p_flat", "p_up"]].to_numpy().argmax(axis=1)
    assert (got["prediction"] == best).all() and (got["prediction"] == got["label"]).mean() > 0.75
    assert set(scored.columns) == {*test.columns, "p_down", "p_flat", "p_up", "prediction"}


def test_codes_of_many_labels(spark):
    from tickweave.operators import prep

    df = spark.range(5_000).selectExpr("id", "IF(id % 50 = 0, NULL, concat('http://host/', md5(string(id % 3000)))) AS label")
    got = prep.encode(df, "label", "code").toPandas()
    labels = sorted(got["label"].dropna().unique())
    assert len(got) == 5_000 and got.loc[got["label"].isna(), "code"].isna().all()
    known = got.dropna(subset=["label"])
    assert (known["code"].astype(int).to_numpy() == known["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()).all()


def test_same_order_takes_an_order_for_each_side(spark):
    from tickweave.operators import select

    a = spark.createDataFrame([(i, -i, f"k{i:03d}") for i in range(30)], "x int, y int, k string")
    assert select.same_order(a, a, "x", ["k"]).first()[0] == 0
    assert select.same_order(a, a, "x", ["k"], ["y"]).first()[0] == 30


def test_scales_of_all_folds_come_from_one_aggregate(spark, monkeypatch):
    rows = [(i, float(RNG.normal()), float(i % 7) if i % 11 else None, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    folds = M.stratified_folds(df, "y", "id", 3).localCheckpoint()
    for i, scale in enumerate(M.fold_scales(folds, ["a", "b"], 3)):
        assert scale.first().asDict() == pytest.approx(M.fit_scale(folds.filter(F.col("fold") != i), ["a", "b"]).first().asDict())
    monkeypatch.setattr(M, "fit_scale", lambda *_: pytest.fail("a scale was fitted fold by fold"))
    out = M.cross_validate(df.fillna(0.0), ["a", "b"], "y", "id", k=3)
    assert sorted(r["id"] for r in out.collect()) == list(range(300))


def test_trees_on_cells_equal_trees_on_rows(spark):
    rows = [(float(RNG.integers(5)), float(RNG.integers(3)) / 10) for _ in range(4000)]
    df = spark.createDataFrame([(a, b, float(RNG.random() < 0.15 + 0.6 * (a > 2) * (b < 0.15))) for a, b in rows], "a double, b double, label double")
    train, test = df.limit(3000).localCheckpoint(), df.localCheckpoint()
    models = M.tree_models() | {"forest": M.RandomForestClassifier(numTrees=5, maxDepth=4, seed=42, labelCol="label", featuresCol="features")}
    cells = {r["model"]: r for r in M.compare_on_cells(train, test, ["a", "b"], models).collect()}
    whole = {r["model"]: r for r in M.compare_models(M.assemble(train, ["a", "b"]), M.assemble(test, ["a", "b"]), models).collect()}
    for name in ("tree", "boosting"):
        assert cells[name] == whole[name]
    assert cells["forest"]["accuracy"] == pytest.approx(whole["forest"]["accuracy"], abs=0.03)


def test_bins_of_many_values_are_bounded(spark):
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 3).cast("double").alias("few"), F.lit(1.0).alias("label"))
    binned = M.bin_splits(df, ["x", "few"])
    cells = M.cells_of(df, ["x", "few"], binned)
    assert cells.count() == 32 * 3 and cells.agg(F.sum("n")).first()[0] == 5000


def test_tree_query_fits_counted_cells(spark, monkeypatch):
    from tickweave.catalog import models as C

    seen, tree, fit = [], M.tree_models()["tree"], M.DecisionTreeClassifier.fit
    monkeypatch.setattr(M, "tree_models", lambda: {"tree": tree})
    monkeypatch.setattr(M.DecisionTreeClassifier, "fit", lambda self, df, params=None: seen.append(df.columns) or fit(self, df, params))
    assert {r["model"] for r in C.tree_models(spark, "/root/testdata/sf0.001").collect()} == {"tree", "perceptron"}
    assert all("n" in columns for columns in seen) and seen
