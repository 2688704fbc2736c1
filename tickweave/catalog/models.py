"""Queries for feature preparation, Spark ML models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import panel, paths, r6, table
from tickweave.catalog.panel_paths import ORDER, split_panel
from tickweave.functions import panel as P
from tickweave.operators import evaluate as V
from tickweave.operators import models as M
from tickweave.operators import prep as Z
from tickweave.operators import trajectory as T
from tickweave.plans.registry import register
from tickweave.plans.spread import beside
from tickweave.session import cut, stored

NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lines(spark, sf):
    """Line items with a row id, a 0/1 label and a crude score."""
    line = table(spark, sf, "lineitem")
    return line.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), "l_shipdate", "l_returnflag", *NUM,
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))


@register("m01_impute", """WITH t AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), m AS (SELECT median(quality) AS q, median(toxic) AS x FROM t)
SELECT doc_id, coalesce(quality, q)::DOUBLE AS quality, coalesce(toxic, x)::DOUBLE AS toxic FROM t, m""")
def impute(spark, sf):
    t = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return Z.apply_impute(t, Z.fit_impute(t, ["quality", "toxic"]))


@register("m02_fill_defaults", """WITH t AS (SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM t)), 6) AS quality, coalesce(toxic, (SELECT toxic FROM t WHERE toxic IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, toxic LIMIT 1)) AS toxic FROM t""")
def fill_defaults(spark, sf):
    t = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    t = t.withColumns({"quality": F.col("quality").cast("double"), "toxic": F.col("toxic").cast("double")})
    return Z.fill_defaults(t, {"quality": "mean", "toxic": "mode"}).withColumn("quality", r6("quality"))


@register("m03_standardise", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def standardise(spark, sf):
    return Z.standardise(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", r6("c_acctbal"))


@register("m04_minmax", "WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS scaled, round(c_acctbal, 4) AS restored FROM customer, b")
def minmax(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("scaled"))
    fitted = Z.fit_minmax(c, ["scaled"])
    both = Z.minmax(c, ["scaled"], fitted).withColumn("copy", F.col("scaled"))
    back = Z.inverse_minmax(both.select("c_custkey", F.col("copy").alias("scaled")), ["scaled"], fitted).select("c_custkey", r6("scaled", 4).alias("restored"))
    return both.select("c_custkey", r6("scaled").alias("scaled")).join(back, "c_custkey")


@register("m05_cap_quantiles", "WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT event_id, round(ln(1 + least(greatest(value, lo), hi)), 6) AS value FROM events, b")
def cap_quantiles(spark, sf):
    return Z.cap_quantiles(table(spark, sf, "events").select("event_id", "value"), ["value"]).withColumn("value", r6("value"))


@register("m06_encode", "SELECT o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code, sum((o_totalprice >= 200000)::INT)::BIGINT AS n_large FROM orders GROUP BY 1")
def encode(spark, sf):
    o = Z.threshold_flag(Z.encode(table(spark, sf, "orders"), "o_orderpriority", "code"), "o_totalprice", 200_000, "large")
    return o.groupBy("o_orderpriority", "code").agg(F.sum("large").alias("n_large"))


@register("m07_pca")
def pca(spark, sf):
    scores, shares = M.pca(table(spark, sf, "lineitem"), NUM)
    cells = [F.struct(F.lit(i + 1).alias("component"), F.round(F.lit(s), 4).alias("share"), F.round(F.var_pop(f"pc{i + 1}"), 4).alias("variance")) for i, s in enumerate(shares)]
    return scores.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


FEATURES = ("probability_range", "trend", "max_drawdown", "realized_volatility")


def path_table(spark, sf):
    t = T.trajectory_features(paths(spark, sf), ["market_id"], ORDER, "b").select("market_id", *FEATURES)
    return Z.apply_impute(t, Z.fit_impute(t, FEATURES))


@register("m08_silhouettes")
def silhouettes(spark, sf):
    return M.silhouettes(path_table(spark, sf), FEATURES, [2, 3, 4]).withColumn("silhouette", r6("silhouette", 4))


@register("m08_regimes")
def regimes(spark, sf):
    r = M.regimes(path_table(spark, sf), FEATURES, "max_drawdown", ("Anchored / Noisy", "Information Processing"))
    return r.groupBy("market_regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("max_drawdown"), 4).alias("mean_scaled_drawdown"))


@register("m09_logistic")
def logistic(spark, sf):
    _, coefficients = M.fit_logit(lines(spark, sf), NUM, "y")
    return coefficients.withColumn("coefficient", r6("coefficient", 3))


@register("m10_cross_validation")
def cross_validation(spark, sf):
    scored = M.cross_validate(lines(spark, sf), NUM, "y", "id", k=3)
    return V.class_metrics(scored, "label", "prediction").select(*[r6(c, 4).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


# every row's scores from the sums of all other rows, solved as 2 by 2 systems
_LOO = """WITH t AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS z, (l_returnflag = 'R')::INT AS y FROM lineitem),
s AS (SELECT y, count(*) AS n, avg(x) AS mx, avg(z) AS mz, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, covar_pop(x, z) * count(*) AS xz FROM t GROUP BY y),
r AS (SELECT t.*, own.n - 1 AS own_n, (own.mx * own.n - x) / (own.n - 1) AS omx, (own.mz * own.n - z) / (own.n - 1) AS omz,
  own.xx + other.xx - (x - own.mx) ^ 2 * own.n / (own.n - 1) AS xx, own.zz + other.zz - (z - own.mz) ^ 2 * own.n / (own.n - 1) AS zz,
  own.xz + other.xz - (x - own.mx) * (z - own.mz) * own.n / (own.n - 1) AS xz, other.n AS en, other.mx AS emx, other.mz AS emz
  FROM t JOIN s own ON own.y = t.y JOIN s other ON other.y <> t.y),
d AS (SELECT *, CASE WHEN y = 1 THEN 1 ELSE -1 END AS sgn, x - (omx + emx) / 2 AS gx, z - (omz + emz) / 2 AS gz, omx - emx AS hx, omz - emz AS hz, xx * zz - xz * xz AS det FROM r),
c AS (SELECT y, sgn * ((own_n + en - 2) * (gx * (zz * hx - xz * hz) + gz * (xx * hz - xz * hx)) / det + ln(own_n / en)) AS score FROM d)"""


@register("m10_leave_one_out", f"{_LOO} SELECT y, (score > 0)::INT AS prediction, count(*) AS n, round(avg(score), 6) AS mean_score FROM c GROUP BY 1, 2")
def leave_one_out(spark, sf):
    rows = lines(spark, sf).select("y", "l_quantity", (F.col("l_extendedprice") / 1000).alias("thousands"))
    scored = M.leave_one_out_lda2(rows, ["l_quantity", "thousands"], "y")
    return scored.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_score"))


@register("m10_fold_sizes", """WITH r AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ('0x' || substr(md5('0-' || o_orderkey), 1, 15))::BIGINT, o_orderkey) - 1 AS pos FROM orders) SELECT o_orderstatus, (pos % 5)::INT AS fold, count(*) AS n FROM r GROUP BY 1, 2""")
def fold_sizes(spark, sf):
    f = Z.stratified_folds(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 5)
    return f.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


def binary_split(spark, sf):
    data = Z.stratified_split(lines(spark, sf).select("id", "y", *NUM), "y", "id")
    data = stored(data.select(F.col("y").cast("double").alias("label"), "is_train", *NUM), "split")
    return data.filter("is_train"), data.filter("NOT is_train")


@register("m11_tree_models")
def tree_models(spark, sf):
    train, test = binary_split(spark, sf)
    trees = M.compare_on_cells(train, test, NUM, M.tree_models())
    net = M.compare_models(M.assemble(train, NUM), M.assemble(test, NUM), {"perceptron": M.perceptron(len(NUM), 2)}, kept=True)
    return trees.unionByName(net).select("model", *[r6(c, 3).alias(c) for c in ("accuracy", "macro_f1")])


PANEL_COLS = ("path_return_bps", "realized_vol_bps", "path_efficiency", "late_vol_share", "sign_persistence")


def panel_split(spark, sf):
    p = P.path_features(split_panel(spark, sf), "r").withColumn("label", (F.col("reod") + 1).cast("double"))
    data = M.assemble(p.select("day", "is_train", "label", *PANEL_COLS), PANEL_COLS)
    return data.filter("is_train"), data.filter("NOT is_train")


@register("m12_multiclass_boosting")
def multiclass_boosting(spark, sf):
    train, test = panel_split(spark, sf)
    return M.compare_models(train, test, {"boosting": M.multiclass_boost()}).select("model", *[r6(c, 3).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@register("m12_two_stage")
def two_stage(spark, sf):
    train, test = panel_split(spark, sf)
    return M.compare_models(train, test, {"two stages": M.two_stage()}).select("model", *[r6(c, 3).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@register("m12_config_sweep")
def config_sweep(spark, sf):
    train, _ = panel_split(spark, sf)
    inner = train.withColumn("late", F.col("day") > 15)
    out = M.config_sweep(inner.filter("NOT late"), inner.filter("late"), M.multiclass_boost, {"max_iter": [3], "max_depth": [2, 3]})
    return out.select("setting", r6("accuracy", 3).alias("accuracy"), r6("macro_f1", 3).alias("macro_f1"))


@register("m13_linear_discriminant")
def linear_discriminant(spark, sf):
    data = Z.stratified_split(lines(spark, sf).select("id", "y", *NUM), "y", "id")
    # read for the classes and, several times, for the ranks of the scores
    scored = cut(M.fit_lda2(data.filter("is_train"), NUM, "y")(data.filter("NOT is_train")).select("y", "score", "prediction"))
    both = beside(V.class_metrics(scored, "y", "prediction"), V.roc_auc(scored, "y", "score"))
    return both.select(r6("accuracy", 4).alias("accuracy"), r6("auc", 4).alias("auc"))


@register("m14_pca_tree_grid")
def pca_tree_grid(spark, sf):
    p = P.path_features(panel(spark, sf), "r").withColumn("label", (F.col("reod") + 1).cast("double")).select("label", *PANEL_COLS)
    return M.pca_tree_grid(p, PANEL_COLS, [2, 3], [2, 4]).withColumn("accuracy", r6("accuracy", 3))


_PRED = "p AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'R' WHEN l_quantity < 35 THEN 'A' ELSE 'N' END AS yhat FROM lineitem)"


def predicted(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 15, "R").when(q < 35, "A").otherwise("N").alias("yhat"))


_PC = f"""{_PRED}, k AS (SELECT unnest(['A', 'N', 'R']) AS c), s AS (SELECT c, count(*) FILTER (y = c AND yhat = c) AS hit, count(*) FILTER (y = c) AS tr, count(*) FILTER (yhat = c) AS sd FROM p, k GROUP BY 1),
pc AS (SELECT c, coalesce(hit / nullif(sd, 0), 0) AS pr, coalesce(hit / nullif(tr, 0), 0) AS rc, tr, hit FROM s), pf AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM pc)"""


@register("m15_per_class", f"WITH {_PC} SELECT c AS \"class\", round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, tr AS support FROM pf")
def per_class(spark, sf):
    return V.per_class(predicted(spark, sf), "y", "yhat").select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@register("m15_class_metrics", f"WITH {_PC} SELECT round(sum(hit) / sum(tr), 6) AS accuracy, round(avg(rc), 6) AS balanced_accuracy, round(avg(pr), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM pf")
def class_metrics(spark, sf):
    m = V.class_metrics(predicted(spark, sf), "y", "yhat")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("m15_confusion", f"WITH {_PRED} SELECT y, yhat, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM p GROUP BY 1, 2")
def confusion(spark, sf):
    return V.confusion(predicted(spark, sf), "y", "yhat").withColumn("share", r6("share"))


@register("m16_roc_auc", "WITH r AS (SELECT (l_returnflag = 'R')::INT AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem), s AS (SELECT sum(rk) FILTER (y = 1) AS r1, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM r) SELECT round((r1 - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM s")
def roc_auc(spark, sf):
    return V.roc_auc(lines(spark, sf), "y", "l_quantity").withColumn("auc", r6("auc"))


@register("m16_roc_curve", "WITH g AS (SELECT l_quantity AS threshold, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS f FROM lineitem GROUP BY 1) SELECT threshold, round(sum(p) OVER (ORDER BY threshold DESC) / (SELECT sum(p) FROM g), 6) AS tpr, round(sum(f) OVER (ORDER BY threshold DESC) / (SELECT sum(f) FROM g), 6) AS fpr FROM g")
def roc_curve(spark, sf):
    return V.roc_curve(lines(spark, sf), "y", "l_quantity").select("threshold", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@register("m17_regression_errors", "SELECT round(sqrt(avg(pow(l_extendedprice - l_quantity * 2500, 2))), 4) AS rmse, round(avg(abs(l_extendedprice - l_quantity * 2500)), 4) AS mae FROM lineitem")
def regression_errors(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 2500)
    return V.regression_errors(line, "l_extendedprice", "guess").select(r6("rmse", 4).alias("rmse"), r6("mae", 4).alias("mae"))


@register("m18_dummy", "WITH t AS (SELECT l_shipdate < TIMESTAMP '1999-01-01' AS tr, l_returnflag AS y FROM lineitem), b AS (SELECT y FROM t WHERE tr GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1) SELECT t.y, b.y AS prediction, count(*) AS n FROM t, b WHERE NOT tr GROUP BY 1, 2")
def dummy(spark, sf):
    line = table(spark, sf, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("y"))
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return V.dummy(line.filter(early), line.filter(~early), "y").groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


@register("m19_group_split", "SELECT user_id, ('0x' || substr(md5('0-' || user_id), 1, 15))::BIGINT / 1152921504606846976.0 < 0.8 AS is_train, count(*) AS n FROM events GROUP BY 1, 2")
def group_split(spark, sf):
    return Z.group_split(table(spark, sf, "events"), "user_id").groupBy("user_id", "is_train").agg(F.count(F.lit(1)).alias("n"))
