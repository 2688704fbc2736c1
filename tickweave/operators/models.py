"""Spark ML models as used by the analyses; loops on the driver run over folds and settings only.

Training data that several fits read is checkpointed once, so no fit repeats the
feature plan and a lost executor does not restart it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators.evaluate import class_metrics
from tickweave.operators.prep import fit_scale, standardise, stratified_folds
from tickweave.plans.series import index_rows
from tickweave.session import cut, stored


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector; a missing value is an error, so rows are never skipped: impute first (``prep.apply_impute``)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


# --- PCA and clusters ---------------------------------------------------------------------


def pca(df: DataFrame, cols: Sequence[str], k: int | None = None, var: float = 0.8) -> tuple[DataFrame, list[float]]:
    """Scores pc1..pck of standardised columns and the explained shares.

    Without ``k`` the smallest k reaching ``var`` is taken. The largest loading
    of each component is made positive, so signs do not depend on the solver.
    """
    data = assemble(standardise(df, cols), cols)
    model = PCA(k=len(cols) if k is None else k, inputCol="features", outputCol="_pc").fit(data)
    shares = model.explainedVariance.toArray().tolist()
    keep = k or int(np.searchsorted(np.cumsum(shares), var) + 1)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(keep)]
    scores = model.transform(data).withColumn("_pc", vector_to_array("_pc"))
    out = scores.withColumns({f"pc{i + 1}": F.col("_pc")[i] * s for i, s in enumerate(signs)}).drop("_pc", "features")
    return out, shares[:keep]


def silhouettes(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    data = cut(assemble(standardise(df, cols), cols).select("features"))
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(data).transform(data)))) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def regimes(df: DataFrame, cols: Sequence[str], profile: str, names: Sequence[str], seed: int = 42) -> DataFrame:
    """k-means clusters named by their mean of ``profile``, lowest first (cluster ids carry no meaning)."""
    data = cut(assemble(standardise(df.withColumn("_profile", F.col(profile)), cols), cols))
    labelled = KMeans(k=len(names), seed=seed, predictionCol="cluster").fit(data).transform(data)
    order = [r["cluster"] for r in labelled.groupBy("cluster").agg(F.avg("_profile").alias("m")).orderBy("m").collect()]
    mapping = F.create_map(*[x for c, n in zip(order, names) for x in (F.lit(c), F.lit(n))])
    keep = [c for c in df.columns if c not in cols]
    return labelled.select(*keep, *[c for c in cols], "cluster", F.try_element_at(mapping, F.col("cluster")).alias("market_regime"))


# --- classifiers ---------------------------------------------------------------------------


def logistic(**params) -> LogisticRegression:
    return LogisticRegression(labelCol="label", featuresCol="features", **({"maxIter": 100, "regParam": 0.0} | params))


def fit_logit(train: DataFrame, cols: Sequence[str], y: str, scale: bool = True):
    """Logistic regression on standardised columns → (scorer, coefficient table)."""
    fitted = fit_scale(train, cols) if scale else None

    def prepare(d):
        d = standardise(d, cols, fitted) if scale else d
        return assemble(d.withColumn("label", F.col(y).cast("double")), cols)

    model = logistic().fit(prepare(train))
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients)] + [("intercept", float(model.intercept))]
    table = train.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return (lambda d: model.transform(prepare(d))), table


def tree_models(seed: int = 42) -> dict[str, Estimator]:
    """Forest, boosted trees and a single tree with the settings of the studies."""
    base = {"labelCol": "label", "featuresCol": "features", "seed": seed}
    return {
        "forest": RandomForestClassifier(numTrees=50, maxDepth=8, **base),
        "boosting": GBTClassifier(maxIter=20, maxDepth=3, **base),
        "tree": DecisionTreeClassifier(maxDepth=5, **base),
    }


def perceptron(n_inputs: int, n_classes: int, hidden: Sequence[int] = (16,), seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_inputs, *hidden, n_classes], maxIter=60, seed=seed, labelCol="label", featuresCol="features")


def multiclass_boost(max_iter: int = 10, max_depth: int = 3, seed: int = 42) -> OneVsRest:
    """Boosting for more than two classes: one binary booster per class."""
    return OneVsRest(classifier=GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed), labelCol="label", featuresCol="features")


@dataclass
class TwoStage:
    """Three classes by two chained models: does it move, and if it does, up or down.

    Labels are 0 (down), 1 (flat) and 2 (up). The second model is fitted on the moving rows of the training
    part only; the class probabilities are the products along the chain.
    """

    move: Estimator
    direction: Estimator

    def fit(self, train: DataFrame) -> TwoStageModel:
        train = cut(train)
        moves = F.col("label") != 1.0
        first = self.move.fit(train.withColumn("label", moves.cast("double")))
        second = self.direction.fit(train.filter(moves).withColumn("label", (F.col("label") == 2.0).cast("double")))
        return TwoStageModel(first, second)


@dataclass
class TwoStageModel:
    move: Transformer
    direction: Transformer

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p_down``, ``p_flat``, ``p_up`` and ``prediction``, the likeliest of them (ties: flat, then up)."""
        out = df
        for model, name in ((self.move, "_moves"), (self.direction, "_rises")):
            scored = model.transform(out).withColumn(name, vector_to_array("probability")[1])
            out = scored.select(*out.columns, name)
        moves, rises = F.col("_moves"), F.col("_rises")
        out = out.withColumns({"p_down": moves * (1 - rises), "p_flat": 1 - moves, "p_up": moves * rises}).drop("_moves", "_rises")
        best = F.greatest("p_down", "p_flat", "p_up")
        return out.withColumn("prediction", F.when(F.col("p_flat") == best, 1.0).when(F.col("p_up") == best, 2.0).otherwise(0.0))


def two_stage(max_iter: int = 10, max_depth: int = 3, seed: int = 42) -> TwoStage:
    """Boosted trees in both stages."""
    base = {"labelCol": "label", "featuresCol": "features", "maxIter": max_iter, "maxDepth": max_depth, "seed": seed}
    return TwoStage(GBTClassifier(**base), GBTClassifier(**base))


def compare_models(train: DataFrame, test: DataFrame, models: dict[str, Estimator | TwoStage], kept: bool = False) -> DataFrame:
    """Metrics of several estimators on one split; inputs carry features and label. ``kept``: they are read from a store already."""
    if not kept:
        train, test = cut(train), cut(test)
    out = None
    for name, est in models.items():
        scored = est.fit(train).transform(test)
        row = class_metrics(scored, "label", "prediction").select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


#: Bins that tree models cut a feature into at most, the default of ``maxBins``; fits of single trees that run at a time.
BINS, AT_A_TIME = 32, 4


def bin_splits(train: DataFrame, cols: Sequence[str], bins: int = BINS) -> Bucketizer:
    """Cuts each column into ``bins`` bins at most: one a value where a column has so few, else between quantiles of all rows."""
    shares = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in cols], *[F.percentile_approx(c, shares).alias(f"q_{c}") for c in cols]).first()
    splits = []
    for c in cols:
        values = [r[0] for r in train.select(c).distinct().limit(bins + 1).collect()] if row[f"n_{c}"] <= 2 * bins else []
        inner = sorted(values)[1:] if 0 < len(values) <= bins else sorted(set(row[f"q_{c}"]))
        splits.append([-np.inf, *map(float, inner), np.inf])
    return Bucketizer(splitsArray=splits, inputCols=list(cols), outputCols=[f"_bin_{c}" for c in cols])


def cells_of(df: DataFrame, cols: Sequence[str], binned: Bucketizer) -> DataFrame:
    """Rows that agree in label and in the bins of all columns, counted in ``n``; ``features`` holds the bins."""
    names = binned.getOutputCols()
    return assemble(binned.transform(df).groupBy("label", *names).agg(F.count(F.lit(1)).alias("n")), names)


@dataclass
class CellForest:
    """A forest fitted on counted cells. A row stands in a tree's bootstrap a Poisson(1) number of times, so a cell of n rows a Poisson(n) number."""

    forest: RandomForestClassifier

    def fit(self, cells: DataFrame) -> CellForestModel:
        trees, seed = self.forest.getNumTrees(), self.forest.getSeed()
        names = [c for c in cells.columns if c not in ("label", "n", "features")]

        def draw(batches):
            for batch in batches:
                keys = zip(*[batch.column(c).to_pylist() for c in ("label", *names)], strict=True)
                drawn = [np.random.default_rng([seed, *map(int, key)]).poisson(n, trees) for key, n in zip(keys, batch.column("n").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.list_(pa.int64()))], names=[*batch.schema.names, "_drawn"])

        slim = cells.drop("features")
        drawn = cut(assemble(slim.mapInArrow(draw, T.StructType([*slim.schema.fields, T.StructField("_drawn", T.ArrayType(T.LongType()))])), names))
        strategy = "sqrt" if self.forest.getFeatureSubsetStrategy() == "auto" else self.forest.getFeatureSubsetStrategy()

        def one(i: int):
            tree = self.forest.copy({self.forest.numTrees: 1, self.forest.bootstrap: False, self.forest.featureSubsetStrategy: strategy, self.forest.seed: seed + i})
            tree = tree.setWeightCol("_w").setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_share")
            return tree.fit(drawn.select("label", "features", F.col("_drawn")[i].cast("double").alias("_w")).filter("_w > 0"))

        with ThreadPool(AT_A_TIME) as pool:
            return CellForestModel(pool.map(inheritable_thread_target(cells.sparkSession)(one), range(trees)))


@dataclass
class CellForestModel:
    trees: list[Transformer]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the label with the largest sum of the trees' shares (ties: the smallest)."""
        out, votes = df, []
        for i, tree in enumerate(self.trees):
            out = tree.setProbabilityCol(f"_share{i}").transform(out)
            votes.append(vector_to_array(f"_share{i}"))
        total = F.array(*[sum((v[k] for v in votes[1:]), votes[0][k]) for k in range(self.trees[0].numClasses)])
        best = F.array_position(total, F.array_max(total)) - 1
        return out.withColumn("prediction", best.cast("double")).drop(*[f"_share{i}" for i in range(len(self.trees))])


def compare_on_cells(train: DataFrame, test: DataFrame, cols: Sequence[str], models: dict[str, Estimator]) -> DataFrame:
    """``compare_models`` for tree models over few columns; inputs carry the columns and label.

    A tree sees of a row its bins and its label only, so rows that agree in these are one weighted row. Every row is read three times
    for that, whatever the models; fits and scores then read the cells, of which there are at most bins ** columns a label.
    """
    binned = bin_splits(train, cols)
    train, test = cut(cells_of(train, cols, binned)), cut(cells_of(test, cols, binned))
    out = None
    for name, est in models.items():
        est = CellForest(est) if isinstance(est, RandomForestClassifier) else est.copy().setWeightCol("n")
        row = class_metrics(est.fit(train).transform(test), "label", "prediction", "n").select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def config_sweep(train: DataFrame, valid: DataFrame, make: Callable[..., Estimator], grid: dict[str, Sequence]) -> DataFrame:
    """Every setting scored on an inner split, best macro-F1 first."""
    train, valid = cut(train), cut(valid)
    rows = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values))
        scored = make(**setting).fit(train).transform(valid)
        m = class_metrics(scored, "label", "prediction").first()
        rows.append((str(setting), float(m["accuracy"]), float(m["balanced_accuracy"]), float(m["macro_f1"])))
    out = train.sparkSession.createDataFrame(rows, "setting string, accuracy double, balanced_accuracy double, macro_f1 double")
    return out.orderBy(F.desc("macro_f1"), "setting")


def fold_scales(folds: DataFrame, cols: Sequence[str], k: int) -> list[DataFrame]:
    """``fit_scale`` of the rows outside each of the folds 0 .. k-1, by one aggregate; one row a fold, of literals."""
    names = [f"{figure}_{c}" for figure in ("mean", "std") for c in cols]
    rest = {(c, i): F.when(F.col("fold") != i, F.col(c)) for c in cols for i in range(k)}
    row = folds.agg(*[f(rest[c, i]).alias(f"{name}_{c}_{i}") for i in range(k) for name, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in cols]).first()
    one = folds.sparkSession.range(1)
    return [one.select(*[F.lit(row[f"{n}_{i}"]).cast("double").alias(n) for n in names]) for i in range(k)]


def cross_validate(
    df: DataFrame, cols: Sequence[str], y: str, row_id: str, est: Estimator | None = None, k: int | None = 5, seed: int = 0, most_fits: int = 500
) -> DataFrame:
    """Out-of-fold predictions with stratified folds; ``k=None`` leaves one row out at a time.

    Scaling is fit on each training part, for all folds in one pass over the rows. Leave-one-out needs as many fits as rows, so a table of
    more than ``most_fits`` rows is an error; ``leave_one_out_lda2`` has no such limit.
    """
    est = est or logistic()
    data = df.select(row_id, y, *cols).withColumn("label", F.col(y).cast("double"))
    if k is None:
        data = cut(data)
        k = data.count()
        if k > most_fits:
            raise ValueError(f"leaving one of {k} rows out needs {k} fits, more than {most_fits}: use folds or leave_one_out_lda2")
        folds = cut(index_rows(data, [], [row_id], "fold"))
        scales = None
    else:
        # read about twice a fold, and each time for some columns only
        folds = stored(stratified_folds(data, y, row_id, k, seed), "folds")
        scales = fold_scales(folds, cols, k)
    out = None
    for i in range(k):
        train, test = folds.filter(F.col("fold") != i), folds.filter(F.col("fold") == i)
        fitted = scales[i] if scales else fit_scale(train, cols)
        model = est.fit(assemble(standardise(train, cols, fitted), cols))
        scored = model.transform(assemble(standardise(test, cols, fitted), cols)).select(row_id, y, "label", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return out


def class_moments(train: DataFrame, cols: Sequence[str], y: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows, means and scatter about the mean of the classes 0 and 1, from one aggregate."""
    d = len(cols)
    flag = F.col(y) == 1

    def side(cond):
        xs = [F.when(cond, F.col(c).cast("double")) for c in cols]
        means = [F.avg(x) for x in xs]
        cov = [F.covar_samp(xs[i], xs[j]) for i in range(d) for j in range(i, d)]
        return F.struct(F.count(F.when(cond, 1)).alias("n"), F.array(*means).alias("mean"), F.array(*cov).alias("cov"))

    row = train.agg(side(flag).alias("one"), side(~flag).alias("zero")).first()

    def square(values):
        m = np.zeros((d, d))
        m[np.triu_indices(d)] = values
        return m + m.T - np.diag(np.diag(m))

    def moments(r):
        if r["n"] == 0:
            raise ValueError("a linear discriminant of two classes needs rows of both")
        # one row alone has no covariance and no scatter
        return r["n"], np.array(r["mean"]), (r["n"] - 1) * square(r["cov"]) if r["n"] > 1 else np.zeros((d, d))

    return [moments(row["zero"]), moments(row["one"])]


def fit_lda2(train: DataFrame, cols: Sequence[str], y: str) -> Callable[[DataFrame], DataFrame]:
    """Two-class linear discriminant: class means and pooled covariance in one aggregate, a d×d solve on the driver."""
    (n0, m0, s0), (n1, m1, s1) = class_moments(train, cols, y)
    pooled = (s1 + s0) / (n1 + n0 - 2)
    weight = np.linalg.solve(pooled, m1 - m0)
    bias = -0.5 * float(weight @ (m1 + m0)) + float(np.log(n1 / n0))

    def score(df):
        s = F.lit(bias)
        for c, w in zip(cols, weight):
            s = s + F.col(c) * F.lit(float(w))
        return df.withColumn("score", s).withColumn("prediction", (F.col("score") > 0).cast("int"))

    return score


def leave_one_out_lda2(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Score and prediction of every row by the two-class discriminant fitted on all other rows.

    No refit: taking one row out moves its class mean along the row's deviation and takes a rank-one
    matrix off the scatter, so the inverse follows by one division. One aggregate and a d×d inverse,
    then one pass of column expressions, for any number of rows. The discriminant does not depend on
    the columns' scales, so scaling inside each training part would change nothing. A row that is its class's only one
    gets the other class and a NULL score; a row without which the columns are linearly dependent, or with a
    missing feature or label, gets NULL for both.
    """
    d = len(cols)
    known = F.col(y).isNotNull()
    for c in cols:
        known = known & F.col(c).isNotNull()
    moments = class_moments(df.filter(known), cols, y)
    n = sum(m[0] for m in moments)
    # columns in which the scatter of all rows is the identity
    root = np.linalg.cholesky(np.linalg.inv(moments[0][2] + moments[1][2]))
    means = [m @ root for _, m, _ in moments]
    one = F.col(y) == 1

    def dot(u, v):
        return sum((a * b for a, b in zip(u[1:], v[1:])), u[0] * v[0])

    def names(prefix):
        return [f"_{prefix}{j}" for j in range(d)]

    def columns(prefix):
        return [F.col(c) for c in names(prefix)]

    held = F.when(one, moments[1][0]).otherwise(moments[0][0])
    z = {name: dot([F.col(c).cast("double") for c in cols], [F.lit(float(v)) for v in root[:, j]]) for j, name in enumerate(names("z"))}
    out = df.withColumn("_held", held.cast("double")).withColumns(z)
    out = out.withColumns({name: F.col(f"_z{j}") - F.when(one, float(means[1][j])).otherwise(float(means[0][j])) for j, name in enumerate(names("d"))})
    shift = {name: F.try_divide(F.col(f"_d{j}"), F.col("_held") - 1) for j, name in enumerate(names("s"))}
    out = out.withColumns(shift)
    # means of both classes without the row, as half their sum and as their difference
    ahead = {name: float(means[1][j] - means[0][j]) - F.when(one, F.col(f"_s{j}")).otherwise(-F.col(f"_s{j}")) for j, name in enumerate(names("h"))}
    centred = {name: F.col(f"_z{j}") - (float(means[1][j] + means[0][j]) - F.col(f"_s{j}")) / 2 for j, name in enumerate(names("g"))}
    out = out.withColumns(ahead | centred)
    part = F.try_divide(F.col("_held"), F.col("_held") - 1)
    left = 1 - part * dot(columns("d"), columns("d"))
    bilinear = dot(columns("g"), columns("h")) + F.try_divide(part * dot(columns("g"), columns("d")) * dot(columns("h"), columns("d")), left)
    n0, n1 = F.lit(float(moments[0][0])), F.lit(float(moments[1][0]))
    prior = F.log(F.when(one, (n1 - 1) / n0).otherwise(F.try_divide(n1, n0 - 1)))
    alone = F.col("_held") == 1
    out = out.withColumn("score", F.when(known & ~alone & (left > 1e-12), (n - 3) * bilinear + prior))
    out = out.withColumn("prediction", F.when(known & alone, (~one).cast("int")).otherwise((F.col("score") > 0).cast("int")))
    return out.drop("_held", *(c for prefix in "zdshg" for c in names(prefix)))


def pca_tree_grid(df: DataFrame, cols: Sequence[str], ks: Sequence[int], depths: Sequence[int], folds: int = 3, seed: int = 42) -> DataFrame:
    """PCA + decision tree, every (k, depth) scored by cross-validation. Input: columns and label."""
    reduce = PCA(inputCol="features", outputCol="_pc")
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="_pc", seed=seed)
    grid = ParamGridBuilder().addGrid(reduce.k, list(ks)).addGrid(tree.maxDepth, list(depths)).build()
    cv = CrossValidator(
        estimator=Pipeline(stages=[reduce, tree]), estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed, parallelism=2
    )
    model = cv.fit(cut(assemble(standardise(df, cols), cols)))
    rows = [(int(p[reduce.k]), int(p[tree.maxDepth]), float(a)) for p, a in zip(grid, model.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "k int, max_depth int, accuracy double")
