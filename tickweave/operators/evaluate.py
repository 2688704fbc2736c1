"""Evaluation of predictions: counts merge per (class, prediction) before anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.plans.order_stats import value_ranks
from tickweave.plans.series import running


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Counts per (true, predicted) and the share within the true class (a class-sized table)."""
    counts = df.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(y)))


def per_class(df: DataFrame, y: str, yhat: str, count: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each class; undefined values are 0. ``count``: so many rows a row stands for."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("p")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))
    cells = F.array(
        F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said")),
    )
    sums = pairs.select(F.explode(cells).alias("c")).groupBy("c.class").agg(*[F.sum(f"c.{k}").alias(k) for k in ("hit", "true", "said")])
    zero = F.lit(0.0)
    p, r = F.coalesce(ratio("hit", "said"), zero), F.coalesce(ratio("hit", "true"), zero)
    return sums.select(
        "class", p.alias("precision"), r.alias("recall"), F.coalesce(ratio(2 * p * r, p + r), zero).alias("f1"), F.col("true").alias("support"), F.col("hit").alias("n_hit")
    )


def class_metrics(df: DataFrame, y: str, yhat: str, count: str | None = None) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro precision / recall / F1."""
    c = per_class(df, y, yhat, count)
    seen = F.col("support") > 0
    return c.agg(
        ratio(F.sum("n_hit"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks (ties count half)."""
    ranks = value_ranks(df, score, extra={"n1": F.sum(F.col(y).cast("bigint"))})
    s = ranks.agg(F.sum(F.col("n1") * F.col("rank")).alias("_r"), F.sum("n1").cast("double").alias("_p"), F.sum("n").cast("double").alias("_n"))
    p, n = F.col("_p"), F.col("_n") - F.col("_p")
    return s.select(ratio(F.col("_r") - p * (p + 1) / 2, p * n).alias("auc"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score: predicted positive = score ≥ threshold."""
    per = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(y).cast("bigint")).alias("_p"), F.sum(1 - F.col(y).cast("bigint")).alias("_f"))
    flipped = per.withColumn("_o", -F.col("threshold"))
    cum = running(flipped, [], ["_o"], {"_tp": ("sum", "_p"), "_fp": ("sum", "_f")})
    total = per.agg(F.struct(F.sum("_p").alias("p"), F.sum("_f").alias("f"))).scalar()
    return cum.withColumn("_t", total).select("threshold", ratio("_tp", F.col("_t.p")).alias("tpr"), ratio("_fp", F.col("_t.f")).alias("fpr"))


def regression_errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def dummy(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Most frequent train class as the prediction on every test row."""
    counts = train.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.desc("_n"), F.asc(y)).limit(1).select(y).scalar()
    return test.withColumn("prediction", best)
