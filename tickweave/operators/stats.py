"""Tests and resampling. Heavy parts are aggregates; only finished statistics are small."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.distributions import normal_two_sided, student_two_sided
from tickweave.functions.scalars import ratio, safe_corr
from tickweave.operators.aggregates import corr_matrix
from tickweave.plans.order_stats import quantiles, quantiles_wide, value_ranks
from tickweave.plans.series import index_rows, over_series
from tickweave.plans.spread import dealt, hash_draw, permuted, round_draws, unpermuted
from tickweave.session import cut

# pointers a task looks up
POINTS = 4_000_000


def welch(df: DataFrame, group: str, y: str) -> DataFrame:
    """Two-sample t test with unequal variances; ``group`` is boolean, the difference is true - false."""
    g, v = F.col(group), F.col(y)

    def side(flag):
        x = F.when(g == flag, v)
        return F.count(x), F.avg(x), F.var_samp(x)

    (n1, m1, v1), (n0, m0, v0) = side(True), side(False)
    rows = df.agg(*[e.alias(k) for k, e in {"n1": n1, "m1": m1, "v1": v1, "n0": n0, "m0": m0, "v0": v0}.items()])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    rows = rows.withColumns(
        {
            "statistic": ratio(F.col("m1") - F.col("m0"), F.sqrt(a + b)),
            "df": ratio((a + b) ** 2, a**2 / (F.col("n1") - 1) + b**2 / (F.col("n0") - 1)),
        }
    )
    return rows.withColumn("p_value", student_two_sided("statistic", "df")).select("statistic", "df", "p_value")


def mann_whitney(df: DataFrame, group: str, y: str) -> DataFrame:
    """Two-sided U test: average ranks, tie correction, continuity correction, normal tail."""
    rows = df.filter(F.col(group).isNotNull())
    ranks = value_ranks(rows, y, extra={"n1": F.sum(F.col(group).cast("bigint"))})
    sums = ranks.agg(
        F.sum(F.col("n1") * F.col("rank")).alias("_r1"), F.sum("n1").cast("double").alias("_n1"), F.sum("n").cast("double").alias("_n"),
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_ties"),
    )
    n1, n = F.col("_n1"), F.col("_n")
    n0 = n - n1
    sums = sums.withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    larger = F.greatest(F.col("u"), n1 * n0 - F.col("u"))
    sums = sums.withColumn("z", F.greatest(ratio(larger - n1 * n0 / 2 - 0.5, spread), F.lit(0.0)))
    return sums.withColumn("p_value", normal_two_sided("z")).select("u", "z", "p_value")


def _replicates(df: DataFrame, b: int, seed: int | None = None) -> DataFrame:
    """Every row once per replicate ``b``; with a seed also ``_draws``, the keys of the replicate's permutation."""
    out = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(int(b)))))
    if seed is None:
        return out
    draws = df.sparkSession.range(1, int(b) + 1).select(F.col("id").cast("int").alias("b"), round_draws(F.col("id"), seed=seed).alias("_draws"))
    return out.join(F.broadcast(draws), "b")  # one row a replicate


def permutation_lead_score(aligned: DataFrame, lag: int, b: int, seed: int = 42, keys: Sequence[str] = ("stock_a", "stock_b"), ts: str = "ts", x: str = "x_a", y: str = "x_b", bounded: bool = False) -> DataFrame:
    """Lead score against B shuffles of the second series, per pair.

    A replicate sends the y of each row to the place that a keyed permutation of the pair's positions gives it, by arithmetic: nothing is
    sorted or ranked per replicate. A moved y meets the x values ``lag`` rows before and after, so one
    aggregate per (pair, replicate) gives both correlations.
    """

    def build(d, w):
        return d.withColumns({"_xp": F.lag(x, lag).over(w), "_xn": F.lead(x, lag).over(w), "_yp": F.lag(y, lag).over(w), "_yn": F.lead(y, lag).over(w)})

    rows = aligned.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # read for the real score, the moved values and their places
    base = cut(over_series(rows, keys, [ts], build, before=lag, after=lag, bounded=bounded, keep_pos="_at"))
    score = safe_corr("_xp", y) - safe_corr("_xn", y)
    real = base.groupBy(*keys).agg(score.alias("lead_score"), F.count(F.lit(1)).alias("n_obs"))
    sized = base.select(*keys, F.col("_at").alias("_from"), y).join(real.select(*keys, "n_obs"), list(keys))
    moved = _replicates(sized, b, seed).select(*keys, "b", y, permuted(F.col("_from"), F.col("n_obs"), F.col("_draws")).alias("_at"))
    null = moved.join(base.select(*keys, "_at", "_xp", "_xn"), [*keys, "_at"]).groupBy(*keys, "b").agg(score.alias("_null"))
    joined = null.join(real, list(keys))
    return joined.groupBy(*keys).agg(
        F.first("lead_score").alias("lead_score"), F.first("n_obs").alias("n_obs"), F.avg("_null").alias("random_mean"), F.stddev_pop("_null").alias("random_std"),
        F.avg((F.abs("_null") >= F.abs("lead_score")).cast("double")).alias("p_value"),
    )


def subset_bootstrap(df: DataFrame, y: str, row_id: str, n: int, b: int, seed: int = 0) -> DataFrame:
    """Means of B samples of n rows without replacement: the rows that a replicate's permutation sends below n.

    They are found from the n places back, so that the work per replicate is n and not the table.
    """
    spark = df.sparkSession
    total = df.select(F.count(F.lit(1)).alias("_n")).scalar()
    # a range is sized as what it holds, however many replicates and places there are
    wanted = spark.range(int(b) * int(n)).select((F.floor(F.col("id") / F.lit(int(n))) + 1).cast("int").alias("b"), (F.col("id") % F.lit(int(n))).alias("_place"), total.alias("_n"))
    draws = spark.range(1, int(b) + 1).select(F.col("id").cast("int").alias("b"), round_draws(F.col("id"), seed=seed).alias("_draws"))
    places = wanted.filter(F.col("_place") < F.col("_n")).join(F.broadcast(draws), "b").select("b", unpermuted(F.col("_place"), F.col("_n"), F.col("_draws")).alias("_pos"))
    return index_rows(df.select(row_id, y), [], [row_id]).join(places, "_pos").groupBy("b").agg(F.avg(y).alias("mean"))


def bootstrap_percentile(means: DataFrame, observed: float) -> DataFrame:
    """Share of replicate means under the observed value, with mean and spread of the replicates."""
    return means.agg(
        F.avg("mean").alias("bootstrap_mean"), F.stddev_pop("mean").alias("bootstrap_std"), F.avg((F.col("mean") < observed).cast("double")).alias("percentile")
    )


def bootstrap_corr(df: DataFrame, x: str, y: str, order: Sequence[str], b: int, seed: int = 0, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """2.5 / 97.5 % limits of the correlation over B samples with replacement.

    Each replicate draws as many rows as there are: row i points at row
    hash(b, i) mod n, and the pointed-at rows are fetched by an equi-join.
    Pointers travel once, unsorted, and are looked up in a hash table of the few rows of their part.
    """
    keys = list(keys)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *order, x, y)
    # read for the pointers and for the rows pointed at
    base = cut(index_rows(rows, keys, order, pos="_at", total="_n", bounded=bounded).select(*keys, "_at", "_n", F.col(x).alias("_x"), F.col(y).alias("_y")))
    n = base.count() * int(b)
    points = _replicates(base.select(*keys, F.col("_at").alias("_i"), "_n").repartition(max(1, math.ceil(n / POINTS))), b)
    # never NULL, so that the join does not test the draw before it, which would draw twice
    at = F.coalesce(F.pmod(hash_draw(F.col("b"), F.col("_i"), seed=seed), F.col("_n")), F.lit(0))
    points = points.select(*keys, "b", at.alias("_at"))
    on = [*keys, "_at"]
    fetched = dealt(points, n, *on, part=POINTS).join(dealt(base.select(*on, "_x", "_y"), n, *on, part=POINTS).hint("shuffle_hash"), on)
    xx, yy = F.col("_x"), F.col("_y")
    sums = fetched.groupBy(*keys, "b").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(xx).alias("sx"), F.sum(yy).alias("sy"), F.sum(xx * xx).alias("sxx"), F.sum(yy * yy).alias("syy"), F.sum(xx * yy).alias("sxy")
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy, cov = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n, F.col("sxy") - sx * sy / n
    corr = sums.withColumn("corr", F.when((vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(vx * vy)))
    # a row a group and replicate, read several times
    return quantiles_wide(cut(corr), {"lower": ("corr", 0.025), "upper": ("corr", 0.975)}, keys)


def ols(df: DataFrame, y: str, xs: Sequence[str], interactions: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Least squares by normal equations: coefficient, standard error, t and p per term, R² on each row.

    A row without y has nothing to fit; a missing x is an error, so impute first.
    """
    names = list(xs)
    for a, b in interactions:
        df = df.withColumn(f"{a}:{b}", F.col(a) * F.col(b))
        names.append(f"{a}:{b}")
    data = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="error").transform(df.filter(F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double")))
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(data)
    s = model.summary
    terms = [*names, "intercept"]
    coefs = [*model.coefficients.toArray().tolist(), model.intercept]
    rows = list(zip(terms, map(float, coefs), s.coefficientStandardErrors, s.tValues, s.pValues, [s.r2] * len(terms)))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p_value double, r2 double")


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation from the inverse correlation matrix (d × d numbers on the driver)."""
    d = len(xs)
    m = np.eye(d)
    place = {c: i for i, c in enumerate(xs)}
    for r in corr_matrix(df, xs).collect():
        m[place[r["a"]], place[r["b"]]] = m[place[r["b"]], place[r["a"]]] = r["value"]
    values = np.diag(np.linalg.inv(m))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(xs, values)], "feature string, vif double")


def jarque_bera(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n/6·(S² + K²/4) per column with its χ²(2) tail."""
    cells = [
        F.struct(F.lit(c).alias("column"), (F.count(c) / 6.0 * (F.skewness(c) ** 2 + F.kurtosis(c) ** 2 / 4)).alias("statistic")) for c in cols
    ]
    out = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    return out.withColumn("p_value", F.exp(-F.col("statistic") / 2))


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov distance from the normal with the sample's own mean and deviation."""
    m = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    data = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    return KolmogorovSmirnovTest.test(data, "x", "norm", float(m["m"]), float(m["s"])).select(F.col("pValue").alias("p_value"), "statistic")


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values outside [q25 - k·IQR, q75 + k·IQR] per column."""
    marks = quantiles(df, cols, [0.25, 0.75]).groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("_lo"), F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("_hi")
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(F.explode(cells).alias("_c")).select("_c.*")
    # one row per column
    tested = long.join(F.broadcast(marks), "column")
    iqr = F.col("_hi") - F.col("_lo")
    out = (F.col("value") < F.col("_lo") - k * iqr) | (F.col("value") > F.col("_hi") + k * iqr)
    return tested.groupBy("column").agg(F.count("value").alias("n"), F.count(F.when(out, 1)).alias("n_outliers"))


def target_corr(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Correlation of each feature with the target, strongest first."""
    cells = [F.struct(F.lit(c).alias("feature"), safe_corr(c, y).alias("corr")) for c in xs]
    rows = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    return rows.orderBy(F.abs("corr").desc(), "feature")


def role_accuracy(tests: DataFrame, roles: DataFrame, keys: Sequence[str] = ("stock_a", "stock_b"), alpha: float = 0.05) -> DataFrame:
    """How often the empirical leader is the larger company, overall and for significant pairs."""
    both = tests.join(roles.select(*keys, F.col("leader").alias("_cap_leader")), list(keys))
    leader = F.when(F.col("lead_score") > 0, F.col(keys[0])).otherwise(F.col(keys[1]))
    match = (leader == F.col("_cap_leader")).cast("double")
    return both.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(match).alias("agreement"), F.avg(F.when(F.col("p_value") < alpha, match)).alias("agreement_significant")
    )


