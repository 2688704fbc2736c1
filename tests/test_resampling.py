"""Work of the bootstraps: places found back instead of sent on, pointers drawn once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import stats as H
from tickweave.plans.spread import hash_draw, permuted, round_draws, unpermuted


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_taken_back(spark, n):
    rows = spark.range(n).withColumn("b", F.explode(F.array(*map(F.lit, range(3))))).withColumn("d", round_draws(F.col("b"), seed=5))
    size = F.lit(n).cast("long")
    back = rows.withColumn("p", permuted(F.col("id"), size, F.col("d"))).withColumn("q", unpermuted(F.col("p"), size, F.col("d")))
    assert back.filter("q <> id OR p < 0 OR p >= %d" % n).count() == 0


def test_subset_bootstrap_equals_sending_all_rows(spark):
    n, b = 40, 6
    df = spark.range(500).select((F.col("id") * 3).alias("id"), F.sqrt("id").alias("y"))
    draws = spark.range(1, b + 1).select(F.col("id").cast("int").alias("b"), round_draws(F.col("id"), seed=0).alias("d"))
    sent = df.select((F.col("id") / 3).cast("long").alias("place"), "y").crossJoin(draws).withColumn("p", permuted(F.col("place"), F.lit(500).cast("long"), F.col("d")))
    want = {r["b"]: r["m"] for r in sent.filter(F.col("p") < n).groupBy("b").agg(F.avg("y").alias("m")).collect()}
    means = H.subset_bootstrap(df, "y", "id", n, b)
    assert {r["b"]: r["mean"] for r in means.collect()} == pytest.approx(want)
    assert means.count() == b


def test_bootstrap_corr_draws_each_pointer_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [("a" if i % 3 else "b", i, float(x), float(x + y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, "g string, i long, x double, y double")
    drawn = spark.sparkContext.accumulator(0)

    def counted(b, i, seed=0):
        one = F.udf(lambda v: (drawn.add(1), v)[1], "bigint").asNondeterministic()
        return one(hash_draw(b, i, seed=seed))

    monkeypatch.setattr(H, "hash_draw", counted)
    got = {r["g"]: (r["lower"], r["upper"]) for r in H.bootstrap_corr(df, "x", "y", ["i"], 8, keys=["g"]).collect()}
    assert drawn.value == 300 * 8
    monkeypatch.undo()
    for g in ("a", "b"):
        rows = [(x, y) for k, _, x, y in data if k == g]
        n = len(rows)
        at = spark.range(n).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("b", F.pmod(hash_draw(F.col("b"), F.col("id"), seed=0), F.lit(n)).alias("at")).collect()
        corr = []
        for b in range(1, 9):
            picked = np.array([rows[r["at"]] for r in at if r["b"] == b])
            corr.append(np.corrcoef(picked.T)[0, 1])
        np.testing.assert_allclose(got[g], np.quantile(corr, [0.025, 0.975]))
