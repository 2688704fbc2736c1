"""Whitening and centroid clustering against plain loops in exact arithmetic."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from tests.llm.conftest import SF

from tickweave.llm import centroids as C
from tickweave.llm import vectors as V
from tickweave.llm import whitening as H

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(3)], "a") for i in range(40)]
    rows += [(50, rows[4][1], "b"), (4, rows[4][1], "a"), (None, [0.5, -0.25, 1.0], "c"), (51, [0.0, -0.0, 0.0], "d")]
    rows += [(60, None, "x"), (61, [], "x"), (62, [1.0, NAN, 2.0], "x"), (63, [INF, 1.0, 2.0], "x"), (64, [None, 1.0, 2.0], "x"), (None, None, "x")]
    rows += [(70, [1.0, 2.0], "y"), (71, [3.0, 5.0], "y"), (72, [3.0, 5.0], "y")]
    return spark.createDataFrame([(i, v, 1, k, k, k) for i, v, k in rows], "vec_id long, embedding array<double>, cluster int, n string, vector string, distance string")


def whole(rows, size):
    return [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in rows if r.embedding and len(r.embedding) == size and all(x is not None and math.isfinite(x) for x in r.embedding)]


# --- centroids ------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, salt="2"):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))
    for _ in range(rounds):
        owner = [near(v) for _, v in rows]
        groups = [[v for (_, v), o in zip(rows, owner, strict=True) if o == c] for c in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, near(v), square(v, centres[near(v)])) for i, v in rows]
    total = {c: sum(d for _, o, d in found if o == c) for c in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in found]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("k", [1, 7, 100])
def test_clusters_equal_brute_force(odd_vectors, k):
    want = brute_clusters(whole(odd_vectors.collect(), 3), k, 4)
    assert by_id(C.cluster(odd_vectors, k, 4, size=3).collect()) == by_id(want)


def test_registered_clusters_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert by_id(C.cluster(table).collect()) == by_id(brute_clusters(whole(table.collect(), 64), 40, 5))


def test_tournament_gives_ties_to_the_smaller_number():
    centres = np.array([[4, 0], [0, 0], [4, 0], [2, 2], [0, 4]])
    points = np.array([[2, 0], [4, 0], [2, 1], [0, 2], [1, 3]])
    best, distance = C.Bisectors(centres).winners(points)
    every = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist()
    assert distance.tolist() == every.min(axis=1).tolist()


def test_clusters_of_nothing(odd_vectors):
    assert C.cluster(odd_vectors.limit(0)).collect() == []
    assert C.cluster(odd_vectors, size=64).collect() == []


def test_too_large_components_are_an_error(spark):
    one = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="larger"):
        H.whiten(one).collect()


# --- whitening ------------------------------------------------------------------------


def exact_cov(fit):
    n, size = len(fit), len(fit[0])
    mean = [Fraction(sum(v[i] for v in fit), n) for i in range(size)]
    return mean, [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n for j in range(size)] for i in range(size)]


@pytest.mark.parametrize("source", ["odd", "given"])
def test_whitening_against_exact_sums(spark, odd_vectors, source):
    table, size = (odd_vectors, 3) if source == "odd" else (spark.read.parquet(f"{SF}/embeddings.parquet").limit(90), 64)
    rows = whole(table.collect(), size)
    fit = [list(v) for v in sorted({tuple(v) for _, v in rows})]
    n, sums = len(fit), [sum(v[i] for v in fit) for i in range(size)]
    mean, cov = exact_cov(fit)
    values, vectors = np.linalg.eigh(np.array(cov, dtype=float))
    got = [r for r in H.whiten(table).collect() if source == "given" or r.vec_id is None or r.vec_id < 70]
    assert len(got) == len(rows) * min(4, size)
    numbers = {}
    for r in got:
        numbers.setdefault(r.vec_id, {}).setdefault(r.component, set()).add((r.whitened, r.deviation, r.n, r.explained))
        assert r.identity_error < 1e-12
    for vec_id, x in rows:
        for c in range(min(4, size)):
            want = (np.array([float(a - m) for a, m in zip(x, mean, strict=True)]) @ vectors[:, -1 - c]) / math.sqrt(values[-1 - c])
            ((z, deviation, seen, explained),) = numbers[vec_id][c + 1]
            assert abs(abs(z) - abs(want)) < 1e-9
            assert (deviation, seen) == (sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), n)
            assert explained == pytest.approx(values[-1 - c] / values.sum(), rel=1e-9)


def test_sizes_are_fitted_apart_and_flat_components_are_null(odd_vectors):
    two = [r for r in H.whiten(odd_vectors).collect() if r.vec_id in (70, 71, 72)]
    assert sorted((r.vec_id, r.component, r.n) for r in two) == [(i, c, 2) for i in (70, 71, 72) for c in (1, 2)]
    assert {abs(round(r.whitened, 12)) for r in two if r.component == 1} == {1.0}
    assert {(r.whitened, r.explained) for r in two if r.component == 2} == {(None, 0.0)}


def test_whitening_of_one_vector_and_of_none(spark, odd_vectors):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = H.whiten(one).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in got] == [(1, 0, None, None)] * 4
    assert H.whiten(odd_vectors.limit(0)).collect() == []


@pytest.mark.parametrize("spectrum", [[9, 4, 1, 0.25], [5, 5 - 1e-9, 5 - 2e-9, 1], [3, 3, 3, 3], [7, 2, 2 - 1e-12, 0], [1e6, 1, 1 + 1e-11, 1e-6]])
def test_eigenvectors_of_near_and_equal_values(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((4, 4)))
    q = q.astype(np.longdouble)
    for _ in range(4):  # to orthogonal in the long format
        q = q + q @ (np.eye(4, dtype=np.longdouble) - q.T @ q) / 2
    a = q @ np.diag(np.array(spectrum, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    values, vectors = H.eigenvectors(a)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-16 * max(spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-17
    assert np.abs(a @ vectors - vectors * values).max() < 1e-17 * max(spectrum)


def test_deviation_beyond_a_long_is_null():
    model = H.Whitening(10**9, [3 * 10**9, -(10**9)], np.ones(2), np.eye(2), [0.5, 0.5], 0.0)
    assert model.deviations(np.array([[3, -1], [4, -1], [3, 7]])) == [0, 10**18, None]


def test_whole_numbers_are_floors(spark):
    import pyarrow as pa

    column = pa.array([[0.1, -0.1], [-0.0, 1 / 256]], pa.list_(pa.float64()))
    assert V.whole_numbers(column).tolist() == [[25, -26], [0, 1]]
