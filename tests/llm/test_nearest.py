import math
from types import SimpleNamespace

import numpy as np
import pandas as pd

from tickweave.llm import nearest as N


def brute(ids, vectors, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        rows = [(float(d[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
        out[int(ids[q])] = sorted(rows)[:k]
    return out


def test_recall_against_brute_force(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = pd.read_parquet(path)
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(np.float64)
    want = brute(ids, vectors, 100, 10)
    rows = N.nearest(spark.read.parquet(path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    known = {(q, i): d for q, v in want.items() for d, i in v}
    assert all(abs(d - known[q, i]) < 1e-9 for q, v in got.items() for d, i in v if (q, i) in known)


def test_ties_blocks_and_odd_vectors(spark, monkeypatch):
    random = np.random.default_rng(4)
    vectors = {i: random.integers(0, 4, 8).astype(float).tolist() for i in range(1, 400)}
    for i in range(200, 260):
        vectors[i] = vectors[100]
    vectors |= {300: None, 310: [0.0] * 8, 320: [1.0, None] + [3.0] * 6, 330: [math.nan] * 8, 340: [math.inf] + [1.0] * 7, 350: [1.0, 2.0]}
    rows = [(i, v, 1.0) for i, v in vectors.items()] + [(5, vectors[5], 1.0), (None, vectors[5], 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    good = {i: v for i, v in vectors.items() if i not in (300, 310, 320, 330, 340, 350)}
    ids = np.array(list(good))
    want = brute(ids, np.array([good[i] for i in good]), 50, 10)
    monkeypatch.setattr(N, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    got = {}
    for r in N.nearest(table, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))
    assert got[100] == want[100]
    assert N.nearest(table.limit(0)).collect() == []


def test_regions_hold_every_neighbour_within_the_bound():
    random = np.random.default_rng(7)
    centres = random.standard_normal((40, 16)) * 6
    vectors = centres[random.integers(0, 40, 3000)] + random.standard_normal((3000, 16)) * 0.3
    vectors[50:90] = vectors[50]
    ids = np.arange(3000)
    sample = N.Sample([SimpleNamespace(vector=v, vec_id=i) for i, v in zip(ids[:900], vectors[:900], strict=True)], 60)
    region, far = sample.region(16, vectors)
    widths = {(16, int(r)): float(far[region == r].max()) for r in np.unique(region)}
    asked = ids % 10 == 0
    bounds = sample.bound(16, vectors[asked], ids[asked], 10)
    reached = sample.reached(16, vectors[asked], bounds, widths)
    for q, bound, found in zip(ids[asked], bounds, reached, strict=True):
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        nearest = np.argsort(distance)[:10]
        assert distance[nearest].max() <= bound
        assert set(region[nearest].tolist()) <= set(found)
    # Clustered vectors leave most regions out.
    assert np.mean([len(f) for f in reached]) < len(widths) / 4
