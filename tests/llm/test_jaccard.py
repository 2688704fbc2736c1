import random
import re

import numpy as np

from tickweave.llm import jaccard_join
from tickweave.llm.components import components
from tickweave.llm.jaccard_join import jaccard_classes


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    named = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(named):
        for j, b in named[:x]:
            common = len(a & b)
            if root(i) != root(j) and 100 * common >= percent * (len(a) + len(b) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((repr(i), len(s), repr(None if i is None else root(i))) for i, s in sets)


def result(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in df.collect())


def test_equals_brute_force(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        assert result(jaccard_classes(table)) == brute(table.select("doc_id", "text").collect(), 4, 85)
    assert jaccard_classes(no_docs).collect() == []


def test_clusters_of_edits_and_chains(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(4000)}"
    passage, rows = [word() for _ in range(60)], []
    for c in range(12):
        base = [word() for _ in range(draw.randrange(20, 160))]
        for _ in range(draw.randrange(1, 25)):
            text = list(base)
            for _ in range(draw.randrange(0, 5)):
                text[draw.randrange(len(text))] = word()
            if draw.random() < 0.3:
                base = text
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join([word() for _ in range(40)] + passage)) for k in range(60)]
    # One doc_id with two texts ties their classes together.
    rows.append((3, rows[40][1] + " more words here"))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(jaccard_classes(table)) == brute(rows, 4, 85)
    assert result(jaccard_classes(table, 5, 80)) == brute(rows, 5, 80)


def test_one_large_group_of_near_copies(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(700):
        text = list(base)
        for _ in range(draw.randrange(0, 3)):
            text[draw.randrange(80)] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert result(got) == brute(rows, 4, 85)


def test_bounds_never_prune_a_link():
    draw = np.random.default_rng(1)
    for _ in range(200):
        base = np.unique(draw.integers(0, 2**63, draw.integers(1, 300)).astype(np.uint64))
        other = np.unique(np.concatenate([base[draw.random(len(base)) > 0.08], draw.integers(0, 2**63, draw.integers(0, 20)).astype(np.uint64)]))
        if len(other) and jaccard_join.linked(base, other, 85):
            assert jaccard_join.links_across([base], [other], [0], [1], 85) == [(0, 1)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 7), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5}
    assert components(edges.limit(0)).collect() == []


def test_first_of_each_keeps_one(odd_docs):
    kept = jaccard_join.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, 3, 4, 5, 6, 9, 10, 8, None, None], key=repr)
