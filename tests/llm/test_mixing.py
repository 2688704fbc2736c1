"""Mixing: targets, permutations, and the words every document gives."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SF

from tickweave.llm import mixing as M

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes):
    """Give by weight, cap, give what is over again, until nothing is left to give or no one can take."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    got, left, free = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while left and free:
        part = left / sum(weights[i] for i in free)
        left = Fraction(0)
        for i in sorted(free):
            got[i] += part * weights[i]
        for i in sorted(free):
            if got[i] > 3 * sizes[i]:
                left += got[i] - 3 * sizes[i]
                got[i] = Fraction(3 * sizes[i])
                free.discard(i)
    return got


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1000, 1, 2, 0, 7], [0, 0], [3], [1, 2, 3, 4, 500, 6, 7], []])
def test_targets(sizes):
    found = M.targets(sizes, [1 + i % 3 for i in range(len(sizes))])
    assert found == pytest.approx(brute_targets(sizes))
    assert all(t <= 3 * n for t, n in zip(found, sizes, strict=True))
    assert sum(found) == sum(sizes)


@pytest.mark.parametrize("count", [1, 2, 3, 17, 64, 1000])
def test_permutations_take_every_number_once(count):
    for key in range(3):
        got = M.permuted(np.arange(count), np.full(count, count), np.full(count, key))
        assert sorted(got.tolist()) == list(range(count))
    assert count < 17 or (M.permuted(np.arange(count), np.full(count, count), np.full(count, 0)) != M.permuted(np.arange(count), np.full(count, count), np.full(count, 1))).any()


def check(docs, **options):
    """Every promise of the operator, recounted from the slots and the texts."""
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goals = dict(zip(names, brute_targets([sizes[n] for n in names]), strict=True))
    block = options.get("block", M.BLOCK)
    mix = M.mix(docs, **options)
    taken = mix.taken().collect()
    assert sorted((str(r.doc_id), r.size) for r in taken) == sorted((str(r.doc_id), len(WORDS.findall(r.text or ""))) for r in rows)
    source_of = {r.doc_id: r.source for r in rows}
    got = Counter()
    for r in taken:
        assert r.source_size == sizes[source_of[r.doc_id]] and r.target == pytest.approx(float(goals[source_of[r.doc_id]]))
        assert 0 <= r.taken <= 3 * r.size
        got[source_of[r.doc_id]] += r.taken
    for name in names:
        assert abs(got[name] - goals[name]) <= 1.5 * block, (name, got[name], float(goals[name]))
    # The pieces of the slots are the words that were counted.
    pieces = mix.pieces().collect()
    assert Counter(str(r.doc_id) for r in pieces for _ in range(r.words)) == Counter({str(i): n for i, n in sum_by(taken).items() if n})
    held = defaultdict(set)
    for r in pieces:
        held[r.shard, r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in held.values())
    per_shard = Counter(shard for shard, _ in held)
    assert all(sorted(s for h, s in held if h == shard) == list(range(n)) for shard, n in per_shard.items())
    # A block stands at most once a round: three times in all, and never more than once oftener than its fellows.
    times = Counter(b for v in held.values() for b in v)
    for source in {s for s, _ in times}:
        counts = [times[source, b] for b in range(int(mix.made.blocks[source]))]
        assert max(counts) - min(counts) <= 1 and max(counts) <= 3
    return mix, taken


def sum_by(taken):
    out = Counter()
    for r in taken:
        out[str(r.doc_id)] += r.taken
    return out


def test_given_documents(docs):
    mix, taken = check(docs)
    assert len(taken) == docs.count()
    again = M.mix(docs.repartition(7)).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, taken))


def test_many_shards_and_small_blocks(docs):
    check(docs, block=16, shard=64)


def test_odd_documents(odd_docs):
    odd = odd_docs.withColumn("source", F.when(F.col("doc_id") == 6, "é").when(F.col("doc_id") == 7, None).when(F.col("doc_id") < 3, "b").otherwise("a")).withColumns({"size": F.lit("x"), "h": F.lit(1), "taken": F.lit(1), "bucket": F.lit(0), "rank": F.lit(0)})
    rows = odd.collect()
    taken = M.mix(odd, block=8).taken().collect()
    assert len(taken) == len(rows)
    assert sorted(r.size for r in taken) == sorted(len(WORDS.findall(r.text or "")) for r in rows)
    assert all(r.taken <= 3 * r.size for r in taken)


def test_empty_tables_and_texts(no_docs, odd_docs):
    assert M.mix(no_docs).taken().collect() == []
    blank = odd_docs.withColumn("text", F.lit(" \n").cast("string"))
    assert {(r.size, r.taken, r.target) for r in M.mix(blank).taken().collect()} == {(0, 0, 0.0)}
    assert M.mix(blank).taken().count() == odd_docs.count()


def test_texts_of_slots(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{s}{i}w{j}" for j in range(i % 9)), s) for i in range(60) for s in "ab"], "doc_id long, text string, source string")
    mix = M.mix(docs, block=5, shard=16)
    texts = {(r.shard, r.slot): (r.source, r.text.split(" ")) for r in mix.texts(docs).collect()}
    pieces = defaultdict(list)
    for r in mix.pieces().collect():
        pieces[r.shard, r.slot].append(r)
    assert texts.keys() == pieces.keys()
    for place, rows in pieces.items():
        source, words = texts[place]
        want = [f"{source}{r.doc_id}w{r.first + j}" for r in sorted(rows, key=lambda r: r.start) for j in range(r.words)]
        assert words == want and len(words) <= 5


def test_hot_source_in_many_buckets(docs, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 10)
    check(docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source"))), block=32, shard=100)


def test_registered_query_equals_operator(spark, docs):
    from tickweave.llm.queries import QUERIES

    assert QUERIES["op12_mixing"](spark, SF).count() == docs.count()
