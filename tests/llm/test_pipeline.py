"""The pipeline against brute force, stage by stage, each on what the stage before kept."""

import hashlib
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_lines import brute_rare
from tickweave.llm import line_dedup, packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        docs = spark.createDataFrame(done.collect(), done.schema)
        out.append(docs.collect())
    return out


def rows(part):
    return [(r.doc_id, r.text) for r in part]


def lines_kept(docs):
    """(doc_id, text) after line dedup: exact copies of an earlier text go, then shared runs of 20 words and lines of few texts, then what is empty."""
    first = {}
    for i, t in sorted(docs):
        first.setdefault(t, i)
    distinct = [(i, t) for t, i in first.items() if t]
    gone = brute_rare(distinct, line_dedup.MIN_WORDS, line_dedup.RARE)
    left = {t: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in distinct}
    return sorted((i, left.get(t, t)) for i, t in docs if first[t] == i or not t if not gone.get(i) or left[t].strip())


def test_each_stage(spark, stages):
    documents, toxic, lines, near, leaks, packed = stages
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.text_scores(*model, [r.text.encode() for r in documents])
    assert sorted(r.doc_id for r in toxic) == sorted(r.doc_id for r, s in zip(documents, scores, strict=True) if s < 0.7)
    assert sorted(rows(lines)) == lines_kept(rows(toxic))
    assert all(r.n_chars == len(r.text) for r in lines)
    assert sorted(r.doc_id for r in near) == sorted(int(i) for i, _, c in jaccard_brute(rows(lines), 5, 80) if i == c)
    assert all(r.text == dict(rows(near))[r.doc_id] for r in leaks) and {r.doc_id for r in leaks} <= {r.doc_id for r in near}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    for r in near:
        words = re.findall(r"\w+", r.text.lower())
        if any(tuple(words[i : i + 13]) in windows for i in range(len(words) - 12)):
            assert r.doc_id not in {x.doc_id for x in leaks}
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]) for r in leaks}
    assert {p.doc_id for p in packed} == set(ids)
    assert sum(p.length for p in packed) == sum(map(len, ids.values()))


def test_run_equals_the_stages(spark, stages):
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages[-1])


def test_stages_take_odd_rows(spark, odd_docs):
    columns = list(corpus_pipeline.DOCUMENT_COLUMNS)
    for table in (odd_docs, odd_docs.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
        kept = docs.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(kept)
        if table is odd_docs:
            texts = {hashlib.md5((r.text or "").encode()).hexdigest() for r in kept}
            assert len(kept) >= 7 and len(texts) >= 5
