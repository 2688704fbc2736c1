import zlib

import numpy as np
import pandas as pd
import pytest

from tickweave.llm import quality, toxicity
from tickweave.llm.training import ranking_quality

SF = "/root/testdata/sf0.1"


def held_out(label, folds, remainder, per_class):
    docs = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in docs.doc_id])
    train, test = docs[fold != remainder], docs[fold == remainder]
    train = pd.concat([train[train[label] == v].head(per_class) for v in (0, 1)])
    return [[t.encode() for t in d.text] for d in (train, test)], train[label].to_numpy(np.float32), test[label].to_numpy()


def test_quality_on_held_out_rows():
    (train, test), y, want = held_out("quality", 5, 0, 500)
    scores = quality.text_scores(quality.train(train, y), test)
    assert ranking_quality(scores, want) > 0.97
    assert ((scores >= 0.3) == want).mean() > 0.95


def test_toxicity_on_held_out_rows():
    (train, test), y, want = held_out("toxic", 3, 1, 600)
    model = toxicity.train(train, y)
    scores = np.concatenate([toxicity.text_scores(*model, test[i : i + 200]) for i in range(0, len(test), 200)])
    assert ranking_quality(scores, want) > 0.93
    assert ((scores >= 0.7) == want).mean() > 0.95


@pytest.mark.parametrize("name", ["out", "in", "filter", "byte", "shift"])
def test_gradient_of_the_convolution(name):
    random = np.random.default_rng(0)
    texts, y = [b"some text " * 70, b"### | ###", b"", bytes(range(1, 200)) * 5], np.array([1, 0, 1, 0], dtype=np.float32)
    p = {k: v.astype(np.float64) for k, v in quality.train(texts, y).items()}
    w = np.ones(4)
    grads = quality.gradients(p, texts, y, w)
    loss = lambda p: -np.mean(np.where(y == 1, np.log(quality.text_scores(p, texts)), np.log(1 - quality.text_scores(p, texts))))
    step = random.standard_normal(p[name].shape)
    up, down = ({**p, name: p[name] + e * step} for e in (1e-5, -1e-5))
    slope = (loss(up) - loss(down)) / 2e-5
    assert abs(slope - (grads[name] * step).sum()) < 0.02 * abs(slope) + 1e-5


def test_scores_do_not_depend_on_neighbours():
    texts = [b"", b"one text " * 40, b"### | ### " * 90, b"x" * 251, b"z" * 256, b"a", b""]
    p = quality.train(texts, np.array([1, 1, 0, 0, 1, 1, 0], dtype=np.float32))
    model = toxicity.train(texts, np.array([1, 1, 0, 0, 1, 1, 0], dtype=np.float32))
    for scored in (lambda t: quality.text_scores(p, t), lambda t: toxicity.text_scores(*model, t)):
        alone = np.array([scored([t])[0] for t in texts])
        assert np.allclose(scored(texts), alone, atol=1e-6) and np.allclose(scored(texts[::-1])[::-1], alone, atol=1e-6)


@pytest.mark.parametrize("name", ["in_f", "state_f", "state_b", "look_b", "value_f", "word", "gram", "bias_b"])
def test_gradient_of_the_recurrent_network(name):
    random = np.random.default_rng(1)
    texts, y = [b"you are kind and good", b"bad worse worst words here", b"fine", b"worst words of all"], np.array([0, 1, 0, 1], dtype=np.float32)
    p, vocabulary = toxicity.train(texts * 3, np.tile(y, 3))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    corpus = toxicity.Corpus(texts)
    windows = np.arange(4)
    grads = toxicity.gradients(p, vocabulary, corpus, windows, np.stack([y, np.ones(4)], axis=1))

    def loss(p):
        s = 1 / (1 + np.exp(-toxicity.window_logits(p, vocabulary, corpus).astype(np.float64)))
        return -np.mean(np.where(y == 1, np.log(s), np.log(1 - s)))

    step = random.standard_normal(p[name].shape)
    slope = (loss({**p, name: p[name] + 1e-3 * step}) - loss({**p, name: p[name] - 1e-3 * step})) / 2e-3
    assert abs(slope - (grads[name] * step).sum()) < 0.05 * abs(slope) + 1e-3


@pytest.mark.parametrize("net", [quality, toxicity])
def test_tables_with_odd_rows(spark, odd_docs, no_docs, net):
    labels = spark.createDataFrame([(1, 1, 0, 5.0), (3, 0, 1, 1.0), (4, None, None, 0.0), (6, 0, 1, 2.0), (8, 1, 0, 0.0), (8, 1, 0, 0.0), (10, 0, 1, 0.0), (99, 1, 1, 0.0), (None, 1, 1, 0.0)], "doc_id long, quality int, toxic int, score double")
    for table, label_rows in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        rows = net.score(table, net.fit(table, label_rows)).collect()
        assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == (r.score >= (0.3 if net is quality else 0.7)) for r in rows)
        folds, left = (5, 0) if net is quality else (3, 1)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == left) for r in rows)
        empty = {r.score for r in rows if r.doc_id in (3, 4)}
        assert len(empty) <= 1


def test_equal_texts_have_equal_scores():
    random = np.random.default_rng(2)
    texts = [bytes(random.integers(32, 127, random.integers(1, 900)).astype(np.uint8)) for _ in range(60)]
    model = quality.train(texts[:40], np.arange(40) % 2)
    alone = quality.text_scores(model, texts[:1] + texts[-1:])
    for at in (0, 1, 7, 30):
        mixed = quality.text_scores(model, texts[1 : 1 + at] + texts[:1] + texts[-1:])
        assert mixed[-2:].tolist() == alone.tolist()
