"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is cut into words (runs of letters, lower case). A word's input is a learned vector of the word, if it is in the
vocabulary, beside the mean of learned vectors of its runs of four characters. Overlapping windows of words cover the whole text;
each goes through the network in both directions, attention pools its states into one logit, and the
document's score is that of its highest window. Training repeats this choice: the gradient runs through the highest window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.frames import SLICE_ROWS, end_task, map_slices, pick, raw_bytes, start_task
from tickweave.llm.hashing import mix, span_hashes, word_spans
from tickweave.llm.training import Adam, Params, fold, labelled_sample, sigmoid

#: Labelled rows a class that training reads at most.
SAMPLE_PER_CLASS = 1200
WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 8
#: Length of a character run, and rows of the table that runs are hashed to.
GRAM, GRAMS = 4, 16384
VOCABULARY = 8192
#: Steps of gradients, whatever the sample's size.
STEPS, BATCH = 7 * 50, 48
#: Windows that are in memory at once.
TOGETHER = 4096

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


class Corpus:
    """Words of a batch of texts, the distinct words' character runs, and the windows over them."""

    def __init__(self, texts: list[bytes]):
        data, starts, ends, owner = word_spans([t.lower() for t in texts], _GAP)
        hashes = span_hashes(data, starts, ends)
        self.distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        begin, size = starts[first], (ends - starts)[first]
        # Runs of GRAM bytes of a word with one blank on either side; a word too short has one run.
        self.gram_count = np.maximum(1, size + 3 - GRAM)
        base = np.concatenate([[0], np.cumsum(self.gram_count)])
        inside = np.arange(base[-1]) - np.repeat(base[:-1], self.gram_count)
        begin, last = np.repeat(begin, self.gram_count) + inside - 1, np.repeat(begin + size, self.gram_count)
        code = np.zeros(base[-1], dtype=np.uint64)
        for k in range(GRAM):
            at = begin + k
            real = (at < last) & ((inside > 0) | (k > 0))
            code = code * np.uint64(257) + np.where(real, data[np.minimum(at, len(data) - 1)], 32).astype(np.uint64) if len(data) else code
        self.grams, self.gram_base = (mix(code) % np.uint64(GRAMS)).astype(np.int64), base
        count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=np.int64)
        windows = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
        self.window_base = np.concatenate([[0], np.cumsum(windows)])
        self.text_of = np.repeat(np.arange(len(texts)), windows)
        offset = (np.arange(len(self.text_of)) - self.window_base[:-1][self.text_of]) * STRIDE
        text_start = np.concatenate([[0], np.cumsum(count)])[:-1]
        self.start = text_start[self.text_of] + offset
        self.length = np.clip(count[self.text_of] - offset, 0, WINDOW)

    def rows(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word numbers (windows × WINDOW) and the mask of real words."""
        place = np.arange(WINDOW)
        mask = place < self.length[windows][:, None]
        at = np.minimum(self.start[windows][:, None] + place, max(len(self.word) - 1, 0))
        word = self.word[at] if len(self.word) else np.zeros(at.shape, dtype=np.int64)
        return word, mask

    def inputs(self, p: Params, vocabulary: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of the distinct words (or of `chosen` ones), and their vocabulary numbers (0: not in it)."""
        if not len(self.distinct):
            return np.zeros((1, WORD_DIM + CHAR_DIM), dtype=np.float32), np.zeros(1, dtype=np.int64)
        names = self.distinct if chosen is None else self.distinct[chosen]
        at = np.minimum(np.searchsorted(vocabulary, names), max(len(vocabulary) - 1, 0))
        number = np.where(vocabulary[at] == names, at + 1, 0) if len(vocabulary) else np.zeros(len(names), dtype=np.int64)
        grams, counts = self.chosen_grams(chosen)
        sums = np.add.reduceat(p["gram"][grams], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        return np.concatenate([p["word"][number], sums / counts[:, None].astype(np.float32)], axis=1), number

    def chosen_grams(self, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if chosen is None:
            return self.grams, self.gram_count
        counts = self.gram_count[chosen]
        at = np.repeat(self.gram_base[chosen] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return self.grams[at], counts


def window_logits(p: Params, vocabulary: np.ndarray, corpus: Corpus) -> np.ndarray:
    """One logit per window."""
    x, _ = corpus.inputs(p, vocabulary)
    gates = {d: x @ p["in_" + d] + p["bias_" + d] for d in "fb"}
    out = np.empty(len(corpus.start), dtype=np.float32)
    for at in range(0, len(out), TOGETHER):
        part = np.arange(at, min(at + TOGETHER, len(out)))
        word, mask = corpus.rows(part)
        weight, value = np.zeros((2, WINDOW, len(part)), dtype=np.float32)
        for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            u, h = p["state_" + d], np.zeros((len(part), HIDDEN), dtype=np.float32)
            look = np.stack([p["look_" + d], p["value_" + d]], axis=1)
            for t in steps:
                g, s = gates[d][word[:, t]], h @ u
                rz = sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                n = np.tanh(g[:, 2 * HIDDEN :] + rz[:, :HIDDEN] * s[:, 2 * HIDDEN :])
                h = h + rz[:, HIDDEN:] * mask[:, t, None] * (n - h)
                both = h @ look
                weight[t] += both[:, 0]
                value[t] += both[:, 1]
        weight = np.where(mask.T, np.exp(weight - weight.max(axis=0)), 0)
        out[part] = (weight * value).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-30) + p["bias"][0]
    return out


def text_scores(p: Params, vocabulary: np.ndarray, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    corpus = Corpus(texts)
    return sigmoid(np.maximum.reduceat(window_logits(p, vocabulary, corpus), corpus.window_base[:-1]).astype(np.float64))


def gradients(p: Params, vocabulary: np.ndarray, corpus: Corpus, windows: np.ndarray, target: np.ndarray) -> Params:
    """Gradient of the weighted log loss over `windows`; `target` holds (label, weight) per window."""
    word, mask = corpus.rows(windows)
    chosen, inverse = np.unique(word, return_inverse=True)
    x, number = corpus.inputs(p, vocabulary, chosen if len(corpus.distinct) else None)
    inverse = inverse.reshape(word.shape)
    b, h2 = len(windows), 2 * HIDDEN
    kept: dict[str, list] = {"f": [], "b": []}
    state = {d: np.zeros((WINDOW, b, HIDDEN), dtype=np.float32) for d in "fb"}
    orders = {"f": range(WINDOW), "b": range(WINDOW - 1, -1, -1)}
    for d, steps in orders.items():
        gates, h = x @ p["in_" + d] + p["bias_" + d], np.zeros((b, HIDDEN), dtype=np.float32)
        for t in steps:
            g, s = gates[inverse[:, t]], h @ p["state_" + d]
            rz = sigmoid(g[:, :h2] + s[:, :h2])
            n = np.tanh(g[:, h2:] + rz[:, :HIDDEN] * s[:, h2:])
            kept[d].append((t, h, rz, n, s[:, h2:]))
            h = h + rz[:, HIDDEN:] * mask[:, t, None] * (n - h)
            state[d][t] = h
    weight = sum(state[d] @ p["look_" + d] for d in "fb")
    value = sum(state[d] @ p["value_" + d] for d in "fb")
    weight = np.where(mask.T, np.exp(weight - weight.max(axis=0)), 0)
    weight /= np.maximum(weight.sum(axis=0), 1e-30)
    pooled = (weight * value).sum(axis=0)
    error = (sigmoid(pooled + p["bias"][0]) - target[:, 0]) * target[:, 1] / b
    d_value, d_weight = weight * error, weight * (value - pooled) * error
    grads: Params = {"bias": np.array([error.sum()], dtype=np.float32)}
    d_x = np.zeros((b * WINDOW, x.shape[1]), dtype=np.float32)
    flat = x[inverse]
    for d in "fb":
        grads["look_" + d] = np.tensordot(d_weight, state[d], ((0, 1), (0, 1)))
        grads["value_" + d] = np.tensordot(d_value, state[d], ((0, 1), (0, 1)))
        u = p["state_" + d]
        d_u, d_gate = np.zeros_like(u), np.zeros((b, WINDOW, 3 * HIDDEN), dtype=np.float32)
        carry = np.zeros((b, HIDDEN), dtype=np.float32)
        for t, h, rz, n, s in reversed(kept[d]):
            r, z, m = rz[:, :HIDDEN], rz[:, HIDDEN:], mask[:, t, None]
            carry = carry + d_weight[t][:, None] * p["look_" + d] + d_value[t][:, None] * p["value_" + d]
            a_n = carry * z * m * (1 - n * n)
            a_z = carry * m * (n - h) * z * (1 - z)
            a_r = a_n * s * r * (1 - r)
            back = np.concatenate([a_r, a_z, a_n * r], axis=1)
            d_gate[:, t] = np.concatenate([a_r, a_z, a_n], axis=1)
            d_u += h.T @ back
            carry = carry * (1 - z * m) + back @ u.T
        rows = d_gate.reshape(b * WINDOW, -1)
        grads["state_" + d], grads["bias_" + d] = d_u, rows.sum(axis=0)
        grads["in_" + d] = flat.reshape(b * WINDOW, -1).T @ rows
        d_x += rows @ p["in_" + d].T
    per_word = np.zeros_like(x)
    np.add.at(per_word, inverse.ravel(), d_x)
    grads["word"], grads["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(grads["word"], number, per_word[:, :WORD_DIM])
    if len(corpus.distinct):
        grams, counts = corpus.chosen_grams(chosen)
        np.add.at(grads["gram"], grams, np.repeat(per_word[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0))
    return grads


def log_odds(text: np.ndarray, feature: np.ndarray, size: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each feature, and the smoothed log odds of label 1 among them against all."""
    held = np.unique(text * size + feature)
    text, feature = held // size, held % size
    ones = np.bincount(feature, labels[text], minlength=size)
    count = np.bincount(feature, minlength=size)
    odds = np.log((ones + 0.5) / (labels.sum() + 1)) - np.log((count - ones + 0.5) / ((1 - labels).sum() + 1))
    return count, np.clip(odds, -3, 3).astype(np.float32)


def start_values(p: Params, corpus: Corpus, labels: np.ndarray) -> np.ndarray:
    """Choose the vocabulary (hashes, ascending) and put log odds into the first element of each learned vector."""
    place = np.arange(WINDOW)
    real = place < corpus.length[:, None]
    text = np.repeat(corpus.text_of, WINDOW).reshape(real.shape)[real]
    word = corpus.word[(corpus.start[:, None] + place)[real]]
    count, odds = log_odds(text, word, max(len(corpus.distinct), 1), labels)
    top = np.sort(np.argsort(-count, kind="stable")[:VOCABULARY])
    top = top[count[top] >= 3]
    p["word"] = p["word"][: len(top) + 1]
    p["word"][1:, 0] = odds[top] / 2
    text, word = (x[np.unique(text * max(len(corpus.distinct), 1) + word, return_index=True)[1]] for x in (text, word))
    grams, counts = corpus.chosen_grams(word)
    p["gram"][:, 0] = log_odds(np.repeat(text, counts), grams, GRAMS, labels)[1] / 2
    return corpus.distinct[top]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> tuple[Params, np.ndarray]:
    """Parameters and vocabulary fitted to the sample; without both labels the network answers with the label's share."""
    random = np.random.default_rng(seed)
    draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    p = {"word": draw(VOCABULARY + 1, WORD_DIM, scale=0.1), "gram": draw(GRAMS, CHAR_DIM, scale=0.1), "bias": np.array([np.log(share / (1 - share))], dtype=np.float32)}
    for d in "fb":
        p |= {"in_" + d: draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN, scale=0.3), "state_" + d: draw(HIDDEN, 3 * HIDDEN, scale=0.2), "bias_" + d: np.zeros(3 * HIDDEN, dtype=np.float32)}
        p |= {"look_" + d: draw(HIDDEN, scale=0.3), "value_" + d: draw(HIDDEN, scale=0.3)}
    if not texts or labels.min() == labels.max():
        p |= {k: v * 0 for k, v in p.items() if k != "bias"}
        return p, np.zeros(0, dtype=np.uint64)
    corpus = Corpus(texts)
    vocabulary = start_values(p, corpus, labels)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    adam = Adam(p, 0.01)
    epochs = -(-STEPS // -(-len(texts) // BATCH))
    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < epochs - 2 else 0.002
        logits = window_logits(p, vocabulary, corpus)
        order = np.lexsort((logits, corpus.text_of))
        best = order[corpus.window_base[1:] - 1]
        mixed = random.permutation(len(texts))
        for at in range(0, len(mixed), BATCH):
            part = mixed[at : at + BATCH]
            adam.update(gradients(p, vocabulary, corpus, best[part], np.stack([labels[part], weight[part]], axis=1)))
    return p, vocabulary


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, per_class: int = SAMPLE_PER_CLASS) -> tuple[Params, np.ndarray]:
    """Train on at most `per_class` rows a class whose fold is not `held_out`."""
    return train(*labelled_sample(docs, labels, label, fold("doc_id", folds) != held_out, per_class))


def score(docs: DataFrame, model: tuple[Params, np.ndarray], threshold: float = 0.7, folds: int = 3, held_out: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold) per row of `docs`; one pass, no shuffle.

    Null and empty texts are one window without words and get the score of the bias. A null id is not held out. Repeated rows
    get equal scores; columns other than the text never count.
    """
    params, vocabulary = model

    def make():
        return lambda batch: (batch.column(0), text_scores(params, vocabulary, raw_bytes(batch.column(1))))

    slim = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scored = map_slices(slim, make, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def flagged(docs: DataFrame, model: tuple[Params, np.ndarray], threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, with _toxic: whether the score reaches `threshold`; one pass, no shuffle."""
    params, vocabulary = model

    def mark(batches):
        start_task()
        for batch in batches:
            scores = [text_scores(params, vocabulary, raw_bytes(part.column(text))) for part in (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))]
            toxic = np.concatenate([np.zeros(0), *scores]) >= threshold
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(toxic)], names=[*batch.schema.names, "_toxic"])
        end_task()

    return docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField("_toxic", T.BooleanType())]))
