"""Document quality by a byte-level convolutional network, trained and run in numpy.

Learned filters over runs of WIDTH bytes slide over the whole text. Each filter's responses are max-pooled in overlapping
chunks (CHUNK bytes, every CHUNK / 2); the mean and the maximum over all chunks go through one hidden layer to a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.frames import map_slices, pick, raw_bytes
from tickweave.llm.training import Adam, Params, fold, labelled_sample, sigmoid

#: Labelled rows a class that training reads at most.
SAMPLE_PER_CLASS = 1500
WIDTH, FILTERS, BYTE_DIM, HIDDEN = 6, 24, 8, 16
CHUNK = 512
HALF = CHUNK // 2
#: Steps of gradients, whatever the sample's size.
STEPS, BATCH = 12 * 94, 32
#: Half-chunks that are in memory at once.
TOGETHER = 256


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text behind WIDTH - 1 zeros and padded to whole half-chunks, and half-chunks per text.

    A run of bytes that begins in one text's padding ends in the next one's zeros, so no text sees another.
    """
    halves = np.array([-(-(len(t) + WIDTH - 1) // HALF) for t in texts], dtype=np.int64)
    data = b"".join([(bytes(WIDTH - 1) + t).ljust(n * HALF, b"\0") for t, n in zip(texts, halves, strict=True)])
    return np.frombuffer(data + b"\0" * WIDTH, dtype=np.uint8), halves


def responses(p: Params, tables: list[np.ndarray], data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Filter responses in half-chunks first:last, as (half-chunk, byte, filter)."""
    lo, n = first * HALF, (last - first) * HALF
    out = tables[0][data[lo : lo + n]]
    for k in range(1, WIDTH):
        out += tables[k][data[lo + k : lo + k + n]]
    out += p["shift"]
    return out.reshape(last - first, HALF, FILTERS)


def pooled(tops: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text features from the half-chunks' maxima: mean and maximum over overlapping chunks of the rectified maxima.

    Also, for training: chunk maxima, whether each came from the second half, chunk bounds, and the first half of each chunk.
    """
    chunks = np.maximum(halves - 1, 1)
    base, half_base = np.concatenate([[0], np.cumsum(chunks)]), np.concatenate([[0], np.cumsum(halves)])
    text = np.repeat(np.arange(len(halves)), chunks)
    start = half_base[text] + np.arange(base[-1]) - base[text]
    second = np.minimum(start + 1, half_base[text + 1] - 1)
    later = tops[second] > tops[start]
    top = np.maximum(np.where(later, tops[second], tops[start]), 0)
    mean = np.add.reduceat(top, base[:-1], axis=0) / chunks[:, None].astype(np.float32)
    return np.concatenate([mean, np.maximum.reduceat(top, base[:-1], axis=0)], axis=1), top, later, base, start, second, text


def text_scores(p: Params, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, halves = laid_out(texts)
    tables = [p["byte"] @ p["filter"][k] for k in range(WIDTH)]
    total = int(halves.sum())
    tops = np.concatenate([responses(p, tables, data, a, min(a + TOGETHER, total)).max(axis=1) for a in range(0, total, TOGETHER)])
    features = pooled(tops, halves)[0]
    # Sums row by row: a matrix product rounds by the row's place in the batch, and equal texts have equal scores.
    scaled = ((features - p["centre"]) * p["scale"]).astype(np.float64)
    hidden = np.tanh((scaled[:, :, None] * p["in"]).sum(axis=1) + p["in_shift"])
    return sigmoid((hidden * p["out"]).sum(axis=1) + p["out_shift"])


def gradients(p: Params, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> Params:
    data, halves = laid_out(texts)
    tables = [p["byte"] @ p["filter"][k] for k in range(WIDTH)]
    total = int(halves.sum())
    tops, places = [], []
    for a in range(0, total, TOGETHER):
        r = responses(p, tables, data, a, min(a + TOGETHER, total))
        at = r.argmax(axis=1)
        tops.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
        places.append(at + (np.arange(a, min(a + TOGETHER, total)) * HALF)[:, None])
    tops, places = np.concatenate(tops), np.concatenate(places)
    features, top, later, base, start, second, text = pooled(tops, halves)
    scaled = (features - p["centre"]) * p["scale"]
    hidden = np.tanh(scaled @ p["in"] + p["in_shift"])
    error = ((sigmoid(hidden @ p["out"] + p["out_shift"][0]) - label) * weight / len(texts)).astype(np.float32)
    grads: Params = {"out": hidden.T @ error, "out_shift": np.array([error.sum()], dtype=np.float32)}
    d_hidden = error[:, None] * p["out"] * (1 - hidden * hidden)
    grads["in"], grads["in_shift"] = scaled.T @ d_hidden, d_hidden.sum(axis=0)
    d_features = d_hidden @ p["in"].T * p["scale"]
    d_mean, d_max = d_features[:, :FILTERS], d_features[:, FILTERS:]
    d_top = (d_mean / np.diff(base)[:, None])[text]
    # Chunks that share the maximum share its gradient.
    tied = top == np.maximum.reduceat(top, base[:-1], axis=0)[text]
    d_top += d_max[text] * tied / np.add.reduceat(tied, base[:-1], axis=0, dtype=np.float32)[text]
    d_top *= top > 0
    d_half = np.zeros_like(tops)
    np.add.at(d_half, start, np.where(later, 0, d_top))
    np.add.at(d_half, second, np.where(later, d_top, 0))
    column = np.broadcast_to(np.arange(FILTERS), places.shape)
    grads["shift"] = d_half.sum(axis=0)
    grads["byte"], grads["filter"] = np.zeros_like(p["byte"]), np.zeros_like(p["filter"])
    for k in range(WIDTH):
        cell = data[places + k].astype(np.int64) * FILTERS + column
        d_table = np.bincount(cell.ravel(), d_half.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
        grads["filter"][k] = p["byte"].T @ d_table
        grads["byte"] += d_table @ p["filter"][k].T
    return grads


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Params:
    """Parameters fitted to the sample; without both labels the network answers with the label's share."""
    random = np.random.default_rng(seed)
    draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    p = {"byte": draw(256, BYTE_DIM, scale=0.7), "filter": draw(WIDTH, BYTE_DIM, FILTERS, scale=0.4), "shift": np.zeros(FILTERS, dtype=np.float32)}
    p |= {"in": draw(2 * FILTERS, HIDDEN, scale=0.15), "in_shift": np.zeros(HIDDEN, dtype=np.float32), "out": draw(HIDDEN, scale=0.3), "out_shift": np.zeros(1, dtype=np.float32)}
    fixed = {"centre": np.zeros(2 * FILTERS, dtype=np.float32), "scale": np.ones(2 * FILTERS, dtype=np.float32)}
    if not texts or labels.min() == labels.max():
        return p | fixed | {"out": np.zeros(HIDDEN, dtype=np.float32), "out_shift": np.array([np.log(share / (1 - share))], dtype=np.float32)}
    # Features of the untrained filters set the scale of the hidden layer's inputs.
    data, halves = laid_out(texts[:: max(1, len(texts) // 300)])
    tables = [p["byte"] @ p["filter"][k] for k in range(WIDTH)]
    total = int(halves.sum())
    first = pooled(np.concatenate([responses(p, tables, data, a, min(a + TOGETHER, total)).max(axis=1) for a in range(0, total, TOGETHER)]), halves)[0]
    fixed = {"centre": first.mean(axis=0), "scale": 1 / (first.std(axis=0) + 0.1)}
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    adam = Adam(p, 0.004)
    epochs = -(-STEPS // -(-len(texts) // BATCH))
    for epoch in range(epochs):
        adam.rate = 0.004 if epoch < epochs - 3 else 0.001
        mixed = random.permutation(len(texts))
        for at in range(0, len(mixed), BATCH):
            part = mixed[at : at + BATCH]
            adam.update(gradients(p | fixed, [texts[i] for i in part], labels[part], weight[part]))
    return p | fixed


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, per_class: int = SAMPLE_PER_CLASS) -> Params:
    """Train on at most `per_class` rows a class whose fold is not `held_out`."""
    return train(*labelled_sample(docs, labels, label, fold("doc_id", folds) != held_out, per_class))


def score(docs: DataFrame, model: Params, threshold: float = 0.3, folds: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold) per row of `docs`; one pass, no shuffle.

    Null and empty texts are one chunk of padding and get its score. A null id is not held out. Repeated rows get equal
    scores; columns other than the text never count.
    """

    def make():
        def step(batch: pa.RecordBatch):
            return batch.column(0), text_scores(model, raw_bytes(batch.column(1)))

        return step

    slim = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scored = map_slices(slim, make, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
