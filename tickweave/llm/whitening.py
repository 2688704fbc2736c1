"""Embedding whitening: exact covariance from Spark, eigenvectors by mixed-precision refinement.

The covariance of the distinct vectors (whole 256ths) is summed in whole numbers, centred on a whole number near the mean before
multiplying; what the centre is off the mean is taken off exactly. Eigenvectors are found in float32 and then corrected by the
iteration of Ogita and Aishima, which needs matrix products alone, in the longer format of the machine (64 bits of mantissa or more on
the common platforms). Eigenvalues that the iteration can't tell apart yet form a cluster: its vectors are
turned by the eigenvectors of their own small matrix, taken about the cluster's mean, before the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.frames import map_slices
from tickweave.llm.vectors import finite_vectors, whole_numbers
from tickweave.session import cut

Long = np.longdouble
SLICE, STRIP = 4096, 64
ROUNDS = 40


# --- eigenvectors ---------------------------------------------------------------------


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of neighbouring values, once they fall, that are no more than `gap` apart; groups of two or more."""
    values = -np.sort(-values)
    ends = np.flatnonzero(np.abs(np.diff(values)) > gap) + 1
    return [g for g in np.split(np.arange(len(values)), ends) if len(g) > 1]


def _refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
    """One step: better vectors, eigenvalues, how far x was from diagonalising a and from orthogonal, and the clusters it could not separate."""
    r = np.eye(len(a), dtype=Long) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that corrections of a pair cancel in x'x
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    error = float(max(np.abs(s - np.diag(np.diag(s))).max(), np.abs(r).max()))
    gap = 2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, error, _clusters(values, gap)


def _separate(a: np.ndarray, x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sub-solve: turn the vectors of a cluster by the eigenvectors of their own matrix about its mean; nothing if that is diagonal already."""
    part = x[:, group]
    small = part.T @ (a @ part)
    if np.abs(small - np.diag(np.diag(small))).max() < 64 * np.finfo(Long).eps * np.abs(a).max():
        return x
    small = small - np.eye(len(group), dtype=Long) * (np.trace(small) / len(group))
    _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
    out = x.copy()
    out[:, group] = part @ turn[:, ::-1].astype(Long)
    return out


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, largest entry positive) of a symmetric matrix, in the long format."""
    a = a.astype(Long)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a), dtype=Long), np.eye(len(a), dtype=Long)
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x[:, ::-1].astype(Long)
    best, least, idle = x, np.inf, 0
    for _ in range(ROUNDS):
        better, values, error, clusters = _refine(a, x)
        if error < least:
            best, least, idle = x, error, 0
        elif (idle := idle + 1) == 3:  # nothing but rounding is left
            break
        order = np.argsort(-values, kind="stable")
        x = better[:, order]
        for group in clusters:
            x = _separate(a, x, group)
    if least > 1e-15:
        raise ArithmeticError(f"eigenvectors are still {least} from exact after {ROUNDS} rounds")
    x = best
    x = x / np.sqrt((x**2).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    return values, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])


# --- sums over the distinct vectors ---------------------------------------------------


def _pack() -> object:
    """Vectors as bytes, two a component where that is enough: equal vectors have equal bytes."""

    def step(batch: pa.RecordBatch):
        x = whole_numbers(batch.column(0))
        short = (np.abs(x) < 2**15).all(axis=1)
        return ([row.astype("<i2" if s else "<i4").tobytes() for row, s in zip(x, short, strict=True)],)

    return step


def _unpack(column: pa.Array, size: int) -> np.ndarray:
    rows = [np.frombuffer(b, "<i2" if len(b) == 2 * size else "<i4") for b in column.to_pylist()]
    return np.array(rows, dtype=np.int64).reshape(len(rows), size)


def _totals(distinct: DataFrame, size: int, add, kind: str) -> dict[tuple[int, int], int | float]:
    """Sums over all distinct vectors of the matrix that `add(rows)` makes of some of them; one matrix a task is shuffled, in strips of STRIP entries."""
    number = pa.int64() if kind == "long" else pa.float64()
    fields = pa.schema([("i", pa.int32()), ("strip", pa.int32()), ("part", pa.list_(number))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, room = None, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = add(_unpack(batch.column(0).slice(at, SLICE), size))
                most = float(np.abs(part).max(initial=0))
                if total is not None and kind == "long" and room + most >= 2.0**62:
                    yield out(total)
                    total, room = None, 0.0
                room += most
                total = part if total is None else total + part
        if total is not None:
            yield out(total)

    def out(total: np.ndarray) -> pa.RecordBatch:
        strips = [(i, j // STRIP, total[i, j : j + STRIP].tolist()) for i in range(len(total)) for j in range(0, total.shape[1], STRIP)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*strips, strict=True), fields, strict=True)], schema=fields)

    entry = lambda j: F.get("part", F.lit(j)).cast("decimal(38,0)" if kind == "long" else "double")
    parts = distinct.mapInArrow(partial, f"i int, strip int, part array<{kind}>")
    rows = parts.groupBy("i", "strip").agg(*[F.sum(entry(j)).alias(f"s{j}") for j in range(STRIP)]).collect()
    return {(r[0], r[1] * STRIP + j): r[2 + j] for r in rows for j in range(STRIP) if r[2 + j] is not None}


def _product(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers; in float64 where no sum can leave its 53 bits."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < 2.0**53:
        f = y.astype(np.float64)
        return np.rint(f.T @ f).astype(np.int64)
    return y.T @ y


def exact_covariance(n: int, sums: list[int], centre: np.ndarray, products: np.ndarray) -> np.ndarray:
    """(n G - D D') / n^2 of products G about a whole centre and D = sums - n * centre, rounded once to the long format."""
    d = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    out = np.zeros(products.shape, dtype=Long)
    for i in range(len(d)):
        for j in range(i + 1):
            exact = Fraction(n * products[i, j] - d[i] * d[j], n * n)
            high = float(exact)
            out[i, j] = out[j, i] = Long(high) + Long(float(exact - Fraction(high)))
    return out


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of whole-number rows; a component without variance is NaN."""
        mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - mean) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it does not fit into a long."""
        n, s = self.n, self.sums
        cross, left, place = [0] * len(x), [abs(v) for v in s], 0
        sign = np.array([-1 if v < 0 else 1 for v in s])
        while any(left):  # 24 bits of the sums at a time
            piece = np.array([v & (2**24 - 1) for v in left], dtype=np.int64) * sign
            cross = [c + (p << place) for c, p in zip(cross, (x @ piece).tolist(), strict=True)]
            left, place = [v >> 24 for v in left], place + 24
        squares = (x * x).sum(axis=1).tolist()
        constant = sum(v * v for v in s)
        found = [n * n * q - 2 * n * c + constant for q, c in zip(squares, cross, strict=True)]
        return [v if v < 2**63 else None for v in found]


def fit(rows: DataFrame, size: int, components: int = 4) -> Whitening:
    """Whitening of the distinct vectors of `rows` (vec_id, vector), all of `size` components."""
    # Read three times; a shuffled byte string a distinct vector.
    distinct = cut(map_slices(rows.select("vector"), _pack, "packed binary", rows=SLICE).distinct())
    found = _totals(distinct, size, lambda x: np.concatenate([[len(x)], x.sum(axis=0)])[None, :], "long")
    n, sums = int(found[0, 0]), [int(found[0, i + 1]) for i in range(size)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    gram = _totals(distinct, size, lambda x: _product(x - centre), "long")
    products = np.array([[int(gram[i, j]) for j in range(size)] for i in range(size)], dtype=object)
    covariance = exact_covariance(n, sums, centre, products)
    values, vectors = eigenvectors(covariance)
    trace = np.trace(covariance)
    # What is left of a component without variance is rounding.
    values = np.where(values > 16 * size * trace * np.finfo(Long).eps, values, 0)[:components]
    explained = [float(v / trace) if trace else None for v in values]
    model = Whitening(n, sums, values.astype(np.float64), vectors[:, :components].astype(np.float64), explained, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        z = np.nan_to_num(model.project(x))
        return np.vstack([z.sum(axis=0), z.T @ z])

    seen = _totals(distinct, size, moments, "double")
    k = len(values)
    mean = np.array([seen[0, j] for j in range(k)]) / n
    second = np.array([[seen[i + 1, j] for j in range(k)] for i in range(k)]).reshape(k, k) / n
    off = np.abs(second - np.outer(mean, mean) - np.diag((model.values > 0).astype(float)))
    return Whitening(n, sums, model.values, model.vectors, explained, float(off.max(initial=0)))


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every finite vector and component.

    Rows whose vector is null or holds null or non-finite entries have no row, nor have vectors without entries. Repeated rows each get their
    rows; for the fit equal vectors count once. Vectors of different sizes are fitted apart, size by size. A component without variance
    (fewer distinct vectors than components, equal vectors) has whitened null and explained 0, null if nothing varies.
    A deviation beyond a long is null. A component of 2^16 or more is an error, as exact sums would leave 64 bits.
    """
    rows = finite_vectors(vectors, vec_id, embedding).filter(F.size("vector") > 0)
    sizes = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    parts = [_apply(same, fit(same, size, components), schema) for size in sizes for same in [rows.filter(F.size("vector") == size)]]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def _apply(rows: DataFrame, model: Whitening, schema: str) -> DataFrame:
    k = len(model.values)

    def make():
        def step(batch: pa.RecordBatch):
            x = whole_numbers(batch.column(1))
            again = np.repeat(np.arange(len(x)), k)
            z = model.project(x).ravel()
            return (
                batch.column(0).take(pa.array(again)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(again), model.n),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(again)), pa.array(z, mask=np.isnan(z)),
                pa.array(model.explained * len(x), pa.float64()), np.full(len(again), model.identity_error),
            )

        return step

    return map_slices(rows, make, schema, rows=SLICE)

