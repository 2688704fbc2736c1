"""Approximate nearest neighbours by collision counting.

Vectors lie in regions, each around one vector of a bounded sample. A query's k-th smallest distance to that sample bounds its
search; regions whose vectors must all be farther are left out, and a region holds blocks of vectors. In each block
every random projection is one sorted array. A query opens a window around its own projection in each of them; the windows
widen with the radius up to the bound (virtual rehashing: no table is built again). A vector that falls into the windows of
at least `threshold` projections is verified by its exact distance. A query ends when its radius reaches the bound or its
k-th best distance in the block, since vectors closer than the radius collide more often than the threshold asks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.session import cut

PROJECTIONS = 64
#: Half-width of a window in units of the radius; a vector at the radius falls into it with probability 0.79.
HALF_WIDTH = 1.25
#: Collisions that make a candidate: 0.69 of the projections. At the radius itself 0.97 of the vectors reach it, nearer ones more surely.
THRESHOLD = 44
#: Growth of the radius from round to round.
GROWTH = 1.25
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 32_768
#: Vectors of the sample that bounds the searches, and those of them (the first) that regions lie around.
SAMPLE, LANDMARKS = 4_096, 1_024


class SortedProjections:
    """Sorted arrays of a block's projections."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.vectors = vectors
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        values = vectors @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        spread = float(np.median(values.std(axis=0))) if len(vectors) else 0.0
        self.first_radius = max(spread / 16, 1e-12)

    def edges(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the windows of several queries, a row a query."""
        low = [np.searchsorted(s, x - reach, side="left") for s, x in zip(self.sorted, at.T, strict=True)]
        high = [np.searchsorted(s, x + reach, side="right") for s, x in zip(self.sorted, at.T, strict=True)]
        return np.stack(low, axis=1), np.stack(high, axis=1)

    def search(self, queries: np.ndarray, names: np.ndarray, bounds: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """Per query the k nearest found of another id within its bound, as (distance, id)."""
        at = queries @ self.axes
        end = np.maximum(bounds, self.first_radius * 1e-6)
        start = np.where(np.isfinite(end), np.minimum(end, np.maximum(end / GROWTH**2, self.first_radius)), self.first_radius)
        first_low, first_high = self.edges(at, HALF_WIDTH * start)
        return [self.search_one(*row, ids, k) for row in zip(queries, names, at, start, end, first_low, first_high, strict=True)]

    def search_one(self, query: np.ndarray, name: int, at: np.ndarray, radius: float, end: float, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
        skip = ids == name
        count = np.zeros(len(self.vectors), dtype=np.int64)
        checked, left = skip.copy(), int((~skip).sum())
        best_d, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        opened = [o[a:b] for o, a, b in zip(self.order, low, high, strict=True)]
        while left:
            count += np.bincount(np.concatenate(opened), minlength=len(count))
            rows = np.flatnonzero((count >= THRESHOLD) & ~checked)
            if len(rows):
                checked[rows] = True
                left -= len(rows)
                distance = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
                best_d, best_i = np.concatenate([best_d, distance]), np.concatenate([best_i, ids[rows]])
                top = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[top], best_i[top]
            if len(best_d) == k:
                end = min(end, best_d[-1])
            if radius >= end:
                break
            radius = min(radius * GROWTH, max(end, radius * 1.01))
            new_low, new_high = (x[0] for x in self.edges(at[None], np.array([HALF_WIDTH * radius])))
            new_low, new_high = np.minimum(low, new_low), np.maximum(high, new_high)
            opened = [o[a:b] for o, a, b in zip(self.order, new_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, new_high, strict=True)]
            low, high = new_low, new_high
        return list(zip(best_d.tolist(), best_i.tolist(), strict=True))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector, dim): finite vectors that are not zero, once per id and value."""
    v = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), v.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0)).dropDuplicates(["vec_id", "vector"]).withColumn("dim", F.size("vector"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of `a` from every row of `b`, to rounding of the matrix product."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Sample:
    """The sampled vectors of each dimension: the first are landmarks of regions, all of them bound the searches."""

    def __init__(self, rows: list, landmarks: int):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.landmarks = landmarks
        for dim in {len(r.vector) for r in rows}:
            own = [r for r in rows if len(r.vector) == dim]
            self.of[dim] = np.array([r.vector for r in own]), np.array([r.vec_id for r in own])

    def region(self, dim: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest landmark and the distance from it; region 0 without landmarks."""
        if dim not in self.of:
            return np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
        far = distances(vectors, self.of[dim][0][: self.landmarks])
        return far.argmin(axis=1), far.min(axis=1)

    def bound(self, dim: int, vectors: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
        """k-th smallest distance to sampled vectors of another id, rounded up."""
        if dim not in self.of or len(self.of[dim][1]) < k:
            return np.full(len(vectors), np.inf)
        far = distances(vectors, self.of[dim][0])
        far[names[:, None] == self.of[dim][1]] = np.inf
        return np.partition(far, k - 1, axis=1)[:, k - 1] * (1 + 1e-6) + 1e-6 * np.sqrt((vectors**2).sum(axis=1))

    def reached(self, dim: int, vectors: np.ndarray, bounds: np.ndarray, widths: dict[tuple[int, int], float]) -> list[list[int]]:
        """Per query the regions of `widths` (their largest distance from the landmark) that may hold a vector within its bound."""
        regions = np.array(sorted(r for d, r in widths if d == dim), dtype=np.int64)
        if dim not in self.of:
            return [regions.tolist()] * len(vectors)
        marks = self.of[dim][0][: self.landmarks]
        far = distances(vectors, marks)
        wide = np.array([widths[dim, r] for r in regions])
        slack = 1e-6 * (1 + np.sqrt((vectors**2).sum(axis=1)))[:, None]
        near = far[:, regions] - wide <= bounds[:, None] + slack
        # Vectors of a region are nearer to its landmark than to the query's own: half the difference of squares over the gap.
        own = far.argmin(axis=1)
        gap = np.maximum(distances(marks, marks)[own][:, regions], 1e-300)
        beyond = (far[:, regions] ** 2 - far[np.arange(len(own)), own][:, None] ** 2) / (2 * gap)
        near &= (beyond <= bounds[:, None] + slack) | (regions == own[:, None])
        return [regions[n].tolist() for n in near]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found per query, by Euclidean distance, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows of another vec_id and the same dimension.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without vec_id; exact
    repeats count once. A query without candidates has no rows. Every query meets the blocks of all regions within its
    bound; a region of many rows has several blocks, dealt by hash.
    """
    rows = cut(usable(vectors, vec_id, embedding))
    total = rows.count()
    # SAMPLE rows at most; their hashes leave about half as many more, so that no task sends the driver its own SAMPLE.
    hashes = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40))
    likely = rows.withColumn("_hash", hashes).filter(F.col("_hash") < int(min(1.0, 1.5 * SAMPLE / max(total, 1)) * (1 << 40)))
    drawn = likely.orderBy("_hash", "vec_id").limit(SAMPLE).select("vec_id", "vector").collect()
    sample = Sample(drawn, min(LANDMARKS, max(1, 2 * total // VECTOR_BLOCK)))

    def by_dimension(batch: pa.RecordBatch):
        """(dim, places, vectors, ids) per dimension of a batch."""
        dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for places in np.array_split(at, -(-len(at) // 1024)):
                yield int(dim), places, matrix(batch.column("vector").take(pa.array(places))), ids[places]

    def place(batches):
        for batch in batches:
            region, far, bound = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            for dim, places, own, ids in by_dimension(batch):
                region[places], far[places] = sample.region(dim, own)
                asks = ids % every == 0
                if asks.any():
                    bound[places[asks]] = sample.bound(dim, own[asks], ids[asks], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far), pa.array(bound)], [*batch.schema.names, "region", "far", "bound"])

    placed = cut(rows.mapInArrow(place, "vec_id long, vector array<double>, dim int, region long, far double, bound double"))
    sizes = cut(placed.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("_n"), F.max("far").alias("wide")))
    # A row a landmark at most; dimensions that the sample does not hold have one region each and are joined, not listed.
    known = sizes.filter(F.col("dim").isin(list(sample.of)))
    widths = {(r.dim, r.region): r.wide for r in known.collect()}

    def route(batches):
        for batch in batches:
            reached: list[list[int]] = [[0]] * batch.num_rows
            bounds = batch.column("bound").to_numpy()
            for dim, places, own, _ in by_dimension(batch):
                if dim in sample.of:
                    for i, found in zip(places, sample.reached(dim, own, bounds[places], widths), strict=True):
                        reached[i] = found
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "vector", "dim", "bound")] + [pa.array(reached, pa.list_(pa.int64()))], ["vec_id", "vector", "dim", "bound", "regions"])

    asked = placed.filter(F.col("vec_id") % every == 0).select("vec_id", "vector", "dim", "bound")
    asked = cut(asked.mapInArrow(route, "vec_id long, vector array<double>, dim int, bound double, regions array<long>"))
    asked = asked.select("vec_id", "vector", "dim", "bound", F.explode("regions").alias("region"))
    parts = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    asking = asked.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("_m"))
    sizes = sizes.join(asking, ["dim", "region"]).select("dim", "region", parts("_n", VECTOR_BLOCK).alias("_vs"), parts("_m", QUERY_BLOCK).alias("_qs"))
    hashed = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ("dim", "region", "_v", "_q")
    stored = placed.select("vec_id", "vector", "dim", "region").join(sizes, ["dim", "region"]).withColumn("_v", hashed("_vs")).withColumn("_q", all_of("_qs")).select("vec_id", "vector", *keys)
    asked = asked.join(sizes, ["dim", "region"]).withColumn("_q", hashed("_qs")).withColumn("_v", all_of("_vs")).select("vec_id", "vector", "bound", *keys)

    def search(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if stored.num_rows and asked.num_rows:
            index, ids = SortedProjections(matrix(stored.column("vector"))), stored.column("vec_id").to_numpy()
            names = asked.column("vec_id").to_numpy()
            for name, found in zip(names.tolist(), index.search(matrix(asked.column("vector")), names, asked.column("bound").to_numpy(), ids, k), strict=True):
                out += [(name, i, d) for d, i in found]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
