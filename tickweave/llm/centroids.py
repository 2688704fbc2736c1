"""Centroid clustering on whole numbers, with a bisector tournament for the nearest centroid.

The bisector of two centroids a < b is a plane: x is at least as near to a exactly when x . 2(b - a) <= |b|^2 - |a|^2. All
normals and thresholds are whole numbers and made once per round. A vector begins with centroid 0 as the winner and meets
the others in rising order, k - 1 sign tests in all; a zero leaves the smaller number in the lead. The exact distance is
calculated for the last winner only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.frames import map_slices
from tickweave.llm.vectors import finite_vectors, whole_numbers
from tickweave.session import cut

#: Vectors that meet the bisectors together: their rows and the chosen normals stay in the processor's cache.
SLICE = 512


class Bisectors:
    """Normals and thresholds of all pairs of k centroids (whole numbers, one row each)."""

    def __init__(self, centroids: np.ndarray):
        norms = (centroids**2).sum(axis=1)
        self.centroids = centroids
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]

    def winners(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and the squared distance to it."""
        best = np.zeros(len(vectors), dtype=np.int64)
        for challenger in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", vectors, self.normals[best, challenger]) - self.thresholds[best, challenger]
            best[side > 0] = challenger
        return best, ((vectors - self.centroids[best]) ** 2).sum(axis=1)


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `salt:vec_id`; ties by the vector, rows without vec_id come last."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.floor(256.0 * np.array([r["vector"] for r in chosen], dtype=np.float64)).astype(np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the exact means of their vectors; those without vectors stay.

    Each task adds up its vectors per centroid; at most k rows a task are shuffled and k rows reach the driver.
    """
    k, size = centroids.shape
    fields = pa.schema([("cluster", pa.int32()), ("dimension", pa.int32()), ("total", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, pending = Bisectors(centroids), 0
        sums = np.zeros((k, size + 1), dtype=np.int64)

        def flush() -> pa.RecordBatch:
            cluster, dimension = np.nonzero(sums)
            out = pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dimension, pa.int32()), pa.array(sums[cluster, dimension])], schema=fields)
            sums[:] = 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                vectors = whole_numbers(batch.column(0).slice(at, SLICE))
                best, _ = planes.winners(vectors)
                np.add.at(sums[:, :size], best, vectors)
                sums[:, size] += np.bincount(best, minlength=k)
                pending += len(vectors)
                if pending >= 2**34:  # 2^26 * 2^34 is still far from 2^63
                    yield flush()
                    pending = 0
        yield flush()

    parts = rows.select("vector").mapInArrow(partial, "cluster int, dimension int, total long")
    found = parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = np.zeros((k, size + 1), dtype=object)
    for cluster, dimension, total in found:
        totals[cluster, dimension] = int(total)
    after = [[int(s) // int(t[size]) for s in t[:size]] if t[size] else c.tolist() for t, c in zip(totals, centroids, strict=True)]
    return np.array(after, dtype=np.int64).reshape(k, size)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every vector of `size` finite components.

    Other vectors (null, of another size, with null or non-finite components) have no row. Repeated rows and vectors count as
    often as they stand there; a row without vec_id is clustered too but is a first centroid only when others run out.
    With fewer than k vectors there are as many centroids; equal centroids leave all vectors to the smallest number. An empty table gives none.
    """
    rows = finite_vectors(vectors, vec_id, embedding, size)
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def assign():
        planes = Bisectors(centroids)

        def step(batch: pa.RecordBatch):
            best, distance = planes.winners(whole_numbers(batch.column(1)))
            return batch.column(0), best.astype(np.int32), distance

        return step

    # Narrow rows, read twice: for the sums and for the result.
    placed = cut(map_slices(rows, assign, "vec_id long, cluster int, distance long", rows=SLICE))
    inertia = dict(placed.groupBy("cluster").agg(F.sum("distance")).collect())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(centroids))])
    return placed.select(
        "vec_id", "cluster", "distance", per_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), F.array(*map(F.lit, names))[F.col("cluster")].alias("centroid_sha256"),
    )


def _rounds_sql(k: int, rounds: int, size: int, salt: str) -> str:
    """DuckDB SQL of `cluster`: every round compares each vector with each centroid."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})",
        "v AS (SELECT row_number() OVER () AS r, vec_id, x FROM kept)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), x) - 1 AS c, x FROM kept ORDER BY sha256('{salt}:' || vec_id), x LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT r, arg_min(c.c, ({near}, c.c)) AS c, min({near}) AS d FROM v, c{n} c GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} JOIN v USING (r), range(1, {size + 1}) d(i) GROUP BY c, i)")
            mean = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
            parts.append(f"m{n} AS (SELECT c, list({mean} ORDER BY i) AS x FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS (SELECT c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c))")
    last = (
        "SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"
    )
    return f"WITH {', '.join(parts)} {last}"


CLUSTER_SQL = _rounds_sql(40, 5, 64, "2")
