"""Embedding rows as whole numbers; shared by the operators that calculate exactly on 256ths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers stay below this size, so that sums of their products fit into 64 bits.
LIMIT = 2**24


def finite_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int | None = None) -> DataFrame:
    """(vec_id, vector): rows whose vector is there, of the wanted size if one is given, without null or non-finite entries."""
    v = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), v.alias("vector")).filter("vector IS NOT NULL")
    if size is not None:
        rows = rows.filter(F.size("vector") == size)
    return rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """floor(256 * x) of every component, one row a vector; all vectors of the column have the same size."""
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False))
    if flat.size and np.abs(flat).max() >= LIMIT:
        raise ValueError(f"a vector component is {LIMIT // 256} or larger: exact sums would not fit into 64 bits")
    return flat.astype(np.int64).reshape(len(column), -1)
