"""Reading tables and mapping texts in small Arrow slices; shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one call of a mapping function sees at most; texts may be long, so slices are small.
SLICE_ROWS = 256
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operators use; other columns of the input never clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_(), T.ArrayType(T.LongType()): pa.list_(pa.int64()), T.ArrayType(T.BinaryType()): pa.list_(pa.binary())}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])


# What this Python worker keeps for the next task, one object at most, and whether the task under way asked for it.
_kept: dict = {}
_asked: set = set()


def kept(name: str, build: Callable[[], object]):
    """The object of that name, built once in a Python worker and handed on from task to task until one runs that doesn't ask for it."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    _asked.add(name)
    return _kept[name]


def start_task(make: Callable | None = None):
    """What `make` returns; lets go what earlier tasks kept and this one doesn't ask for, so that workers don't carry one stage's tables through the next."""
    _asked.clear()
    step = make() if make else None
    if not _asked and _kept:
        _kept.clear()
    return step


def end_task() -> None:
    """Freed Arrow buffers go back to the system."""
    pa.default_memory_pool().release_unused()


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Sequence | None]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """`make()` runs once per task and gives a function from a slice of rows to the columns of `schema`."""
    parsed = T.StructType.fromDDL(schema)
    out = arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start_task(make)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = step(batch.slice(at, rows))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        end_task()

    return df.mapInArrow(run, parsed)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet: the given ones, with underscores put behind those that it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
