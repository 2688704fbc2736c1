"""Ordered work on keyed series without ever holding a long series in one task.

A window partitioned by the key alone sends a whole series to a single task, which fails once one key owns a third of the
data. Series are therefore measured first, by one aggregate over key and order columns:

* Where no key has more than ``block`` rows, a plain window per key does: one exchange, nothing else.
* A longer series is cut into cells: equal steps of its first order column, cut again where they are dense, so that
  a cell has an eighth of a block at most. Consecutive cells make blocks, and the number of rows before each cell is known.
  A row learns its block, and the neighbouring blocks that look back or ahead to it, from one broadcast table of
  cells before the exchange, so border rows travel in the same exchange as all others.

``over_series`` runs window expressions per (key, block), ``index_rows`` numbers rows, ``running`` gives cumulative values with
block totals carried forward, ``affine_scan`` recursions y = a * y_before + b. Rows that agree in key and first order column stay
together. A NULL key is a series of its own, NULL comes first in the order. ``bounded=True`` is for series that the calendar itself bounds, one
row per key and day or minute: they are not measured.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import WindowSpec

#: Rows of a series that one task orders.
BLOCK = 1_000_000
#: Blocks of all long series together; beyond, blocks get longer.
MOST_BLOCKS = 50_000
#: Cells of a block, parts that a dense cell is cut into, and how often.
CELLS, PARTS, CUTS = 8, 64, 5
_INF = float("inf")


# --- measuring ------------------------------------------------------------------------


def bit_image(x: Column) -> Column:
    """The 64-bit pattern of a finite double, read as a number with the double's sign: it rises with x, in equal steps inside each power of two."""
    size = F.abs(x)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    # the logarithm may be off by one next to a power of two
    exponent = F.greatest(guess + F.when(size / power >= 2, 1.0).when(size < power, -1.0).otherwise(0.0), F.lit(-1022.0))
    pattern = (exponent + 1023 + (size / F.pow(F.lit(2.0), exponent) - 1)) * F.lit(2.0**52)
    return F.when(x == 0, 0.0).when(x < 0, -pattern).otherwise(pattern)


def order_number(df: DataFrame, column: str, skip: Column | int = 0) -> Column:
    """A double that rises with the column, whatever orderable type that has; NULL is -inf, NaN is inf.

    Of a text it is the six bytes (a double holds no more) after ``skip``; UTF-8 bytes are in the order of the text.
    """
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.coalesce(F.unix_micros(c.cast("timestamp")).cast("double"), F.lit(-_INF))
    if isinstance(kind, T.StringType):
        start = F.lit(1) + 2 * (F.lit(skip) if isinstance(skip, int) else skip)
        return F.coalesce(F.conv(F.rpad(F.hex(F.encode(c, "utf-8")).substr(start, F.lit(12)), 12, "0"), 16, 10).cast("double"), F.lit(-_INF))
    if isinstance(kind, T.BooleanType):
        c = c.cast("int")
    number = c.cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        image = F.when(F.abs(number) == _INF, number).otherwise(bit_image(number))
        return F.when(number.isNull(), F.lit(-_INF)).when(F.isnan(number), F.lit(_INF)).otherwise(image)
    return F.when(number.isNull(), F.lit(-_INF)).when(F.isnan(number), F.lit(_INF)).otherwise(number)


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal columns where NULL equals NULL; ``right`` has one row per key."""
    side = right.select(*[F.col(f"`{c}`").alias(f"_same_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    match = [left[c].eqNullSafe(side[f"_same_{c}"]) for c in on]
    met = left.join(side, reduce(lambda a, b: a & b, match), how) if match else left.join(side, how="cross")
    return met.drop(*[f"_same_{c}" for c in on])


@dataclass(frozen=True)
class Cells:
    """Cells of the long series: ``levels`` say how a value finds its cell, ``rows`` has (key, [(cell, rows)]) in order."""

    keys: list[str]
    order: str
    types: list[T.StructField]
    levels: list[list[tuple]]
    rows: list[tuple[tuple, list[tuple[int, int]]]]
    size: int

    def _table(self, df: DataFrame, rows: list[tuple], extra: str) -> DataFrame:
        schema = T.StructType([*self.types, *T.StructType.fromDDL(extra).fields])
        if not any(isinstance(f.dataType, T.TimestampType) for f in self.types):
            # handed over as one Arrow table, so that reading it starts no Python worker
            rows = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))
        # As many rows as long series have cells, 8 * MOST_BLOCKS or a few more.
        return F.broadcast(df.sparkSession.createDataFrame(rows, schema))

    def place(self, df: DataFrame, how: str = "left") -> DataFrame:
        """Adds ``_cell``, NULL for rows of short series (which ``how="inner"`` leaves out); rows that have it keep it."""
        if "_cell" in df.columns:
            return df.filter("_cell IS NOT NULL") if how == "inner" else df
        v, out = order_number(df, self.order, F.col("_skip")), df
        for depth, level in enumerate(self.levels):
            on = self.keys if depth == 0 else [*self.keys, "_cell"]
            side = self._table(df, level, "_low double, _step double, _parts bigint, _skip int" if depth == 0 else "_cell bigint, _low double, _step double, _parts bigint, _skip int")
            out = join_same(out, side, on, how if depth == 0 else "left")
            part = F.when(v == -_INF, 0).when(v == _INF, F.col("_parts") + 1)
            part = part.otherwise(F.least(F.greatest(F.floor((v - F.col("_low")) / F.col("_step")), F.lit(0)), F.col("_parts") - 1) + 1)
            part = F.when(F.col("_parts").isNull(), 0).otherwise(part).cast("bigint")
            cell = F.when(F.col("_parts").isNotNull(), part) if depth == 0 else F.col("_cell") * (2 * PARTS) + part
            out = out.withColumn("_cell", cell).drop("_low", "_step", "_parts", "_skip")
        return out

    def blocks(self, before: int, after: int) -> list[tuple[tuple, int, list[dict]]]:
        """(key, cell, [(block, its own, position of the block's first row)]): the cell's own block and those that it is copied into."""
        out = []
        for key, cells in self.rows:
            start = [0]
            for _, n in cells:
                start.append(start[-1] + n)
            home = [start[i] // self.size for i in range(len(cells))]
            into: list[list] = [[] for _ in cells]
            first = 0
            while first < len(cells):
                last = first
                while last + 1 < len(cells) and home[last + 1] == home[first]:
                    last += 1
                low, high = first, last
                while low > 0 and start[first] - start[low] < before:
                    low -= 1
                while high + 1 < len(cells) and start[high + 1] - start[last + 1] < after:
                    high += 1
                for i in range(low, high + 1):
                    into[i].append({"_block": home[first], "_own": first <= i <= last, "_base": start[low]})
                first = last + 1
            out += [(key, cell, targets) for (cell, _), targets in zip(cells, into, strict=True)]
        return out

    def spread(self, df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Adds ``_block``, ``_own`` (False for copies) and ``_base``, the position of the first row that the block holds."""
        rows = [(*key, cell, targets) for key, cell, targets in self.blocks(before, after)]
        side = self._table(df, rows, "_cell bigint, _into array<struct<_block: bigint, _own: boolean, _base: bigint>>")
        placed = join_same(self.place(df), side, [*self.keys, "_cell"])
        alone = F.array(F.struct(F.lit(0).cast("bigint").alias("_block"), F.lit(True).alias("_own"), F.lit(0).cast("bigint").alias("_base")))
        return placed.withColumn("_to", F.explode(F.coalesce("_into", alone))).select(*df.columns, "_to.*")

    def totals(self, df: DataFrame, name: str) -> DataFrame:
        return self._table(df, [(*key, sum(n for _, n in cells)) for key, cells in self.rows], f"`{name}` bigint")


@dataclass(frozen=True)
class Unmeasured:
    """Stands for cells that are still to be measured; steps on the same rows share one measurement by passing it on."""


UNMEASURED = Unmeasured()


def measure(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: int = BLOCK) -> Cells | None:
    """Cells of the series of more than ``block`` rows; None if there is none.

    The driver holds only what is longer than a block: at most one entry per ``block`` rows of input, and their cells.
    """
    keys, by = list(keys), order[0]
    text = isinstance(df.schema[by].dataType, T.StringType)
    v = order_number(df, by)
    finite = F.col(by) if text else F.when(F.abs(v) < _INF, v)
    about = [F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_low"), F.max(finite).alias("_high")]
    slim = df.select(*keys, F.col(by)) if by not in keys else df.select(*keys)
    found = slim.groupBy(*keys).agg(*about).filter(F.col("_n") > block).collect()
    if not found:
        return None
    size = max(block, sum(r["_n"] for r in found) // MOST_BLOCKS)
    goal = max(1, size // CELLS)

    def step(r, parts: int) -> tuple:
        low, high, skip = r["_low"], r["_high"], 0
        wide = low is not None and high > low
        if wide and text:
            # all values between share what the two ends begin with
            low, high = low.encode(), high.encode()
            skip = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), len(low))
            low, high = (float(int.from_bytes(x[skip : skip + 6].ljust(6, b"\0"), "big")) for x in (low, high))
        return (low if wide else 0.0, (high - low) / parts if wide and high > low else 1.0, parts if wide else 1, skip)

    types = [df.schema[c] for c in keys]
    types = [T.StructField(f.name, f.dataType, True) for f in types]
    levels = [[(*[r[c] for c in keys], *step(r, -(-r["_n"] // goal))) for r in found]]
    while True:
        cells = Cells(keys, by, types, levels, [], size)
        counts = cells.place(slim, "inner").groupBy(*keys, "_cell").agg(*about).collect()
        dense = [r for r in counts if r["_n"] > goal and r["_low"] is not None and r["_low"] < r["_high"]]
        if not dense or len(levels) > CUTS:
            break
        levels = [*levels, [(*[r[c] for c in keys], r["_cell"], *step(r, PARTS)) for r in dense]]
    by_key: dict[tuple, list] = {}
    for r in counts:
        by_key.setdefault(tuple(r[c] for c in keys), []).append((r["_cell"], r["_n"]))
    return Cells(keys, by, types, levels, [(k, sorted(c)) for k, c in by_key.items()], size)


def _measured(df, keys, order, bounded: bool, block: int, cells: Cells | None | Unmeasured) -> Cells | None:
    if bounded:
        return None
    return measure(df, keys, order, block) if isinstance(cells, Unmeasured) else cells


# --- window work ----------------------------------------------------------------------


def _in_blocks(df: DataFrame, keys: Sequence[str], cells: Cells | None, before: int = 0, after: int = 0) -> tuple[DataFrame, list[str]]:
    """Rows with block, own and base, and the columns that part a window."""
    if cells is None:
        return df.withColumns({"_block": F.lit(0).cast("bigint"), "_own": F.lit(True), "_base": F.lit(0).cast("bigint")}), list(keys)
    return cells.spread(df, before, after), [*keys, "_block"]


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "_pos", total: str | None = None, bounded: bool = False, block: int = BLOCK, cells: Cells | None | Unmeasured = UNMEASURED) -> DataFrame:
    """Add the 0-based position of each row in its series (and the series length)."""
    keys, order = list(keys), list(order)
    cells = _measured(df, keys, order, bounded, block, cells)
    rows, whole = _in_blocks(df, keys, cells)
    out = rows.withColumn(pos, (F.col("_base") + F.row_number().over(W.partitionBy(*whole).orderBy(*order)) - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.count(F.lit(1)).over(W.partitionBy(*whole)))
        if cells:
            out = join_same(out, cells.totals(df, "_all"), keys).withColumn(total, F.coalesce("_all", total)).drop("_all")
    return out.drop("_block", "_own", "_base")


def into_blocks(df: DataFrame, pos: str, before: int, after: int, block: int) -> DataFrame:
    """Assign row blocks by position and copy border rows into the neighbouring block."""
    home = F.floor(F.col(pos) / F.lit(block)).cast("bigint")
    place = F.col(pos) % F.lit(block)
    targets = [home]
    if before:
        targets.append(F.when(place >= F.lit(block - before), home + 1))
    if after:
        targets.append(F.when((place < F.lit(after)) & (home > 0), home - 1))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_own", F.col("_home") == F.col("_block"))
        .drop("_home")
    )


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    bounded: bool = False,
    block: int = BLOCK,
    keep_pos: str | None = None,
    cells: Cells | None | Unmeasured = UNMEASURED,
) -> DataFrame:
    """Apply window expressions that look ``before`` rows back and ``after`` ahead, in one exchange.

    ``build(df, w)`` adds columns with ``w`` = rows of the series in order; for chained expressions pass the summed
    reach. ``_pos`` is the position of a row in its series. A block at the true start of a series holds no
    copied rows, so ``count(...) == n`` tests for full windows stay exact.
    """
    keys, order = list(keys), list(order)
    cells = _measured(df, keys, order, bounded, max(block, 4 * before, 4 * after), cells)
    rows, whole = _in_blocks(df, keys, cells, before, after)
    w = W.partitionBy(*whole).orderBy(*order)
    # dropped by the optimizer where nobody reads it
    rows = rows.withColumn("_pos", (F.col("_base") + F.row_number().over(w) - 1).cast("bigint"))
    out = build(rows, w).filter("_own").drop("_own", "_block", "_base")
    return out.withColumnRenamed("_pos", keep_pos) if keep_pos else out.drop("_pos")


_CARRY = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column | str]], bounded: bool = False, block: int = BLOCK, cells: Cells | None | Unmeasured = UNMEASURED) -> DataFrame:
    """Running sum / count / max / min / last-known value from the start of the series.

    ``values`` maps a new column to (kind, expression). Blocks of long series add what the blocks before them came to.
    """
    keys, order = list(keys), list(order)
    cells = _measured(df, keys, order, bounded, block, cells)
    inputs = {f"_in_{name}": (F.col(v) if isinstance(v, str) else v) for name, (_, v) in values.items()}
    rows, whole = _in_blocks(df.withColumns(inputs), keys, cells)
    frame = W.partitionBy(*whole).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = {n: (F.last(f"_in_{n}", ignorenulls=True) if kind == "last" else getattr(F, kind)(f"_in_{n}")).over(frame) for n, (kind, _) in values.items()}
    out = rows.withColumns(local)
    if cells:
        totals = []
        for n, (kind, _) in values.items():
            x = F.col(f"_in_{n}")
            whole_block = F.max_by(x, F.when(x.isNotNull(), F.struct(*order))) if kind == "last" else getattr(F, kind)(x)
            totals.append(whole_block.alias(f"_tot_{n}"))
        # one row per block of a long series
        earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        long = cells.spread(cells.place(df.withColumns(inputs), "inner"))
        carried = [(F.last(f"_tot_{n}", ignorenulls=True) if kind == "last" else _CARRY[kind](f"_tot_{n}")).over(earlier).alias(f"_carry_{n}") for n, (kind, _) in values.items()]
        carry = long.groupBy(*keys, "_block").agg(*totals).select(*keys, "_block", *carried)
        out = join_same(out, F.broadcast(carry), [*keys, "_block"])
        for n, (kind, _) in values.items():
            here, past = F.col(n), F.col(f"_carry_{n}")
            both = {"max": F.greatest(here, past), "min": F.least(here, past), "last": F.coalesce(here, past)}.get(kind)
            out = out.withColumn(n, F.coalesce(here + past, here, past) if both is None else both).drop(f"_carry_{n}")
    return out.drop("_block", "_own", "_base", *inputs)


# --- recursions -----------------------------------------------------------------------

#: A chunk of rows ends where its factors have shrunk by e^-300; a single factor counts as e^-300 at least.
_SHRUNK = 300.0


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], maps: dict[str, tuple[Column, Column]], bounded: bool = False, block: int = BLOCK, cells: Cells | None | Unmeasured = UNMEASURED) -> DataFrame:
    """Recursions y = a * y_before + b with 0 <= a <= 1 and y_before = 0 at the start: ``maps`` has {new: (a, b)}.

    Affine maps compose, so a chunk of rows is one map and rows inside it need sums only: y = exp(-r) * sum(exp(r) * b) with r the sum
    of -ln(a), which keeps full precision while exp(r) fits into a double. A chunk ends before it no longer does; what a chunk takes over is
    the end of the one before it, itself corrected by what that took over, and so is the value at the start of a block
    of a long series. Older values weigh less than e^-600, less than a double shows. b must not be NULL.
    """
    keys, order = list(keys), list(order)
    cells = _measured(df, keys, order, bounded, block, cells)
    parts = {n: (F.least(-F.ln(F.greatest(a, F.lit(math.exp(-_SHRUNK)))), F.lit(_SHRUNK)), b) for n, (a, b) in maps.items()}
    inputs = {f"_{what}_{n}": part for n, pair in parts.items() for what, part in zip("fb", pair, strict=True)}
    rows, whole = _in_blocks(df.withColumns(inputs), keys, cells)
    for n in maps:
        rows = _scan_blocks(rows, whole, order, n)
    if cells:
        ends = {}
        for n in maps:
            ends |= {f"_y_{n}": F.max_by(n, F.struct(*order)), f"_r_{n}": F.sum(f"_f_{n}")}
        long = cells.spread(cells.place(df.withColumns(inputs), "inner"))
        for n in maps:
            long = _scan_blocks(long, whole, order, n)
        # one row per block of a long series; a block's end as if nothing came before, and its whole factor
        block_ends = long.groupBy(*whole).agg(*[e.alias(n) for n, e in ends.items()])
        # a factor that is not 0 to a double spans few blocks: those of a million rows, one; the fold takes all that matter
        earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(-64, -1)
        fold = lambda n: F.aggregate(F.collect_list(F.struct(F.col(f"_y_{n}").alias("y"), F.col(f"_r_{n}").alias("r"))).over(earlier), F.lit(0.0), lambda y, x: y * F.exp(-x["r"]) + x["y"]).alias(f"_c_{n}")
        rows = join_same(rows, F.broadcast(block_ends.select(*whole, *[fold(n) for n in maps])), whole)
        inside = W.partitionBy(*whole).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        for n in maps:
            rows = rows.withColumn(n, F.col(n) + F.coalesce(F.exp(-F.sum(f"_f_{n}").over(inside)) * F.col(f"_c_{n}"), F.lit(0.0))).drop(f"_c_{n}")
    return rows.select(*df.columns, *maps)


def _scan_blocks(rows: DataFrame, whole: list[str], order: list[str], n: str) -> DataFrame:
    """One recursion inside each block, from the block's start: chunks, their sums, and two rounds of taking over."""
    f, b = F.col(f"_f_{n}"), F.col(f"_b_{n}")
    upto = (W.unboundedPreceding, 0)
    rows = rows.withColumn("_chunk", F.floor(F.sum(f).over(W.partitionBy(*whole).orderBy(*order).rowsBetween(*upto)) / _SHRUNK))
    chunk = W.partitionBy(*whole, "_chunk").orderBy(*order)
    rows = rows.withColumn("_r", F.sum(f).over(chunk.rowsBetween(*upto)))
    rows = rows.withColumn("_own_sum", F.exp(-F.col("_r")) * F.sum(F.exp("_r") * b).over(chunk.rowsBetween(*upto))).withColumn(n, F.col("_own_sum"))
    # in the chunks' own order, so nothing is sorted again
    along = W.partitionBy(*whole).orderBy("_chunk", *order)
    for _ in range(2):
        rows = rows.withColumn("_before", F.lag(n, 1, 0.0).over(along))
        rows = rows.withColumn(n, F.col("_own_sum") + F.exp(-F.col("_r")) * F.first("_before").over(chunk))
    return rows.drop("_chunk", "_r", "_own_sum", "_before")


def lagged(df: DataFrame, keys, order, values: dict[str, tuple[str, int]], bounded: bool = False, block: int = BLOCK, cells: Cells | None | Unmeasured = UNMEASURED) -> DataFrame:
    """Shifted columns: {new: (column, k)}; k > 0 looks back, k < 0 ahead."""
    back = max([k for _, k in values.values()] + [0])
    ahead = max([-k for _, k in values.values()] + [0])

    def build(d, w):
        return d.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in values.items()})

    return over_series(df, keys, order, build, before=back, after=ahead, bounded=bounded, block=block, cells=cells)
