"""Joins on keys that may be hot, and reproducible hash draws."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
# rows a task gets where their number is known
PART = 500_000
# hash draws are uniform below this: 15 hexadecimal digits
DRAWS = 2**60


def salted_join(
    big: DataFrame, side: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join where rows of ``big`` with one key are split over ``salts`` tasks.

    ``side`` is repeated once per salt, so it should be the narrow table (pairs,
    roles, statistics per key). AQE still turns it into a broadcast when its
    measured size is under the threshold.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, n: int, *keys: str, part: int | None = None) -> DataFrame:
    """Rows dealt by key over as many tasks as ``n`` rows ask for, whatever the session's number of partitions."""
    return df.repartition(max(1, math.ceil(n / (part or PART))), *keys)


def hash_draw(*parts: Column, seed: int = 0) -> Column:
    """Uniform bigint in [0, 2^60) from the text of the parts, the same on any engine."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_unit(*parts: Column, seed: int = 0) -> Column:
    return hash_draw(*parts, seed=seed) / F.lit(float(DRAWS))


def one_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """First (or last) row per key as an aggregate, so copies merge before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def beside(df: DataFrame, row: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Columns of a one-row table on every row, read by one scalar subquery (no join).

    ``fields`` maps new names to columns of ``row``; without it all are taken.
    """
    fields = fields or {c: c for c in row.columns}
    one = row.select(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("_one")).scalar()
    return df.withColumn("_one", one).withColumns({n: F.col("_one")[n] for n in fields}).drop("_one")


# the largest prime under 2^31: products of two remainders fit into a bigint
_PRIME = 2**31 - 1
# an even number, so that the halves end where they began
_ROUNDS = 6
# further walks, far more than any table needs: each ends outside with a chance of 2 / sqrt(n)
_WALKS = 64


def round_draws(*key: Column, seed: int = 0) -> Column:
    """Shifts and factors of ``permuted`` for one key, two rounds a piece; made once per key, not per row."""
    draw = lambda k: F.pmod(hash_draw(*key, F.lit(k), seed=seed), F.lit(_PRIME - 1)) + 1
    return F.array(*[F.struct(*[draw(4 * k + i).alias(c) for i, c in enumerate(("shift", "factor", "shift2", "factor2"))]) for k in range(_ROUNDS // 2)])


# evaluates an expression once, for all places where it is used
def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _mixed(v: Column, shift: Column, factor: Column) -> Column:
    t = (v + shift) % _PRIME
    return t * t % _PRIME * factor % _PRIME


def _walk(place: Column, n: Column, send: Callable[[Column, Column], Column]) -> Column:
    """Where ``send`` (on a grid of so many columns) takes the place, sent on until it is below n."""

    def inside(x: Column, wide: Column) -> Column:
        on = F.aggregate(F.sequence(F.lit(1), F.lit(_WALKS)), x, lambda v, _: F.when(v < n, v).otherwise(send(v, wide)))
        return F.when(x < n, x).otherwise(_let(on, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a permuted place stayed outside")).cast("bigint"))))

    wide = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    return _let(wide, lambda w: _let(send(place, w), lambda x: inside(x, w)))


def permuted(place: Column, n: Column, draws: Column) -> Column:
    """Where a keyed pseudorandom permutation of 0 .. n-1 sends ``place``, in integer arithmetic: no sort, no shuffle.

    A Feistel network on a grid of ceil(sqrt(n)) columns and as many lines as n needs: line and column take turns in shifting each other. Places
    that end beyond n are sent on until they end inside, which keeps it one to one.
    """

    def send(place: Column, wide: Column) -> Column:
        high = F.floor((n + wide - 1) / wide)

        def rounds(v: Column, d: Column) -> Column:
            line = (F.floor(v / wide) + _mixed(v % wide, d["shift"], d["factor"])) % high
            return line * wide + (v % wide + _mixed(line, d["shift2"], d["factor2"])) % wide

        return F.aggregate(draws, place.cast("bigint"), rounds)

    return _walk(place, n, send)


def unpermuted(place: Column, n: Column, draws: Column) -> Column:
    """The place that ``permuted`` sends to ``place``: the same rounds, taken back from the last to the first."""

    def send(place: Column, wide: Column) -> Column:
        high = F.floor((n + wide - 1) / wide)

        def rounds(v: Column, d: Column) -> Column:
            line = F.floor(v / wide)
            column = F.pmod(v % wide - _mixed(line, d["shift2"], d["factor2"]), wide)
            return F.pmod(line - _mixed(column, d["shift"], d["factor"]), high) * wide + column

        return F.aggregate(F.reverse(draws), place.cast("bigint"), rounds)

    return _walk(place, n, send)


def permuted_sql(columns: str, source: str) -> str:
    """DuckDB twin of ``permuted``, to stand in WITH RECURSIVE: rows of ``source`` (the columns, b, place, n) with ``p``, where p < n."""
    def once(rows: str, place: str) -> str:
        out = f"SELECT {columns}, b, n, wide, high, d, {place} // wide AS x, {place} % wide AS y FROM {rows}"
        for k in range(_ROUNDS):
            t = f"((y + d[{2 * k + 1}]) % {_PRIME})"
            out = f"SELECT {columns}, b, n, wide, high, d, y AS x, (x + ({t} * {t} % {_PRIME}) * d[{2 * k + 2}] % {_PRIME}) % {'wide' if k % 2 else 'high'} AS y FROM ({out})"
        return f"SELECT {columns}, b, n, wide, high, d, x * wide + y AS p FROM ({out})"

    grid = f"SELECT *, (n + wide - 1) // wide AS high FROM (SELECT *, greatest(ceil(sqrt(n::DOUBLE))::BIGINT, 1) AS wide FROM {source})"
    return f"{once(f'({grid})', 'place')} UNION ALL {once('walk WHERE p >= n', 'p')}"


def round_draws_sql(key: str, seed: int = 0) -> str:
    return "[" + ", ".join(f"('0x' || substr(md5('{seed}-' || {key} || '-{k}'), 1, 15))::BIGINT % {_PRIME - 1} + 1" for k in range(2 * _ROUNDS)) + "]"
