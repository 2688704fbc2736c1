"""Column helpers: guarded arithmetic, dates, list-valued strings, keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b with NULL instead of an error when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.isnan(c), None).otherwise(c)


def finite(c: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clip(c: Column | str, lo, hi) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, _lit(lo)), _lit(hi)))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def safe_log_ratio(a: Column | str, b: Column | str) -> Column:
    return F.ln(ratio(a, b))


def corr_from_moments(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson correlation from power sums, NULL when either side is constant."""
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    cov = sxy - sx * sy / n
    ok = (n > 1) & (vx > 0) & (vy > 0)
    return F.when(ok, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate correlation over rows where both sides exist.

    ``corr`` raises on a constant series in ANSI mode; this gives NULL there.
    """
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


# --- dates -----------------------------------------------------------------

def minute_of_day(ts: Column | str) -> Column:
    ts = col(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def seconds(ts: Column | str) -> Column:
    """Seconds since the epoch with the fraction kept."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def calendar_fields(ts: Column | str) -> dict[str, Column]:
    """Fields read off a timestamp; Monday is 0."""
    ts = col(ts)
    return {
        "day": F.to_date(ts),
        "minute_of_day": minute_of_day(ts),
        "month": F.month(ts),
        "weekday": F.weekday(ts),
        "year": F.year(ts),
        "month_start": month_start(ts),
    }


# --- strings and list-valued strings -----------------------------------------

def parse_list(c: Column | str) -> Column:
    """'["a","b"]' → array; text that is no list → empty array."""
    parsed = F.from_json(col(c), "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def yes_token(outcomes: Column | str, tokens: Column | str) -> Column:
    """Token whose outcome reads "yes"; else the first token."""
    names, ids = parse_list(outcomes), parse_list(tokens)
    zipped = F.arrays_zip(names.alias("name"), ids.alias("id"))
    hit = F.filter(zipped, lambda z: F.lower(F.trim(z["name"])) == "yes")
    return F.coalesce(F.try_element_at(hit, F.lit(1))["id"], F.try_element_at(ids, F.lit(1)))


def binary_outcome(prices: Column | str) -> Column:
    """First settled price ≥ 0.99 → 1, ≤ 0.01 → 0, anything else → NULL."""
    values = parse_list(prices)
    first = F.element_at(values, 1).try_cast("double")
    first = F.when(F.size(values) >= 2, first)
    return F.when(first >= 0.99, 1).when(first <= 0.01, 0)


def pair_key(a: Column | str, b: Column | str, sep: str = "_") -> Column:
    """Key of an unordered pair."""
    return F.array_join(F.array_sort(F.array(col(a), col(b))), sep)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    words_col = F.array(*[F.lit(w.lower()) for w in words])
    return F.exists(words_col, lambda w: F.contains(text, w))


def label(cases: list[tuple[Column, object]], default=None) -> Column:
    """First matching case wins."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)
