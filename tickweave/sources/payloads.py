"""Landed JSON payloads and page/chunk concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.plans.spread import one_of


# fixed values: value names of the daily, weekly and monthly payloads, adjusted ones included
PRICE_FIELDS = ("open", "high", "low", "close", "volume")
ADJUSTED_FIELDS = ("open", "high", "low", "close", "adjusted close", "volume", "dividend amount", "split coefficient")


def parse_ohlcv_payload(df: DataFrame, json_col: str, keys: Sequence[str] = (), fields: Sequence[str] = PRICE_FIELDS) -> DataFrame:
    """Payload with one dated section, e.g. {"Time Series (5min)": {ts: {"1. open": "…"}}}.

    The section name depends on the call ("Weekly Adjusted Time Series", "Technical
    Analysis: SMA"), so it is the part that is not the head. Value names lose their
    number ("1. open" → open), texts become doubles; ``fields`` names the values to
    read, blanks turn into underscores. A payload without a dated section (an error
    message) gives no rows, a field it lacks is NULL.
    """
    sections = F.map_entries(F.from_json(json_col, "map<string,string>"))
    dated = F.filter(sections, lambda e: e["key"].contains("Time Series") | e["key"].startswith("Technical Analysis"))
    body = F.from_json(F.element_at(dated, 1)["value"], "map<string,map<string,string>>")
    rows = df.filter(F.size(dated) > 0).select(*keys, F.explode(body).alias("ts", "_v"))
    named = F.transform_keys("_v", lambda k, _: F.regexp_replace(k, r"^\d+[a-z]?\. ", ""))
    rows = rows.withColumn("_v", named)
    return rows.select(
        *keys,
        F.col("ts").try_cast("timestamp_ntz").alias("ts"),
        *[F.try_element_at("_v", F.lit(f)).try_cast("double").alias(f.replace(" ", "_")) for f in fields],
    )


def parse_history_payload(df: DataFrame, json_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """{"history":[{"t":epoch,"p":x}]} → timestamp, implied_probability."""
    parsed = F.from_json(json_col, "history array<struct<t:bigint,p:double>>")
    return (
        df.select(*keys, F.explode(parsed["history"]).alias("_h"))
        .select(
            *keys,
            F.timestamp_seconds("_h.t").cast("timestamp_ntz").alias("timestamp"),
            F.col("_h.p").alias("implied_probability"),
        )
    )


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), pages)


def _numbered(parts: Sequence[DataFrame]) -> DataFrame:
    return union_pages([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])


def concat_chunks(chunks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chunks in request order; of rows with the same key the first one stays."""
    return one_of(_numbered(chunks), keys, ["_part"]).drop("_part")


def concat_keep_last(months: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Months in order; of rows with the same key the last one stays."""
    return one_of(_numbered(months), keys, ["_part"], last=True).drop("_part")
