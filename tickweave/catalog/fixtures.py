"""Market-shaped views of the given tables, in Spark and as SQL text for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.bars import bars_from_ticks


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def ticks(spark, sf) -> DataFrame:
    """Trades: symbol = event type, price = value, quantity = props.k."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("qty"),
    )


TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty FROM events)"""


def bars(spark, sf) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf))


BARS = TICKS + """, bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts,
         arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, event_id) AS close,
         sum(price * qty) / nullif(sum(qty), 0) AS vwap,
         CAST(sum(qty) AS BIGINT) AS volume, count(*) AS transactions
  FROM ticks GROUP BY 1, 2)"""


def raw_bars(spark, sf) -> DataFrame:
    """Tick-sized bars that still need resampling, with metadata columns."""
    t = ticks(spark, sf)
    p = F.col("price")
    return t.select(
        "symbol", "ts", "event_id",
        p.alias("open"), (p + 1).alias("high"), (p - 1).alias("low"), p.alias("close"), p.alias("vwap"),
        F.col("qty").alias("volume"), F.lit(1).cast("bigint").alias("transactions"),
        (p * 100).alias("market_cap"), F.concat(F.lit("sector_"), F.col("qty").cast("string")).alias("sector"),
    )


RAW_BARS = TICKS + """, raw_bars AS (
  SELECT symbol, ts, event_id, price AS open, price + 1 AS high, price - 1 AS low, price AS close, price AS vwap,
         qty AS volume, CAST(1 AS BIGINT) AS transactions, price * 100 AS market_cap,
         'sector_' || CAST(qty AS VARCHAR) AS sector FROM ticks)"""


def daily(spark, sf) -> DataFrame:
    """Daily price per nation of the supplier: symbol, sector (region), day, close, volume."""
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity"
    )
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    by_nation = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy("s_nationkey", "day")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("_v"), F.sum("l_quantity").alias("volume"))
    )
    names = nation_names(spark, sf)
    return by_nation.join(names, by_nation.s_nationkey == names.n_nationkey).select(
        "symbol", "sector", "day", F.col("day").cast("timestamp_ntz").alias("ts"), (F.col("_v") / F.col("volume")).alias("close"), "volume"
    )


def nation_names(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


def universe(spark, sf) -> DataFrame:
    """One row per nation that has suppliers: market cap = their summed balance."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("market_cap"))
    n = nation_names(spark, sf)
    return s.join(n, s.s_nationkey == n.n_nationkey).select("symbol", "market_cap", "sector")


DAILY = """names AS (
  SELECT n_nationkey, n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey),
daily AS (
  SELECT symbol, sector, CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN names ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4),
universe AS (
  SELECT symbol, round(sum(s_acctbal), 2) AS market_cap, sector
  FROM supplier JOIN names ON s_nationkey = n_nationkey GROUP BY symbol, sector)"""


def paths(spark, sf) -> DataFrame:
    """Probability paths: one market per user."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("market_id"), "ts", "event_id", (F.col("value") / (1 + F.col("value"))).alias("p"), "event_type")


PATHS = """paths AS (
  SELECT user_id AS market_id, ts, event_id, value / (1 + value) AS p, event_type FROM events)"""


def markets(spark, sf) -> DataFrame:
    """Market-level table: final probability and outcome by the last event."""
    p = paths(spark, sf)
    at = F.struct("ts", "event_id")
    return (
        p.groupBy("market_id")
        .agg(
            F.max_by("p", at).alias("final_probability"),
            F.avg("p").alias("mean_probability"),
            F.max_by("event_type", at).alias("_last"),
            F.count(F.lit(1)).alias("n_observations"),
        )
        .withColumn("outcome", F.col("_last").isin("purchase", "signup").cast("int"))
        .drop("_last")
    )


MARKETS = PATHS + """, markets AS (
  SELECT market_id, arg_max(p, event_id) AS final_probability, avg(p) AS mean_probability, count(*) AS n_observations,
         CAST(arg_max(event_type, event_id) IN ('purchase', 'signup') AS INTEGER) AS outcome
  FROM paths GROUP BY market_id)"""


def panel(spark, sf) -> DataFrame:
    """Return panel: 53 returns in bps with NULLs every 11th cell, class label."""
    e = table(spark, sf, "embeddings")
    cells = F.transform(
        F.slice("embedding", 1, 53),
        lambda x, i: F.when((F.col("vec_id") + i) % 11 != 0, F.round(x.cast("double") * 100, 4)),
    )
    return e.select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") % 25).alias("day"),
        F.floor(F.col("vec_id") / 25).cast("bigint").alias("equity"),
        cells.alias("r"),
        (F.col("label") % 3 - 1).alias("reod"),
    )


PANEL = """panel AS (
  SELECT vec_id AS id, vec_id % 25 AS day, CAST(floor(vec_id / 25) AS BIGINT) AS equity, label % 3 - 1 AS reod,
         [CASE WHEN (vec_id + i - 1) % 11 <> 0 THEN round(CAST(embedding[i] AS DOUBLE) * 100, 4) END for i in range(1, 54)] AS r
  FROM embeddings),
cells AS (SELECT id, day, equity, reod, i, r[i + 1] AS x FROM panel, (SELECT unnest(range(53)) AS i))"""
