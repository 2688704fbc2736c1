"""Queries for order-book messages: batch twins and bounded runs of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import r6, table
from tickweave.operators.select import tradable as tradable_filter
from tickweave.plans.registry import register
from tickweave.sources.files import scratch_path
from tickweave.streaming import book as K
from tickweave.streaming import messages as G
from tickweave.streaming import monitor as O


def raw_messages(spark, sf):
    """Events as book messages: every 50th opens a snapshot, the rest change one level; every 97th is of another type."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    price = F.greatest(F.round(F.col("value") / 500, 2), F.lit(0.01)).cast("decimal(18,2)").cast("string")
    size = F.get_json_object("props", "$.k")
    buy = F.col("event_type").isin("click", "view", "signup")
    level = lambda p, s: F.struct(p.alias("price"), s.alias("size"))
    asset = (F.col("user_id") % 20).cast("string")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp")
    half = F.greatest(F.round(F.col("value") / 1000, 2), F.lit(0.01)).cast("decimal(18,2)")
    book = F.to_json(F.struct(
        F.lit("book").alias("event_type"), asset.alias("asset_id"), ms, F.array(level(half.cast("string"), F.lit("100"))).alias("bids"),
        F.array(level((half + F.lit(0.05).cast("decimal(18,2)")).cast("string"), F.lit("120"))).alias("asks")))
    change = F.struct(asset.alias("asset_id"), F.when(buy, "BUY").otherwise("sell").alias("side"), price.alias("price"), size.alias("size"))
    update = F.to_json(F.struct(F.lit("price_change").alias("event_type"), ms, F.array(change).alias("price_changes")))
    other = F.to_json(F.struct(F.lit("last_trade_price").alias("event_type"), asset.alias("asset_id")))
    text = F.when(i % 97 == 5, F.lit("{not json")).when(i % 97 == 6, other).when(i % 50 == 0, F.concat(F.lit("["), book, F.lit("]"))).otherwise(update)
    return e.select(i.alias("seq"), text.alias("value"))


MSG = """ev AS (SELECT event_id AS seq, epoch_ms(ts) AS ms, CAST(user_id % 20 AS VARCHAR) AS asset_id, event_id % 50 = 0 AS is_book, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(greatest(round(value / 500, 2), 0.01) AS DECIMAL(18,6)) AS price, CAST(json_extract_string(props, '$.k') AS DECIMAL(18,6)) AS size, CAST(greatest(round(value / 1000, 2), 0.01) AS DECIMAL(18,6)) AS half FROM events WHERE event_id % 97 NOT IN (5, 6)),
upd AS (SELECT seq, ms, asset_id, 0 AS item, 'reset' AS kind, NULL AS side, NULL::DECIMAL(18,6) AS price, NULL::DECIMAL(18,6) AS size FROM ev WHERE is_book
 UNION ALL SELECT seq, ms, asset_id, 1, 'snapshot', 'BUY', half, 100 FROM ev WHERE is_book UNION ALL SELECT seq, ms, asset_id, 2, 'snapshot', 'SELL', half + 0.05, 120 FROM ev WHERE is_book
 UNION ALL SELECT seq, ms, asset_id, 0, 'level', side, price, size FROM ev WHERE NOT is_book)"""
STATE = MSG + """, rs AS (SELECT asset_id, max(seq) AS r FROM upd WHERE kind = 'reset' GROUP BY 1),
lv AS (SELECT asset_id, side, price, arg_max(size, seq * 10 + item) AS size, max(seq) AS seq FROM upd WHERE kind <> 'reset' GROUP BY 1, 2, 3),
alive AS (SELECT lv.* FROM lv LEFT JOIN rs USING (asset_id) WHERE (r IS NULL OR lv.seq >= r) AND size > 0),
top AS (SELECT asset_id, max(price) FILTER (side = 'BUY') AS bb, arg_max(size, price) FILTER (side = 'BUY') AS bs, min(price) FILTER (side = 'SELL') AS ba, arg_min(size, price) FILTER (side = 'SELL') AS sz FROM alive GROUP BY 1),
ft AS (SELECT asset_id, bb::DOUBLE AS best_bid, ba::DOUBLE AS best_ask, bs::DOUBLE AS b, sz::DOUBLE AS a, (ba - bb)::DOUBLE AS spread, (bb + ba)::DOUBLE / 2 AS mid, bs::DOUBLE / (bs + sz)::DOUBLE AS imb, (ba * bs + bb * sz)::DOUBLE / (bs + sz)::DOUBLE AS micro, (bs + sz)::DOUBLE AS depth FROM top WHERE bb IS NOT NULL AND ba IS NOT NULL)"""


def updates(spark, sf):
    return G.route(G.parse_messages(raw_messages(spark, sf)))


def final_features(spark, sf):
    return K.book_features(K.top_of_book(K.book_state_batch(updates(spark, sf))))


def plain(df):
    """Decimals as rounded doubles for comparison."""
    return df.select(*[F.round(F.col(f.name).cast("double"), 6).alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema])


@register("st1_route_messages", f"WITH {MSG} SELECT asset_id, kind, side, count(*) AS n, CAST(sum(size) AS DOUBLE) AS size FROM upd GROUP BY 1, 2, 3")
def route_messages(spark, sf):
    return updates(spark, sf).groupBy("asset_id", "kind", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("double").alias("size"))


@register("st2_book_state", f"WITH {STATE} SELECT asset_id, side, price::DOUBLE AS price, size::DOUBLE AS size FROM alive")
def book_state(spark, sf):
    return plain(K.book_state_batch(updates(spark, sf)))


_FEATURES = "asset_id, best_bid, best_ask, round(spread, 6) AS spread, round(mid, 6) AS mid_price, round(imb, 6) AS imbalance, round(micro, 6) AS microprice, depth"


@register("st3_book_features", f"WITH {STATE} SELECT {_FEATURES} FROM ft")
def book_features(spark, sf):
    return plain(final_features(spark, sf)).select("asset_id", "best_bid", "best_ask", "spread", "mid_price", "imbalance", "microprice", "depth")


@register("st4_pressure_signal", f"WITH {STATE} SELECT asset_id, CASE WHEN micro - mid >= 0.002 AND imb >= 0.65 THEN 'BUY_PRESSURE' WHEN micro - mid <= -0.002 AND imb <= 0.35 THEN 'SELL_PRESSURE' ELSE 'NEUTRAL' END AS signal FROM ft")
def pressure_signal(spark, sf):
    return K.pressure_signal(final_features(spark, sf)).select("asset_id", "signal")


@register("p07_tradable", f"WITH {STATE} SELECT {_FEATURES} FROM ft WHERE spread <= 0.05 AND depth >= 100 AND mid BETWEEN 0.05 AND 0.95")
def tradable(spark, sf):
    return plain(tradable_filter(final_features(spark, sf))).select("asset_id", "best_bid", "best_ask", "spread", "mid_price", "imbalance", "microprice", "depth")


@register("t02_top_lists", f"WITH {STATE}, tr AS (SELECT * FROM ft WHERE spread <= 0.05 AND depth >= 100 AND mid BETWEEN 0.05 AND 0.95) " + " UNION ALL ".join(
    f"SELECT '{name}' AS list, asset_id, place FROM (SELECT asset_id, row_number() OVER (ORDER BY {o}, asset_id) AS place FROM tr) WHERE place <= 5"
    for name, o in (("spread", "spread DESC"), ("buy_imbalance", "imb DESC"), ("sell_imbalance", "imb"), ("depth", "depth DESC"))))
def top_lists(spark, sf):
    return K.top_lists(final_features(spark, sf)).select("list", "asset_id", "place")


def event_signals(spark, sf):
    """Signals straight from events, for the persistence twin."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    signal = F.when(k >= 65, "BUY_PRESSURE").when(k <= 20, "SELL_PRESSURE").otherwise("NEUTRAL")
    return e.select((F.col("user_id") % 20).cast("string").alias("asset_id"), F.col("event_id").alias("seq"), "ts", signal.alias("signal"))


@register("st5_persistence", """WITH s AS (SELECT CAST(user_id % 20 AS VARCHAR) AS asset_id, event_id AS seq, ts, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 65 THEN 'BUY_PRESSURE' WHEN CAST(json_extract_string(props, '$.k') AS INT) <= 20 THEN 'SELL_PRESSURE' ELSE 'NEUTRAL' END AS signal FROM events),
c AS (SELECT *, signal IS DISTINCT FROM lag(signal) OVER w AS is_new FROM s WINDOW w AS (PARTITION BY asset_id ORDER BY seq)), g AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY asset_id ORDER BY seq) AS run FROM c),
r AS (SELECT asset_id, seq, ts, signal, run, row_number() OVER (PARTITION BY asset_id, run ORDER BY seq) AS run_count, first_value(ts) OVER (PARTITION BY asset_id, run ORDER BY seq) AS st FROM g)
SELECT asset_id, seq, signal, run_count, CASE WHEN signal = 'NEUTRAL' AND run = 1 THEN 0 ELSE round((epoch_us(ts) - epoch_us(st)) / 1e6, 3) END::DOUBLE AS age_seconds, signal <> 'NEUTRAL' AND run_count >= 2 AS active FROM r""")
def persistence(spark, sf):
    p = K.persistence_batch(event_signals(spark, sf), order=["seq"])
    return p.select("asset_id", "seq", "signal", "run_count", r6("age_seconds", 3).alias("age_seconds"), "active")


@register("st6_latest_features", "SELECT CAST(user_id % 20 AS VARCHAR) AS asset_id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_features(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("asset_id"), F.col("event_id").alias("seq"), "value")
    return K.latest(e, order=["seq"])


@register("st7_periodic_snapshots", "SELECT (time_bucket(INTERVAL 5 SECOND, ts) + INTERVAL 5 SECOND)::VARCHAR AS snapshot_time, CAST(user_id % 20 AS VARCHAR) AS asset_id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def periodic_snapshots(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("asset_id"), F.col("event_id").alias("seq"), "value", F.col("ts").cast("timestamp").alias("event_time"))
    return K.periodic_snapshots(e, order=["seq"]).select("snapshot_time", "asset_id", "seq", "value")


# --- bounded stream runs ------------------------------------------------------------------


SLICES = 4


def landed_stream(spark, sf):
    """The messages landed as one folder of files after the other, read back as a stream of one micro-batch each."""
    path = scratch_path(spark, "messages")
    raw = raw_messages(spark, sf)
    first, last = raw.agg(F.min("seq"), F.max("seq")).first()
    for t in range(SLICES):
        # one file a slice: the stream reads whole slices in the order of their times
        part = raw.filter(F.floor((F.col("seq") - first) * SLICES / (last - first + 1)) == t)
        part.coalesce(1).write.mode("append").json(path)
    return G.message_stream(spark, path, files_per_trigger=1)


def stream_signals(spark, sf):
    ups = G.route(G.parse_messages(landed_stream(spark, sf)))
    return K.pressure_signal(K.book_features(K.book_state(ups)))


@register("st2_stream_book", f"WITH {STATE} SELECT {_FEATURES} FROM ft")
def stream_book(spark, sf):
    out, mark = scratch_path(spark, "tops"), scratch_path(spark, "mark")
    ups = G.route(G.parse_messages(landed_stream(spark, sf)))
    tops = K.book_state(ups)
    tops.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    features = K.book_features(K.latest(spark.read.schema(K.TOP).parquet(out)))
    return plain(features).select("asset_id", "best_bid", "best_ask", "spread", "mid_price", "imbalance", "microprice", "depth")


@register("s08_snapshot_log")
def snapshot_log(spark, sf):
    out, mark = scratch_path(spark, "log"), scratch_path(spark, "mark")
    O.log_sink(stream_signals(spark, sf), out, mark).awaitTermination()
    log = spark.read.option("header", True).csv(out)
    return log.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


@register("s14_message_stream", f"WITH {MSG} SELECT kind, count(*) AS n FROM upd GROUP BY 1")
def message_stream(spark, sf):
    out, mark = scratch_path(spark, "updates"), scratch_path(spark, "mark")
    ups = G.route(G.parse_messages(landed_stream(spark, sf)))
    ups.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# every 31st message is ten days late, and each is delivered twice; a day is waited for. The watermark that a batch is
# held against is the one its predecessor began with
_LATE = f"""{MSG}, e AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
m AS (SELECT upd.*, ms - CASE WHEN seq % 31 = 0 THEN 864000000 ELSE 0 END AS stamp, floor((seq - lo) * {SLICES} / (hi - lo + 1)) AS t FROM upd, e),
w AS (SELECT t, max(stamp) - 86400000 AS mark FROM m GROUP BY 1)"""


@register("st9_watermarked_updates", f"WITH {_LATE} SELECT kind, count(*) AS n FROM m WHERE stamp > coalesce((SELECT max(mark) FROM w WHERE w.t < m.t - 1), 0) GROUP BY 1")
def watermarked_updates(spark, sf):
    out, mark = scratch_path(spark, "timed"), scratch_path(spark, "mark")
    ups = G.route(G.parse_messages(landed_stream(spark, sf)))
    late = F.when(F.col("seq") % 31 == 0, 864_000_000).otherwise(0)
    ups = ups.withColumn("timestamp_ms", F.col("timestamp_ms") - late).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    timed = G.with_event_time(ups, "1 day")
    timed.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# the tradable assets after each slice of the messages
_TICKS = f"""{MSG}, ends AS (SELECT t, min(event_id) + (t + 1) * (max(event_id) - min(event_id) + 1) / {SLICES} AS e FROM events, range({SLICES}) x(t) GROUP BY t),
rs AS (SELECT t, asset_id, max(seq) AS r FROM upd JOIN ends ON seq < e WHERE kind = 'reset' GROUP BY 1, 2),
lv AS (SELECT t, asset_id, side, price, arg_max(size, seq * 10 + item) AS size, max(seq) AS seq FROM upd JOIN ends ON seq < e WHERE kind <> 'reset' GROUP BY 1, 2, 3, 4),
top AS (SELECT t, asset_id, max(price) FILTER (side = 'BUY') AS bb, arg_max(size, price) FILTER (side = 'BUY') AS bs, min(price) FILTER (side = 'SELL') AS ba, arg_min(size, price) FILTER (side = 'SELL') AS sz
  FROM lv LEFT JOIN rs USING (t, asset_id) WHERE (r IS NULL OR lv.seq >= r) AND size > 0 GROUP BY 1, 2)"""


@register("st7_monitor", f"WITH {_TICKS} SELECT asset_id, count(*) AS n FROM top WHERE (ba - bb) <= 0.05 AND bs + sz >= 100 AND (bb + ba) / 2 BETWEEN 0.05 AND 0.95 GROUP BY 1")
def monitor(spark, sf):
    folder, mark = scratch_path(spark, "monitor"), scratch_path(spark, "mark")
    features = K.book_features(K.book_state(G.route(G.parse_messages(landed_stream(spark, sf)))))
    O.start_monitor(features, folder, mark, interval=None).awaitTermination()
    return spark.read.parquet(f"{folder}/snapshots").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
