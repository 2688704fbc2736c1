"""Queries for sources, sinks, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.catalog.fixtures import (
    BARS, DAILY, MARKETS, PATHS, RAW_BARS, TICKS, bars, daily, markets, paths, r6, raw_bars, table, ticks, universe,
)
from tickweave.functions import scalars as S
from tickweave.operators import bars as B
from tickweave.operators import select as X
from tickweave.plans.registry import register
from tickweave.sources import files, payloads


@register("s01_bar_scan", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def bar_scan(spark, sf):
    df = files.read_bars(spark, f"{sf}/orders.parquet")
    return df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))


@register("s02_pushdown_scan", "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount <= 0.05 GROUP BY 1")
def pushdown_scan(spark, sf):
    where = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_discount") <= 0.05)
    df = files.read_bars(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"], where)
    return df.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@register("s03_pruned_scan", "SELECT c_mktsegment AS segment, round(avg(c_acctbal), 6) AS mean_balance FROM customer GROUP BY 1")
def pruned_scan(spark, sf):
    df = files.read_bars(spark, f"{sf}/customer.parquet", ["c_mktsegment", "c_acctbal"])
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(r6(F.avg("c_acctbal")).alias("mean_balance"))


@register("s04_symbol_folders", f"WITH {BARS} SELECT symbol, count(*) AS n, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1")
def symbol_folders(spark, sf):
    path = files.scratch_path(spark, "bars")
    files.write_bars(bars(spark, sf), path)
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@register("s05_universe_metadata", f"WITH {RAW_BARS} SELECT symbol, arg_min(market_cap, event_id) AS market_cap, arg_min(sector, event_id) AS sector FROM raw_bars GROUP BY 1")
def universe_metadata(spark, sf):
    return files.universe_metadata(raw_bars(spark, sf), fields=("market_cap", "sector"))


@register("s06_typed_csv", """SELECT conv_id, turn, TRY_CAST(role AS DOUBLE) AS role_number, TRY_CAST(CASE WHEN turn % 2 = 0 THEN 'n/a' ELSE CAST(turn AS VARCHAR) END AS DOUBLE) AS odd_turn FROM conversations""")
def typed_csv(spark, sf):
    path = files.scratch_path(spark, "csv")
    source = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("role_number"),
        F.when(F.col("turn") % 2 == 0, "n/a").otherwise(F.col("turn").cast("string")).alias("odd_turn"),
    )
    files.write_table(source, path, "csv")
    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role_number", T.DoubleType()), T.StructField("odd_turn", T.DoubleType()),
    ])
    return files.read_csv_typed(spark, path, schema)


@register("s07_result_export", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def result_export(spark, sf):
    out = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    path = files.scratch_path(spark, "export")
    files.write_table(out, path, "parquet")
    return spark.read.parquet(path)


def _payloads(spark, sf, section="Time Series (60min)", values=None):
    """One JSON payload per symbol and day (24 hourly bars at most)."""
    b = bars(spark, sf)
    values = values or {f"{i}. {c}": F.col(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)}
    cell = F.create_map(*[x for name, c in values.items() for x in (F.lit(name), c.cast("string"))])
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("k"), cell.alias("v"))
    body = b.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    text = F.concat(F.lit(f'{{"Meta Data": {{"1. Information": "bars"}}, "{section}": '), F.to_json("m"), F.lit("}"))
    return body.select("symbol", text.alias("payload"))


@register("s09_ohlcv_payload", f"WITH {BARS} SELECT symbol, ts::VARCHAR AS ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM bars")
def ohlcv_payload(spark, sf):
    return payloads.parse_ohlcv_payload(_payloads(spark, sf), "payload", ["symbol"])


@register("s09_periodic_payloads", f"WITH {BARS} SELECT symbol, ts::VARCHAR AS ts, open, close, open + close AS adjusted_close, CAST(volume AS DOUBLE) AS volume, high - low AS dividend_amount, 1.0::DOUBLE AS split_coefficient FROM bars")
def periodic_payloads(spark, sf):
    """Weekly adjusted payloads, whose section name does not begin with the words of the daily one."""
    values = {"1. open": F.col("open"), "2. high": F.col("high"), "3. low": F.col("low"), "4. close": F.col("close"), "5. adjusted close": F.col("open") + F.col("close"), "6. volume": F.col("volume"), "7. dividend amount": F.col("high") - F.col("low"), "8. split coefficient": F.lit(1.0)}
    p = payloads.parse_ohlcv_payload(_payloads(spark, sf, "Weekly Adjusted Time Series", values), "payload", ["symbol"], payloads.ADJUSTED_FIELDS)
    return p.drop("high", "low")


@register("s09_indicator_payload", f"WITH {BARS} SELECT symbol, ts::VARCHAR AS ts, (high + low) / 2 AS SMA FROM bars")
def indicator_payload(spark, sf):
    made = _payloads(spark, sf, "Technical Analysis: SMA", {"SMA": (F.col("high") + F.col("low")) / 2})
    return payloads.parse_ohlcv_payload(made, "payload", ["symbol"], ("SMA",))


def _history(spark, sf):
    p = paths(spark, sf)
    item = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("p"))
    # a page covers 1,000 event ids, so no list grows with the data
    page = F.floor(F.col("event_id") / 1000).alias("page")
    pages = p.groupBy("market_id", page).agg(F.collect_list(item).alias("history"))
    return pages.select("market_id", "page", F.to_json(F.struct("history")).alias("payload"))


@register("s10_history_payload", f"WITH {PATHS} SELECT market_id, date_trunc('second', ts)::VARCHAR AS timestamp, p AS implied_probability FROM paths")
def history_payload(spark, sf):
    return payloads.parse_history_payload(_history(spark, sf), "payload", ["market_id"])


@register("s11_union_pages", "SELECT kind, count(*) AS n FROM (SELECT 'supplier' AS kind, s_acctbal AS bal FROM supplier UNION ALL SELECT 'customer', c_acctbal FROM customer) GROUP BY 1")
def union_pages(spark, sf):
    a = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("bal"))
    b = table(spark, sf, "customer").select(F.col("c_acctbal").alias("bal"), F.lit("customer").alias("kind"))
    return payloads.union_pages([a, b]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_MONTHLY = """months AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, 0 AS part, round(avg(value), 6) AS p FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2
  UNION ALL
  SELECT event_type, date_trunc('hour', ts), 1, round(max(value), 6) FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2)"""


def _chunks(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    keys = [F.col("event_type").alias("symbol"), "hour"]
    a = e.filter(F.col("ts") < day("2024-01-20")).groupBy(*keys).agg(r6(F.avg("value")).alias("p"))
    b = e.filter(F.col("ts") >= day("2024-01-10")).groupBy(*keys).agg(r6(F.max("value")).alias("p"))
    return [a, b]


@register("s12_concat_chunks", f"WITH {_MONTHLY} SELECT symbol, hour::VARCHAR AS hour, arg_min(p, part) AS p FROM months GROUP BY 1, 2")
def concat_chunks(spark, sf):
    return payloads.concat_chunks(_chunks(spark, sf), ["symbol", "hour"])


@register("s13_concat_keep_last", f"WITH {_MONTHLY} SELECT symbol, hour::VARCHAR AS hour, arg_max(p, part) AS p FROM months GROUP BY 1, 2")
def concat_keep_last(spark, sf):
    return payloads.concat_keep_last(_chunks(spark, sf), ["symbol", "hour"])


# --- filters and projections ---------------------------------------------------------


@register("p01_session_filter", f"WITH {TICKS} SELECT symbol, count(*) AS n, substr(CAST(min(CAST(ts AS TIME)) AS VARCHAR), 1, 8) AS first_time FROM ticks WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' GROUP BY 1")
def session_filter(spark, sf):
    return X.session_filter(ticks(spark, sf)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.date_format("ts", "HH:mm:ss")).alias("first_time"))


@register("p02_date_range", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1")
def date_range(spark, sf):
    return X.date_range(ticks(spark, sf), "2024-01-05", "2024-01-12").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@register("p03_exclude_periods", f"""WITH {TICKS} SELECT symbol, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM ticks
 WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' AND symbol IN ('click', 'view'))
   AND NOT (ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-16' AND symbol = 'error') GROUP BY 1, 2""")
def exclude_periods(spark, sf):
    periods = spark.sql(
        "SELECT * FROM VALUES (DATE '2024-01-03', DATE '2024-01-09', array('click', 'view')), "
        "(DATE '2024-01-15', DATE '2024-01-16', array('error')) AS t(start, end, symbols)")
    kept = X.exclude_periods(ticks(spark, sf), periods)
    return kept.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = ("small", "large", "ring", "bolt", "steel")


@register("p04_keyword_filter", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE regexp_matches(lower(concat_ws(' ', coalesce(p_name, ''), coalesce(p_type, ''))), 'small|large|ring|bolt|steel') GROUP BY 1")
def keyword_filter(spark, sf):
    kept = X.keyword_filter(table(spark, sf, "part"), ["p_name", "p_type", "p_comment"], _WORDS)
    return kept.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@register("p05_in_list", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P') GROUP BY 1")
def in_list(spark, sf):
    o = table(spark, sf, "orders")
    kept = o.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & ~F.col("o_orderstatus").isin("P"))
    return kept.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("p06_drop_nulls", "SELECT coalesce(l.quality, -1) AS quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1")
def drop_nulls(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return X.drop_nulls(d, ["quality"]).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@register("p08_min_observations", f"WITH {MARKETS} SELECT market_id, n_observations FROM markets WHERE n_observations >= 60")
def min_observations(spark, sf):
    return markets(spark, sf).filter(F.col("n_observations") >= 60).select("market_id", "n_observations")


@register("p09_price_floor", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE NOT (price <= 10) GROUP BY 1")
def price_floor(spark, sf):
    return ticks(spark, sf).filter(~(F.col("price") <= 10)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@register("p10_project_existing", "SELECT s_suppkey, s_acctbal FROM supplier")
def project_existing(spark, sf):
    return X.project_existing(table(spark, sf, "supplier"), ["s_suppkey", "s_missing", "s_acctbal"])


@register("p11_coerce", "SELECT TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS word, count(*) AS n FROM orders GROUP BY 1, 2")
def coerce(spark, sf):
    o = table(spark, sf, "orders")
    parts = F.split("o_orderpriority", "-")
    raw = o.select(parts[0].alias("level"), F.get(parts, 1).alias("word"))
    schema = T.StructType([T.StructField("level", T.DoubleType()), T.StructField("word", T.DoubleType())])
    return files.coerce(raw, schema).groupBy("level", "word").agg(F.count(F.lit(1)).alias("n"))


@register("p12_override", f"WITH {DAILY} SELECT symbol, market_cap, CASE symbol WHEN 'NATION_1' THEN 'FIXED' WHEN 'NATION_7' THEN 'FIXED_TOO' ELSE sector END AS sector FROM universe")
def override(spark, sf):
    return X.override(universe(spark, sf), "symbol", "sector", {"NATION_1": "FIXED", "NATION_7": "FIXED_TOO"})


@register("p13_tag", "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'money' WHEN 'click' THEN 'traffic' END AS tag, count(*) AS n FROM events GROUP BY 1, 2")
def tag(spark, sf):
    e = X.tag(table(spark, sf, "events"), "event_type", {"purchase": "money", "click": "traffic"}, "tag")
    return e.groupBy("event_type", "tag").agg(F.count(F.lit(1)).alias("n"))


@register("p14_case_label", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1")
def case_label(spark, sf):
    b = F.col("c_acctbal")
    band = S.label([(b < 0, "debt"), (b < 5000, "low")], "high").alias("band")
    return table(spark, sf, "customer").groupBy(band).agg(F.count(F.lit(1)).alias("n"))


@register("p15_validity_flags", """WITH q AS (SELECT l_discount AS best_bid, l_tax AS best_ask FROM lineitem)
SELECT (best_ask - best_bid > 0) AS is_valid, (best_bid >= best_ask) AS is_crossed, best_bid BETWEEN 0.02 AND 0.08 AS in_bounds, count(*) AS n FROM q GROUP BY 1, 2, 3""")
def validity_flags(spark, sf):
    q = table(spark, sf, "lineitem").select(F.col("l_discount").alias("best_bid"), F.col("l_tax").alias("best_ask"))
    flagged = X.in_bounds(X.book_flags(q), "best_bid", 0.02, 0.08)
    return flagged.groupBy("is_valid", "is_crossed", "in_bounds").agg(F.count(F.lit(1)).alias("n"))


@register("p16_trailing_range", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE ts >= (SELECT max(ts) FROM ticks) - INTERVAL 7 DAY GROUP BY 1")
def trailing_range(spark, sf):
    return X.trailing(ticks(spark, sf), "ts", "7 DAY").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@register("p16_trailing_rows", f"WITH {TICKS} SELECT event_id, symbol, price FROM ticks ORDER BY ts DESC, event_id DESC LIMIT 20")
def trailing_rows(spark, sf):
    return X.trailing_rows(ticks(spark, sf), ["ts", "event_id"], 20).select("event_id", "symbol", "price")


# --- scalar families -------------------------------------------------------------------


@register("f01_string_functions", """SELECT n_name || '_' || r_name AS joined, lower(n_name) AS low, contains(lower(n_name), 'nation_1') AS hit,
 replace(n_name, '_', ' @ ') AS replaced, CASE WHEN n_name < r_name THEN n_name || '_' || r_name ELSE r_name || '_' || n_name END AS pair, split_part(trim(n_name), '_', 2) AS part
 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def string_functions(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat_ws("_", "n_name", "r_name").alias("joined"), F.lower("n_name").alias("low"),
        F.contains(F.lower("n_name"), F.lit("nation_1")).alias("hit"), F.replace("n_name", F.lit("_"), F.lit(" @ ")).alias("replaced"),
        S.pair_key("n_name", "r_name").alias("pair"), F.split(F.trim("n_name"), "_")[1].alias("part"))


@register("f02_placeholder_audit", """WITH t AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '--' WHEN doc_id % 7 = 0 THEN '.' WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS lang, source FROM documents)
SELECT 'lang' AS "column", sum(CAST(lang IS NULL AS INT))::BIGINT AS n_null, sum(CAST(coalesce(trim(lang) = '', false) AS INT))::BIGINT AS n_blank, sum(CAST(coalesce(trim(lang) = '--', false) AS INT))::BIGINT AS n_dashes, sum(CAST(coalesce(trim(lang) = '.', false) AS INT))::BIGINT AS n_dot FROM t
UNION ALL SELECT 'source', sum(CAST(source IS NULL AS INT))::BIGINT, sum(CAST(coalesce(trim(source) = '', false) AS INT))::BIGINT, sum(CAST(coalesce(trim(source) = '--', false) AS INT))::BIGINT, sum(CAST(coalesce(trim(source) = '.', false) AS INT))::BIGINT FROM t""")
def placeholder_audit(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        F.when(i % 5 == 0, "--").when(i % 7 == 0, ".").when(i % 11 == 0, " ").when(i % 13 == 0, None).otherwise(F.col("lang")).alias("lang"), "source")
    return X.placeholder_audit(d, ["lang", "source"])


@register("f03_calendar_fields", """SELECT CAST(ts AS DATE)::VARCHAR AS day, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS minute_of_day, extract(month FROM ts) AS month,
 extract(isodow FROM ts) - 1 AS weekday, extract(year FROM ts) AS year, CAST(date_trunc('month', ts) AS DATE)::VARCHAR AS month_start, count(*) AS n FROM events GROUP BY ALL""")
def calendar_fields(spark, sf):
    fields = [c.alias(k) for k, c in S.calendar_fields("ts").items()]
    return table(spark, sf, "events").groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))


@register("f04_math_functions", """SELECT event_id, round(ln(CASE WHEN value > 0 THEN value END), 6) AS log, round(ln(1 + value), 6) AS log1p, round(sqrt(value), 6) AS root, round(exp(-value / 100), 6) AS decay, sign(value - 50)::DOUBLE AS sgn,
 round(sinh(value / 500), 6) AS sinh, ceil(value)::BIGINT AS up, floor(value)::BIGINT AS down, greatest(5, least(100, value)) AS clipped, round(least(value / (1 + value), 1 - value / (1 + value)), 6) AS boundary FROM events""")
def math_functions(spark, sf):
    """Scalar functions of the value; the logarithm of a value that is not positive is NULL."""
    v = F.col("value")
    p = v / (1 + v)
    return table(spark, sf, "events").select(
        "event_id", r6(F.ln(v)).alias("log"), r6(F.log1p(v)).alias("log1p"), r6(F.sqrt(v)).alias("root"), r6(F.exp(-v / 100)).alias("decay"),
        F.signum(v - 50).alias("sgn"), r6(F.sinh(v / 500)).alias("sinh"), F.ceil(v).cast("bigint").alias("up"), F.floor(v).cast("bigint").alias("down"),
        S.clip(v, 5.0, 100.0).alias("clipped"), r6(F.least(p, 1 - p)).alias("boundary"))


@register("f05_yes_token", """SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'y' || CAST(event_id AS VARCHAR) ELSE 'a' || CAST(event_id AS VARCHAR) END AS token FROM events""")
def yes_token(spark, sf):
    i, t = F.col("event_id"), F.col("event_id").cast("string")
    e = table(spark, sf, "events").select(
        "user_id", "event_id",
        F.when(i % 4 == 0, "not a list").when(i % 2 == 0, '["No", " YES "]').otherwise('["Up", "Down"]').alias("outcomes"),
        F.when(i % 4 == 0, "[").when(i % 2 == 0, F.concat(F.lit('["n'), t, F.lit('", "y'), t, F.lit('"]')))
        .otherwise(F.concat(F.lit('["a'), t, F.lit('", "b'), t, F.lit('"]'))).alias("tokens"))
    return e.select("user_id", "event_id", S.yes_token("outcomes", "tokens").alias("token"))


@register("f06_binary_outcome", """SELECT event_type, CASE WHEN event_id % 10 = 0 THEN NULL WHEN value / (1 + value) >= 0.99 THEN 1 WHEN value / (1 + value) <= 0.01 THEN 0 END::DOUBLE AS outcome, count(*) AS n FROM events GROUP BY 1, 2""")
def binary_outcome(spark, sf):
    p = (F.col("value") / (1 + F.col("value"))).cast("string")
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('["'), p, F.lit('"]'))).otherwise(F.concat(F.lit('["'), p, F.lit('", "0"]')))
    e = table(spark, sf, "events").select("event_type", S.binary_outcome(text).cast("double").alias("outcome"))
    return e.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))


@register("f07_json_fields", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS DECIMAL(18,6))) AS DOUBLE) AS k FROM events GROUP BY 1")
def json_fields(spark, sf):
    k = F.from_json("props", "k string")["k"].cast("decimal(18,6)")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).cast("double").alias("k"))


@register("f08_not_finite", """SELECT event_type, count(CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END) AS n_finite, sum(CASE WHEN event_id % 9 <> 0 AND event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_inf,
 round(sum(CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 THEN -1 ELSE value END), 4) AS filled FROM events GROUP BY 1""")
def not_finite(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 9 == 0, F.lit(float("nan"))).when(i % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("event_type", raw.alias("x"), raw.alias("y"))
    e = e.withColumn("is_inf", (F.col("x") == F.lit(float("inf"))).cast("bigint"))
    e = X.fill_not_finite(X.fill_not_finite(e, ["x"]), ["y"], -1.0)
    return e.groupBy("event_type").agg(F.count("x").alias("n_finite"), F.sum("is_inf").alias("n_inf"), r6(F.sum("y"), 4).alias("filled"))


@register("f09_durations", f"""WITH {MARKETS}, span AS (SELECT market_id, min(ts) AS a, max(ts) AS b, arg_min(p, event_id) AS first_p FROM paths GROUP BY 1)
SELECT market_id, date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) AS days, round(outcome - final_probability, 6) AS surprise, round(abs(final_probability - first_p), 6) AS abs_change FROM markets JOIN span USING (market_id)""")
def durations(spark, sf):
    span = paths(spark, sf).groupBy("market_id").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("p", F.struct("ts", "event_id")).alias("first_p"))
    m = markets(spark, sf).join(span, "market_id")
    return m.select(
        "market_id", F.datediff(F.to_date("b"), F.to_date("a")).cast("bigint").alias("days"),
        r6(F.col("outcome") - F.col("final_probability")).alias("surprise"), r6(F.abs(F.col("final_probability") - F.col("first_p"))).alias("abs_change"))
