"""Queries for joins, aggregates, ordering, sets and shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import (
    BARS, DAILY, MARKETS, PANEL, PATHS, TICKS, bars, daily, markets, panel, paths, r6, table, ticks, universe,
)
from tickweave.operators import aggregates as A
from tickweave.operators import bars as B
from tickweave.operators import joins as J
from tickweave.operators import leadlag as L
from tickweave.operators import select as X
from tickweave.operators import series as R
from tickweave.plans.registry import register
from tickweave.plans.series import index_rows

CANDIDATES = DAILY + """, candidates AS (
  SELECT a.symbol AS stock_a, b.symbol AS stock_b, a.sector FROM universe a JOIN universe b ON a.sector = b.sector AND a.symbol < b.symbol)"""
RETS = CANDIDATES + """, rets AS (
  SELECT symbol, ts, day, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM daily),
aligned AS (
  SELECT stock_a, stock_b, a.ts, a.day, a.ret AS x_a, b.ret AS x_b FROM candidates
  JOIN rets a ON a.symbol = stock_a JOIN rets b ON b.symbol = stock_b AND b.ts = a.ts WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"""


def candidates(spark, sf):
    return J.candidate_pairs(universe(spark, sf))


def daily_returns(spark, sf):
    """Log returns of daily prices: one row per nation and day, so plain windows."""
    return R.returns(daily(spark, sf), "log", bounded=True)


def aligned(spark, sf):
    rets = daily_returns(spark, sf).filter(F.col("ret").isNotNull())
    return J.align_pairs(rets, candidates(spark, sf), value="ret")


@register("j01_align_pairs", f"WITH {RETS} SELECT stock_a, stock_b, count(*) AS n, round(sum(x_a * x_b), 6) AS dot FROM aligned GROUP BY 1, 2")
def align_pairs(spark, sf):
    return aligned(spark, sf).groupBy("stock_a", "stock_b").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("x_a") * F.col("x_b"))).alias("dot"))


def _per_customer(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), r6(F.sum("o_totalprice"), 2).alias("spent"))


_CUST = "c AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)"


@register("j02_join_one_to_one", f"WITH {_CUST} SELECT c_custkey, c_mktsegment, n_orders, spent FROM customer JOIN c USING (c_custkey)")
def join_one_to_one(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return J.join_1to1(c, _per_customer(spark, sf), ["c_custkey"])


@register("j03_left_join_one_to_one", f"WITH {_CUST} SELECT c_custkey, c_mktsegment, n_orders::DOUBLE AS n_orders, spent FROM customer LEFT JOIN c USING (c_custkey)")
def left_join_one_to_one(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return J.join_1to1(c, _per_customer(spark, sf), ["c_custkey"], "left").withColumn("n_orders", F.col("n_orders").cast("double"))


@register("j04_composite_left_join", """WITH a AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1, 2) SELECT a.s, a.y, n, returned FROM a LEFT JOIN b ON a.s = b.s AND a.y = b.y""")
def composite_left_join(spark, sf):
    line = table(spark, sf, "lineitem")
    keys = [F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y")]
    a = line.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    b = line.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).groupBy(*keys).agg(F.sum("l_quantity").alias("returned"))
    return a.join(b, ["s", "y"], "left")


@register("j05_candidate_pairs", f"WITH {CANDIDATES} SELECT stock_a, stock_b, sector FROM candidates")
def candidate_pairs(spark, sf):
    return candidates(spark, sf)


@register("j06_assign_roles", f"""WITH {CANDIDATES} SELECT stock_a, stock_b, c.sector, CASE WHEN a.market_cap >= b.market_cap THEN stock_a ELSE stock_b END AS leader,
 CASE WHEN a.market_cap >= b.market_cap THEN stock_b ELSE stock_a END AS follower FROM candidates c JOIN universe a ON a.symbol = stock_a JOIN universe b ON b.symbol = stock_b""")
def assign_roles(spark, sf):
    return J.assign_roles(candidates(spark, sf), universe(spark, sf))


@register("j07_flag_member", "SELECT o_orderstatus AS status, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AS is_member, count(*) AS n FROM orders GROUP BY 1, 2")
def flag_member(spark, sf):
    rich = table(spark, sf, "customer").filter(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("o_custkey"))
    o = J.flag_member(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), rich, ["o_custkey"])
    return o.groupBy(F.col("o_orderstatus").alias("status"), "is_member").agg(F.count(F.lit(1)).alias("n"))


@register("j08_shift_to_next_day", f"""WITH {DAILY}, d AS (SELECT day, lead(day) OVER (ORDER BY day) AS trading_day FROM (SELECT DISTINCT day FROM daily))
SELECT symbol, day::VARCHAR AS day, trading_day::VARCHAR AS trading_day, close FROM daily JOIN d USING (day) WHERE trading_day IS NOT NULL""")
def shift_to_next_day(spark, sf):
    return J.shift_to_next_day(daily(spark, sf).select("symbol", "day", "close"))


@register("j09_align_benchmark", f"""WITH {DAILY}, m AS (SELECT day, round(avg(close), 6) AS mean_close FROM daily GROUP BY 1), o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT day::VARCHAR AS day, mean_close, n FROM m JOIN o USING (day)""")
def align_benchmark(spark, sf):
    m = daily(spark, sf).groupBy("day").agg(r6(F.avg("close")).alias("mean_close"))
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return J.align_benchmark(m, o)


@register("j10_minute_profile", f"WITH {TICKS} SELECT event_id, round(price - avg(price) OVER (PARTITION BY hour(ts) * 60 + minute(ts)), 6) AS excess FROM ticks")
def minute_profile(spark, sf):
    p = R.minute_profile(ticks(spark, sf), "price")
    return p.select("event_id", r6(F.col("price") - F.col("profile")).alias("excess"))


@register("j12_sweep", "SELECT tau::DOUBLE AS tau, count(*) AS n FROM customer, (SELECT unnest([0, 1000, 2500.5, 5000]) AS tau) WHERE c_acctbal > tau GROUP BY 1")
def sweep(spark, sf):
    c = J.sweep(table(spark, sf, "customer"), {"tau": [0, 1000, 2500.5, 5000]})
    return c.filter(F.col("c_acctbal") > F.col("tau")).groupBy("tau").agg(F.count(F.lit(1)).alias("n"))


@register("j13_attach_results", "SELECT p_partkey, coalesce(m, p_retailprice) AS p_retailprice FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS m FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_partkey = p_partkey")
def attach_results(spark, sf):
    best = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 49).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("p_retailprice"))
    return J.attach_results(table(spark, sf, "part").select("p_partkey", "p_retailprice"), best, ["p_partkey"], ["p_retailprice"])


LEADS = RETS + """, moved AS (
  SELECT *, lead(x_b) OVER w AS y1, lead(x_a) OVER w AS x1 FROM aligned WINDOW w AS (PARTITION BY stock_a, stock_b ORDER BY ts)),
tests AS (SELECT stock_a, stock_b, corr(x_a, y1) - corr(x_b, x1) AS lead_score FROM moved GROUP BY 1, 2)"""


@register("j14_empirical_pairs", f"""WITH {LEADS} SELECT stock_a || '_' || stock_b AS pair, stock_a, stock_b, CASE WHEN lead_score > 0 THEN stock_a ELSE stock_b END AS leader,
 CASE WHEN lead_score > 0 THEN stock_b ELSE stock_a END AS follower FROM tests WHERE 1 / (1 + 100 * abs(lead_score)) < 0.4""")
def empirical_pairs(spark, sf):
    tests = L.lead_lag(aligned(spark, sf), [1], bounded=True)
    tests = tests.withColumn("p_value", 1 / (1 + 100 * F.abs("lead_score")))
    twice = tests.unionByName(tests.withColumn("p_value", F.lit(0.39999) + F.col("p_value")))
    return J.empirical_pairs(twice, "leader", 0.4).drop("p_value")


# --- aggregates ---------------------------------------------------------------------


@register("a01_trajectory_summary", f"""WITH {PATHS} SELECT market_id, min(ts)::VARCHAR AS start_date, max(ts)::VARCHAR AS last_observed_date, count(p) AS n_observations, arg_min(p, event_id) AS first_probability, arg_max(p, event_id) AS final_probability,
 round(avg(p), 6) AS mean_probability, min(p) AS min_probability, max(p) AS max_probability, round(stddev_samp(p), 6) AS probability_volatility, round(median(p), 6) AS median_probability FROM paths GROUP BY 1""")
def trajectory_summary(spark, sf):
    s = A.trajectory_summary(paths(spark, sf), ["market_id"], ["ts", "event_id"])
    return s.withColumns({c: r6(c) for c in ("mean_probability", "probability_volatility", "median_probability")})


@register("a02_value_share", "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def value_share(spark, sf):
    return A.value_share(table(spark, sf, "orders"), "o_orderpriority").withColumn("share", r6("share"))


@register("a03_class_share", f"WITH {PANEL} SELECT day, round(avg((reod = -1)::INT), 6) AS share_m1, round(avg((reod = 0)::INT), 6) AS share_0, round(avg((reod = 1)::INT), 6) AS share_1 FROM panel GROUP BY 1")
def class_share(spark, sf):
    s = A.class_share_by(panel(spark, sf), "day", "reod", [-1, 0, 1])
    return s.select("day", *[r6(c).alias(c) for c in s.columns[1:]])


@register("a04_crosstab", "SELECT l_returnflag, round(count(*) FILTER (l_linestatus = 'O') / count(*), 6) AS p_O, round(count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS p_F FROM lineitem GROUP BY 1")
def crosstab(spark, sf):
    s = A.crosstab_norm(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])
    return s.select("l_returnflag", r6("p_O").alias("p_O"), r6("p_F").alias("p_F"))


@register("a05_coverage", f"WITH {TICKS} SELECT symbol, count(*) AS n_rows, count(DISTINCT CAST(ts AS DATE)) AS n_days, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM ticks GROUP BY 1")
def coverage(spark, sf):
    return B.coverage(ticks(spark, sf))


@register("a06_quantiles", """SELECT l_returnflag, 'l_extendedprice' AS "column", unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q, unnest(list_transform(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]), lambda x: round(x, 4))) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_discount', unnest([0.05, 0.25, 0.5, 0.75, 0.95]), unnest(list_transform(quantile_cont(l_discount, [0.05, 0.25, 0.5, 0.75, 0.95]), lambda x: round(x, 4))) FROM lineitem GROUP BY 1""")
def quantiles(spark, sf):
    from tickweave.plans.order_stats import quantiles as exact

    out = exact(table(spark, sf, "lineitem"), ["l_extendedprice", "l_discount"], [0.05, 0.25, 0.5, 0.75, 0.95], ["l_returnflag"])
    return out.withColumn("value", r6("value", 4))


@register("a07_describe", """SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
 """ + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS p{round(q * 1000):03d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM orders")
def describe(spark, sf):
    d = A.describe_ext(table(spark, sf, "orders"), "o_totalprice")
    return d.select("count", "min", "max", *[r6(c, 4).alias(c) for c in d.columns if c not in ("count", "min", "max")])


@register("a08_majority", f"WITH {PANEL}, c AS (SELECT reod, count(*) AS n FROM panel GROUP BY 1) SELECT arg_max(reod, n * 10 - reod) AS majority_class, round(max(n) / sum(n), 6) AS baseline_accuracy FROM c")
def majority(spark, sf):
    return A.majority_baseline(panel(spark, sf), "reod").withColumn("baseline_accuracy", r6("baseline_accuracy"))


@register("a09_conditional_share", f"WITH {PANEL} SELECT equity, round(avg((reod = 1)::INT), 6) AS up, round(avg((reod <> 0)::INT), 6) AS moved FROM panel GROUP BY 1")
def conditional_share(spark, sf):
    s = A.cond_share(panel(spark, sf), ["equity"], {"up": F.col("reod") == 1, "moved": F.col("reod") != 0})
    return s.select("equity", r6("up").alias("up"), r6("moved").alias("moved"))


@register("a10_market_state", f"""WITH {PANEL}, s AS (SELECT id, day, equity, coalesce(sum(x), 0) AS path, sqrt(coalesce(sum(x * x), 0)) AS vol FROM cells GROUP BY 1, 2, 3)
SELECT day, round(avg((path > 0)::INT), 6) AS breadth, count(DISTINCT equity) AS n_entities, round(median(path), 4) AS median_return, round(median(vol), 4) AS median_vol FROM s GROUP BY 1""")
def market_state(spark, sf):
    from tickweave.functions.panel import path_features

    p = path_features(panel(spark, sf), "r").select("day", "equity", "path_return_bps", "realized_vol_bps")
    s = A.market_state(p, "day", "path_return_bps", "realized_vol_bps", "equity")
    return s.withColumns({"breadth": r6("breadth"), "median_return": r6("median_return", 4), "median_vol": r6("median_vol", 4)})


@register("a11_sector_pairs", f"WITH {DAILY} SELECT sector, count(*) AS n_symbols, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs FROM universe GROUP BY 1")
def sector_pairs(spark, sf):
    return A.sector_pair_counts(universe(spark, sf))


@register("a12_group_summary", "SELECT n_name AS name, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def group_summary(spark, sf):
    per = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("c_acctbal"), 2).alias("total"), r6(F.avg("c_acctbal")).alias("mean"))
    n = table(spark, sf, "nation")
    return per.join(n, per.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("name"), "n", "total", "mean")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]


@register("a13_pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM lineitem" for a, b in _PAIRS))
def pearson_matrix(spark, sf):
    return A.corr_matrix(table(spark, sf, "lineitem"), _NUM).withColumn("value", r6("value"))


@register("a13_spearman_matrix", "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM r" for a, b in _PAIRS))
def spearman_matrix(spark, sf):
    return A.corr_matrix(table(spark, sf, "lineitem"), _NUM, "spearman").withColumn("value", r6("value"))


@register("a14_moments", f"""WITH {TICKS}, m AS (SELECT symbol, avg(price) AS mu FROM ticks GROUP BY 1), c AS (SELECT symbol, avg(pow(price - mu, 2)) AS m2, avg(pow(price - mu, 3)) AS m3, avg(pow(price - mu, 4)) AS m4 FROM ticks JOIN m USING (symbol) GROUP BY 1)
SELECT symbol, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM c""")
def moments(spark, sf):
    m = A.moments(ticks(spark, sf), "price", ["symbol"])
    return m.select("symbol", r6("skewness").alias("skewness"), r6("kurtosis").alias("kurtosis"))


@register("a15_last_per_day", f"WITH {TICKS} SELECT symbol, CAST(ts AS DATE)::VARCHAR AS day, arg_max(price, event_id) AS price FROM ticks GROUP BY 1, 2")
def last_per_day(spark, sf):
    return B.last_per_day(ticks(spark, sf), ["symbol"], "price")


_HISTORY = """history AS (SELECT event_type AS policy, CAST(ts AS DATE) AS test_day, event_id AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS shares_traded, value AS cumulative_cost, 100000 - event_id AS inventory_remaining, value / 1000 AS participation_rate FROM events)"""


def _history(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("policy"), F.to_date("ts").alias("test_day"), F.col("event_id").alias("t"),
        F.get_json_object("props", "$.k").cast("double").alias("shares_traded"), F.col("value").alias("cumulative_cost"),
        (100000 - F.col("event_id")).alias("inventory_remaining"), (F.col("value") / 1000).alias("participation_rate"))


@register("a16_execution_summary", f"""WITH {_HISTORY} SELECT test_day::VARCHAR AS test_day, policy, arg_max(cumulative_cost, t) AS cumulative_cost, sum(shares_traded) AS total_shares_traded, arg_max(inventory_remaining, t) AS final_inventory,
 round(avg(participation_rate), 6) AS avg_participation, max(participation_rate) AS max_participation, count(*) AS num_steps FROM history GROUP BY 1, 2""")
def execution_summary(spark, sf):
    return A.execution_summary(_history(spark, sf), ["test_day", "policy"]).withColumn("avg_participation", r6("avg_participation"))


@register("a17_mean_by_step", f"WITH {_HISTORY} SELECT policy, t % 390 AS step, round(avg(shares_traded), 6) AS shares_traded, round(avg(participation_rate), 9) AS participation_rate FROM history GROUP BY 1, 2")
def mean_by_step(spark, sf):
    h = _history(spark, sf).withColumn("step", F.col("t") % 390)
    m = A.mean_by_step(h, ["policy", "step"], ["shares_traded", "participation_rate"])
    return m.withColumns({"shares_traded": r6("shares_traded"), "participation_rate": r6("participation_rate", 9)})


@register("a18_gap_histogram", f"WITH {TICKS}, g AS (SELECT epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS gap_seconds FROM ticks) SELECT gap_seconds, count(*) AS n FROM g WHERE gap_seconds IS NOT NULL GROUP BY 1")
def gap_histogram(spark, sf):
    return B.gap_histogram(ticks(spark, sf), order=["ts", "event_id"])


@register("a19_trend", f"WITH {PATHS}, i AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts, event_id) - 1 AS pos FROM paths) SELECT market_id, round(regr_slope(p, pos), 8) AS trend FROM i GROUP BY 1")
def trend(spark, sf):
    i = index_rows(paths(spark, sf), ["market_id"], ["ts", "event_id"])
    return A.trend(i, "p", "_pos", ["market_id"]).withColumn("trend", r6("trend", 8))


@register("a20_by_period", "SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def by_period(spark, sf):
    return A.by_period(table(spark, sf, "orders"), "o_orderdate", "month", [F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("total")])


@register("a21_path_fan", f"WITH {PANEL} SELECT i AS step, count(x) AS n_paths, round(stddev_samp(x), 6) AS dispersion, " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.1, 0.5, 0.9, 0.95)) + " FROM cells GROUP BY 1")
def path_fan(spark, sf):
    long = panel(spark, sf).select(F.posexplode("r").alias("step", "x"))
    f = A.path_fan(long.withColumn("step", F.col("step").cast("bigint")), "step", "x")
    return f.select("step", "n_paths", *[r6(c).alias(c) for c in ("dispersion", "p05", "p10", "p50", "p90", "p95")])


# --- order, top-k ----------------------------------------------------------------------


@register("t01_multi_key_order", "SELECT s_nationkey, s_name, s_acctbal FROM supplier")
def multi_key_order(spark, sf):
    return table(spark, sf, "supplier").select("s_nationkey", "s_name", "s_acctbal").orderBy(F.col("s_nationkey"), F.col("s_acctbal").desc(), "s_name")


@register("t02_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf):
    return X.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@register("t03_top_n_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5")
def top_n_per_group(spark, sf):
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return X.top_n_per(line, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 5)


@register("t04_argmax_row", "SELECT n_nationkey AS c_nationkey, c_custkey, c_acctbal FROM (SELECT c_nationkey AS n_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def argmax_row(spark, sf):
    return X.argmax_row(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], ["c_nationkey"])


@register("t05_top_categories", "WITH k AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 3) SELECT CASE WHEN p_type IN (SELECT p_type FROM k) THEN p_type ELSE 'otro' END AS p_type, count(*) AS n FROM part GROUP BY 1")
def top_categories(spark, sf):
    return X.keep_top_categories(table(spark, sf, "part"), "p_type", 3).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@register("t06_latest_per_entity", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_entity(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return X.latest_per(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register("t07_rank_totals_per_year", "WITH s AS (SELECT year(o_orderdate) AS y, o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY total DESC, o_custkey) AS rank FROM s) WHERE rank <= 5")
def rank_totals_per_year(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(r6(F.sum("o_totalprice"), 2).alias("total"))
    return X.top_n_per(s, ["y"], [F.col("total").desc(), F.col("o_custkey")], 5)


# --- sets and shape ----------------------------------------------------------------------


@register("r01_union_by_name", "SELECT side, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT 'order' AS side, o_totalprice AS price FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem) GROUP BY 1")
def union_by_name(spark, sf):
    from tickweave.sources.payloads import union_pages

    o = table(spark, sf, "orders").select(F.lit("order").alias("side"), F.col("o_totalprice").alias("price"))
    line = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"), F.lit("line").alias("side"))
    return union_pages([o, line]).groupBy("side").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price"), 2).alias("total"))


@register("r02_key_overlap", """SELECT 'doc_id' AS "key", (SELECT count(DISTINCT doc_id) FROM documents) AS n_a, (SELECT count(DISTINCT doc_id) FROM labels) AS n_b, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_both""")
def key_overlap(spark, sf):
    return X.key_overlap(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@register("r03_same_keys", "WITH k AS (SELECT doc_id, sum(d) AS d FROM (SELECT doc_id, 1 AS d FROM documents UNION ALL SELECT doc_id, -1 FROM labels) GROUP BY 1) SELECT coalesce(max(abs(d)), 0)::BIGINT AS max_difference, coalesce(max(abs(d)), 0) = 0 AS same FROM k")
def same_keys(spark, sf):
    return X.same_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@register("r03_same_order", "SELECT count(*) AS n_differ FROM (SELECT c_custkey AS x, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) FULL JOIN (SELECT c_custkey AS y, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) USING (i) WHERE x IS DISTINCT FROM y")
def same_order(spark, sf):
    c = table(spark, sf, "customer")
    return X.same_order(c, c, "c_custkey", ["c_custkey"], ["c_acctbal", "c_custkey"])


@register("r04_dedup_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def dedup_keep_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return X.dedup(e, ["user_id", "event_type"], ["event_id"])


@register("r05_to_long", "SELECT l_returnflag, name, round(sum(value), 2) AS total FROM (UNPIVOT lineitem ON l_quantity, l_discount, l_tax INTO NAME name VALUE value) GROUP BY 1, 2")
def to_long(spark, sf):
    long = X.to_long(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    return long.groupBy("l_returnflag", "name").agg(r6(F.sum("value"), 2).alias("total"))


@register("r06_to_wide", "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{v}'), 6) AS mean_{v}" for v in ("click", "view", "signup")) + " FROM events GROUP BY 1")
def to_wide(spark, sf):
    w = X.to_wide(table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "signup"], F.col("value"), "mean_")
    return w.select("user_id", *[r6(c).alias(c) for c in w.columns[1:]])


@register("r07_one_hot", "SELECT user_id, " + ", ".join(f"sum((event_type = '{v}')::INT)::BIGINT AS event_type_{v}" for v in ("click", "purchase")) + " FROM events GROUP BY 1")
def one_hot(spark, sf):
    h = X.one_hot(table(spark, sf, "events"), "event_type", ["click", "purchase"])
    return h.groupBy("user_id").agg(*[F.sum(f"event_type_{v}").alias(f"event_type_{v}") for v in ("click", "purchase")])


@register("r08_many_series", f"WITH {MARKETS} SELECT market_id, count(*) AS n, round(max(p) - min(p), 6) AS range, round(var_pop(p), 6) AS variance FROM paths GROUP BY 1")
def many_series(spark, sf):
    return paths(spark, sf).groupBy("market_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("p") - F.min("p")).alias("range"), r6(F.var_pop("p")).alias("variance"))
