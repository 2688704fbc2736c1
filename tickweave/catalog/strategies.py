"""Queries for signals, trade matching, performance and rule-based strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import BARS, MARKETS, bars, markets, r6, table, ticks
from tickweave.catalog.panel_paths import ORDER, STEPS
from tickweave.catalog.series import EMA, GRID, ICHIMOKU, SAR, grid
from tickweave.operators import backtest as K
from tickweave.operators import indicators as I
from tickweave.operators import joins as J
from tickweave.operators import trajectory as T
from tickweave.plans.order_stats import medians
from tickweave.plans.registry import register
from tickweave.session import cut


def symbol_pairs(g):
    """Pairs of the trade symbols (the five event types form one sector)."""
    names = g.select("symbol").distinct().withColumn("sector", F.lit("all"))
    return J.candidate_pairs(names).select(F.col("stock_a").alias("leader"), F.col("stock_b").alias("follower"))


def daily_pairs(g):
    days = g.select(F.col("symbol").alias("leader"), "day").distinct()
    return symbol_pairs(g).join(days, "leader").withColumnRenamed("day", "trading_day")


_SMA = lambda c, a, part: f"CASE WHEN count({c}) OVER ({part} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) = 15 THEN avg({c}) OVER ({part} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END AS {a}"


def _signals(part):
    return GRID + f""", px AS (SELECT a.symbol AS leader, b.symbol AS follower, a.day AS trading_day, a.ts, a.close AS lp, b.close AS fp FROM grid a JOIN grid b ON a.ts = b.ts AND a.symbol < b.symbol),
sm AS (SELECT *, {_SMA('lp', 'ls', part)}, {_SMA('fp', 'fs', part)} FROM px),
sig AS (SELECT *, coalesce(lp > ls * 1.006 AND fp < fs * 1.002, false) AS lng, coalesce(lp < ls * 0.994 AND fp < fs * 0.998, false) AS sht FROM sm)"""


DAY_SIGNALS = _signals("PARTITION BY leader, follower, trading_day ORDER BY ts")
ALL_SIGNALS = _signals("PARTITION BY leader, follower ORDER BY ts")
TRADES = DAY_SIGNALS + """, ok AS (SELECT *, strftime(ts, '%H:%M:%S') AS clock FROM sig WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:30:00' AND '15:55:00' AND NOT (fp <= 10)),
ent AS (SELECT leader, follower, trading_day, min(ts) AS entry_time FROM ok WHERE lng OR sht GROUP BY 1, 2, 3),
en AS (SELECT ent.*, CASE WHEN lng THEN 'long' ELSE 'short' END AS side, fp AS entry_price FROM ent JOIN ok ON ok.leader = ent.leader AND ok.follower = ent.follower AND ok.ts = ent.entry_time),
ex AS (SELECT en.leader, en.follower, en.trading_day, min(ok.ts) AS exit_time FROM en JOIN ok ON ok.leader = en.leader AND ok.follower = en.follower AND ok.trading_day = en.trading_day AND ok.ts > entry_time
  WHERE clock >= '15:55:00' OR (side = 'long' AND lp < ls) OR (side = 'short' AND lp > ls) GROUP BY 1, 2, 3),
trades AS (SELECT en.*, exit_time, ok.fp AS exit_price, 100000 / entry_price AS shares, 100000 / entry_price * CASE WHEN side = 'long' THEN fp - entry_price ELSE entry_price - fp END AS gross_pnl, 2 * 100000 / entry_price * 0.0035 AS transaction_cost,
  CASE WHEN clock >= '15:55:00' THEN 'forced_eod_exit' WHEN side = 'long' THEN 'leader_below_base_sma' ELSE 'leader_above_base_sma' END AS exit_reason
  FROM en JOIN ex USING (leader, follower, trading_day) JOIN ok ON ok.leader = en.leader AND ok.follower = en.follower AND ok.ts = exit_time)"""


def trades(spark, sf):
    g = grid(spark, sf)
    return K.backtest(g, daily_pairs(g))


@register("b01_pair_signals", f"WITH {DAY_SIGNALS} SELECT leader, follower, trading_day::VARCHAR AS trading_day, count(*) AS n, sum(lng::INT)::BIGINT AS long_minutes, sum(sht::INT)::BIGINT AS short_minutes FROM sig GROUP BY 1, 2, 3")
def pair_signals(spark, sf):
    g = grid(spark, sf)
    s = K.pair_signals(K.pair_bars(g, daily_pairs(g)))
    return s.groupBy("leader", "follower", "trading_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("long_signal").cast("bigint")).alias("long_minutes"), F.sum(F.col("short_signal").cast("bigint")).alias("short_minutes"))


@register("b02_match_trades", f"""WITH {TRADES} SELECT leader, follower, trading_day::VARCHAR AS trading_day, side, entry_time::VARCHAR AS entry_time, exit_time::VARCHAR AS exit_time, entry_price, exit_price, round(shares, 6) AS shares, round(gross_pnl, 4) AS gross_pnl,
 round(transaction_cost, 6) AS transaction_cost, round(gross_pnl - transaction_cost, 4) AS net_pnl, exit_reason FROM trades""")
def match_trades(spark, sf):
    t = trades(spark, sf)
    return t.withColumns({"shares": r6("shares"), "gross_pnl": r6("gross_pnl", 4), "transaction_cost": r6("transaction_cost"), "net_pnl": r6("net_pnl", 4)})


@register("b03_backtest_by_pair", f"WITH {TRADES} SELECT leader, follower, count(*) AS n, round(sum(gross_pnl - transaction_cost), 3) AS net_pnl FROM trades GROUP BY 1, 2")
def backtest_by_pair(spark, sf):
    return trades(spark, sf).groupBy("leader", "follower").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("net_pnl"), 3).alias("net_pnl"))


EQUITY = TRADES + """, pnl AS (SELECT trading_day, sum(gross_pnl - transaction_cost) AS daily_pnl FROM trades GROUP BY 1),
eq AS (SELECT *, 100000 + sum(daily_pnl) OVER (ORDER BY trading_day) AS equity FROM pnl), er AS (SELECT *, coalesce(equity / nullif(lag(equity) OVER (ORDER BY trading_day), 0) - 1, 0) AS ret, max(equity) OVER (ORDER BY trading_day) AS peak FROM eq)"""


@register("b04_daily_equity", f"WITH {EQUITY} SELECT trading_day::VARCHAR AS trading_day, round(daily_pnl, 3) AS daily_pnl, round(equity, 3) AS strategy_equity, round(ret, 6) AS strategy_return FROM er")
def daily_equity(spark, sf):
    e = K.daily_equity(trades(spark, sf))
    return e.select("trading_day", r6("daily_pnl", 3).alias("daily_pnl"), r6("strategy_equity", 3).alias("strategy_equity"), r6("strategy_return").alias("strategy_return"))


@register("b05_buy_and_hold", f"""WITH {GRID}, c AS (SELECT day, arg_max(close, ts) AS c FROM grid WHERE symbol = 'click' AND CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY 1),
e AS (SELECT day, c, 100000 / first_value(c) OVER (ORDER BY day) * c AS eq FROM c) SELECT day::VARCHAR AS trading_day, c AS benchmark_close, round(eq, 4) AS benchmark_equity, round(coalesce(eq / lag(eq) OVER (ORDER BY day) - 1, 0), 6) AS benchmark_return FROM e""")
def buy_and_hold(spark, sf):
    b = K.buy_and_hold(grid(spark, sf).filter(F.col("symbol") == "click"), "2024-01-03", "2024-01-25")
    return b.withColumns({"benchmark_equity": r6("benchmark_equity", 4), "benchmark_return": r6("benchmark_return")})


_PERF = """n_periods, total_return, cagr, ann_vol, sharpe, sortino, max_drawdown, cagr / nullif(abs(max_drawdown), 0) AS calmar"""


@register("b06_performance", GRID.join(["WITH ", """, c AS (SELECT day, arg_max(close, ts) AS c FROM grid WHERE symbol = 'view' AND CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' GROUP BY 1),
e AS (SELECT day, 100000 / first_value(c) OVER (ORDER BY day) * c AS eq FROM c), r AS (SELECT day, eq, coalesce(eq / lag(eq) OVER (ORDER BY day) - 1, 0) AS r, max(eq) OVER (ORDER BY day) AS pk FROM e),
s AS (SELECT count(*) AS n_periods, arg_max(eq, day) / arg_min(eq, day) AS g, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS neg, min(eq / pk - 1) AS max_drawdown FROM r),
t AS (SELECT n_periods, g - 1 AS total_return, pow(g, 252.0 / n_periods) - 1 AS cagr, sd * sqrt(252) AS ann_vol, mu / sd * sqrt(252) AS sharpe, mu / neg * sqrt(252) AS sortino, max_drawdown FROM s)
SELECT n_periods, round(total_return, 6) AS total_return, round(ln(1 + cagr), 6) AS log_cagr, round(ann_vol, 5) AS ann_vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(ln(abs(cagr / max_drawdown)), 6) AS log_calmar FROM t"""]))
def performance(spark, sf):
    b = K.buy_and_hold(grid(spark, sf).filter(F.col("symbol") == "view"), "1900-01-01", "2999-01-01")
    return rounded(K.performance(b, "benchmark_equity", "benchmark_return"))


def rounded(p, *keys):
    return p.select(
        *keys, "n_periods", r6("total_return").alias("total_return"), r6(F.ln(1 + F.col("cagr"))).alias("log_cagr"), r6("ann_vol", 5).alias("ann_vol"), r6("sharpe").alias("sharpe"),
        r6("sortino").alias("sortino"), r6("max_drawdown").alias("max_drawdown"), r6(F.ln(F.abs("calmar"))).alias("log_calmar"))


# b06_performance is one series by its twin; this one is every symbol of the grid.
@register("b06_performance_by_symbol", GRID.join(["WITH ", """, c AS (SELECT symbol, day, arg_max(close, ts) AS c FROM grid WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' GROUP BY 1, 2),
e AS (SELECT symbol, day, 100000 / first_value(c) OVER w * c AS eq FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)), r AS (SELECT symbol, day, eq, coalesce(eq / lag(eq) OVER w - 1, 0) AS r, max(eq) OVER w AS pk FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day)),
s AS (SELECT symbol, count(*) AS n_periods, arg_max(eq, day) / arg_min(eq, day) AS g, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS neg, min(eq / pk - 1) AS max_drawdown FROM r GROUP BY 1),
t AS (SELECT symbol, n_periods, g - 1 AS total_return, pow(g, 252.0 / n_periods) - 1 AS cagr, sd * sqrt(252) AS ann_vol, mu / nullif(sd, 0) * sqrt(252) AS sharpe, mu / nullif(neg, 0) * sqrt(252) AS sortino, max_drawdown FROM s)
SELECT symbol, n_periods, round(total_return, 6) AS total_return, round(ln(1 + cagr), 6) AS log_cagr, round(ann_vol, 5) AS ann_vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(ln(nullif(abs(cagr / nullif(max_drawdown, 0)), 0)), 6) AS log_calmar FROM t"""]))
def performance_by_symbol(spark, sf):
    b = K.buy_and_hold(grid(spark, sf), "1900-01-01", "2999-01-01", keys=["symbol"])
    return rounded(K.performance(b, "benchmark_equity", "benchmark_return", keys=["symbol"]), "symbol")


@register("b07_trade_summary", f"""WITH {TRADES}, t AS (SELECT *, gross_pnl - transaction_cost AS net FROM trades), d AS (SELECT trading_day, count(*) AS n FROM t GROUP BY 1)
SELECT count(*) AS total_trades, (SELECT round(avg(n), 6) FROM d) AS avg_per_day, (SELECT max(n) FROM d) AS max_per_day, round(sum(net), 2) AS total_net_pnl, round(avg(net), 4) AS avg_net_pnl, round(avg((net > 0)::INT), 6) AS win_rate,
 round(sum(net) FILTER (side = 'long'), 2) AS long_net_pnl, round(sum(net) FILTER (side = 'short'), 2) AS short_net_pnl, round(avg((net > 0)::INT) FILTER (side = 'long'), 6) AS long_win_rate FROM t""")
def trade_summary(spark, sf):
    s = K.trade_summary(trades(spark, sf))
    return s.withColumns({"avg_per_day": r6("avg_per_day"), "total_net_pnl": r6("total_net_pnl", 2), "avg_net_pnl": r6("avg_net_pnl", 4), "win_rate": r6("win_rate"), "long_net_pnl": r6("long_net_pnl", 2), "short_net_pnl": r6("short_net_pnl", 2), "long_win_rate": r6("long_win_rate")})


STARTS = ALL_SIGNALS + """, st AS (SELECT *, lng AND NOT coalesce(lag(lng) OVER d, false) AS ls_start, sht AND NOT coalesce(lag(sht) OVER d, false) AS ss_start, lead(fp, 5) OVER p / fp - 1 AS f5, lead(fp, 15) OVER p / fp - 1 AS f15, lead(fp, 30) OVER p / fp - 1 AS f30, lead(fp, 60) OVER p / fp - 1 AS f60
 FROM sig WINDOW d AS (PARTITION BY leader, follower, trading_day ORDER BY ts), p AS (PARTITION BY leader, follower ORDER BY ts))"""
HORIZONS = (5, 15, 30, 60)


def starts(spark, sf):
    g = grid(spark, sf)
    return K.signal_starts(K.pair_prices(g, symbol_pairs(g)), HORIZONS)


@register("b08_signal_frequency", f"""WITH {STARTS}, f AS (SELECT leader, follower, count(DISTINCT trading_day) AS n_days, sum(lng::INT)::BIGINT AS long_minutes, sum(ls_start::INT)::BIGINT AS long_starts, sum(sht::INT)::BIGINT AS short_minutes, sum(ss_start::INT)::BIGINT AS short_starts FROM st GROUP BY 1, 2)
SELECT *, round(long_starts / n_days, 6) AS long_starts_per_day, round(short_starts / n_days, 6) AS short_starts_per_day FROM f""")
def signal_frequency(spark, sf):
    f = K.signal_frequency(starts(spark, sf))
    return f.withColumns({c: r6(c) for c in ("long_starts_per_day", "short_starts_per_day")})


# no return from a price of zero: such a row is no eligible row
_EVENTS = STARTS.replace("/ fp - 1", "/ nullif(fp, 0) - 1")


@register("b09_event_study", f"""WITH {_EVENTS}, el AS (SELECT *, row_number() OVER (PARTITION BY leader, follower ORDER BY ('0x' || substr(md5('42-' || leader || '-' || follower || '-' || epoch(ts)::BIGINT::VARCHAR), 1, 15))::BIGINT, ts) AS rn FROM st WHERE NOT ls_start AND f5 IS NOT NULL AND f15 IS NOT NULL AND f30 IS NOT NULL AND f60 IS NOT NULL),
n AS (SELECT leader, follower, sum(ls_start::INT) AS n FROM st GROUP BY 1, 2), b AS (SELECT el.* FROM el JOIN n USING (leader, follower) WHERE rn <= n), e AS (SELECT * FROM st WHERE ls_start)
""" + " UNION ALL ".join(f"SELECT {h} AS horizon, round((SELECT avg(f{h}) FROM e), 6) AS signal, round((SELECT avg(f{h}) FROM b), 6) AS random, round((SELECT avg(f{h}) FROM e) - (SELECT avg(f{h}) FROM b), 6) AS excess_return" for h in HORIZONS))
def event_study(spark, sf):
    # read for the events, the eligible rows and the counts
    s = cut(starts(spark, sf))
    x = K.excess_returns(K.event_study(s, HORIZONS), K.matched_baseline(s, HORIZONS), HORIZONS)
    return x.select("horizon", *[r6(c).alias(c) for c in ("signal", "random", "excess_return")])


# --- mispricing rules -----------------------------------------------------------------------


def mispriced(spark, sf):
    """Markets with a simple mispricing (mean - final) and a regime by drawdown."""
    from tickweave.catalog.fixtures import paths

    f = T.trajectory_features(paths(spark, sf), ["market_id"], ORDER, "b").select("market_id", "max_drawdown")
    mid = medians(f, {"m": "max_drawdown"}).select("m").scalar()
    regime = F.when(F.col("max_drawdown") > mid, K.PROCESSING).otherwise(K.ANCHORED)
    m = markets(spark, sf).withColumn("mispricing", F.col("mean_probability") - F.col("final_probability"))
    return m.join(f.withColumn("market_regime", regime), "market_id")


MISPRICED = STEPS.replace("paths AS (", "paths AS MATERIALIZED (", 1) + """, markets AS (SELECT market_id, arg_max(p, event_id) AS final_probability, avg(p) AS mean_probability, CAST(arg_max(event_type, event_id) IN ('purchase', 'signup') AS INTEGER) AS outcome FROM paths GROUP BY 1),
dd AS (SELECT market_id, max((peak - p) / nullif(peak, 0)) AS mdd FROM steps GROUP BY 1),
mis AS (SELECT m.*, mean_probability - final_probability AS mispricing, CASE WHEN mdd > (SELECT median(mdd) FROM dd) THEN 'Information Processing' ELSE 'Anchored / Noisy' END AS market_regime FROM markets m JOIN dd USING (market_id))"""


def simple_mispriced(spark, sf):
    return markets(spark, sf).withColumn("mispricing", F.col("mean_probability") - F.col("final_probability"))


@register("b10_threshold_signal", f"WITH {MARKETS}, m AS (SELECT mean_probability - final_probability AS x FROM markets) SELECT CASE WHEN x > 0.05 THEN 'BUY' WHEN x < -0.05 THEN 'SELL' ELSE 'NO TRADE' END AS signal, count(*) AS n FROM m GROUP BY 1")
def threshold_signal(spark, sf):
    return K.threshold_signal(simple_mispriced(spark, sf)).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


TAUS = [round(0.01 * i, 2) for i in range(1, 21)]


@register("b10_threshold_sweep", f"""WITH {MARKETS}, m AS (SELECT mean_probability - final_probability AS x, outcome AS y FROM markets), g AS (SELECT unnest({TAUS})::DOUBLE AS t)
SELECT t AS threshold, count(*) FILTER (x > t) AS buy_signals, count(*) FILTER (x < -t) AS sell_signals, count(*) FILTER (abs(x) > t) AS total_trades, round(count(*) FILTER ((x > t AND y = 1) OR (x < -t AND y = 0)) / nullif(count(*) FILTER (abs(x) > t), 0), 6) AS accuracy,
 round(count(*) FILTER (x > t AND y = 1) / nullif(count(*) FILTER (x > t), 0), 6) AS buy_accuracy, round(count(*) FILTER (x < -t AND y = 0) / nullif(count(*) FILTER (x < -t), 0), 6) AS sell_accuracy FROM m, g GROUP BY 1""")
def threshold_sweep(spark, sf):
    s = K.threshold_sweep(simple_mispriced(spark, sf), TAUS)
    return s.withColumns({c: r6(c) for c in ("accuracy", "buy_accuracy", "sell_accuracy")})


@register("b11_regime_accuracy", f"""WITH {MISPRICED}, g AS (SELECT unnest([0, 0.025, 0.05, 0.1, 0.15, 0.2])::DOUBLE AS threshold)
SELECT market_regime, threshold, count(*) AS trades, round(avg(((mispricing > 0)::INT = outcome)::INT), 6) AS normal_accuracy, round(avg(((mispricing > 0)::INT <> outcome)::INT), 6) AS inverted_accuracy FROM mis, g WHERE abs(mispricing) >= threshold GROUP BY 1, 2""")
def regime_accuracy(spark, sf):
    a = K.regime_accuracy(mispriced(spark, sf), [0, 0.025, 0.05, 0.1, 0.15, 0.2])
    return a.withColumns({"normal_accuracy": r6("normal_accuracy"), "inverted_accuracy": r6("inverted_accuracy")})


PREDS = ("pred_original", "pred_contrarian", "pred_regime_aware")


@register("b12_binary_pnl", f"""WITH {MISPRICED}, pr AS (SELECT *, (mispricing > 0)::INT AS pred_original, 1 - (mispricing > 0)::INT AS pred_contrarian, CASE WHEN market_regime = 'Information Processing' THEN 1 - (mispricing > 0)::INT ELSE (mispricing > 0)::INT END AS pred_regime_aware FROM mis)
""" + " UNION ALL ".join(f"SELECT '{c}' AS strategy, round(sum(CASE WHEN {c} = 1 THEN outcome - final_probability ELSE final_probability - outcome END), 6) AS total_pnl, round(avg(CASE WHEN {c} = 1 THEN outcome - final_probability ELSE final_probability - outcome END), 6) AS avg_trade, round(avg((CASE WHEN {c} = 1 THEN outcome - final_probability ELSE final_probability - outcome END > 0)::INT), 6) AS win_rate, count(*) AS n_trades FROM pr" for c in PREDS))
def binary_pnl(spark, sf):
    p = K.pnl_summary(K.binary_pnl(K.regime_signal(mispriced(spark, sf)), PREDS), PREDS)
    return p.withColumns({c: r6(c) for c in ("total_pnl", "avg_trade", "win_rate")})


@register("b12_cumulative_pnl", f"WITH {MARKETS} SELECT market_id, round(sum(CASE WHEN mean_probability > final_probability THEN outcome - final_probability ELSE final_probability - outcome END) OVER (ORDER BY market_id), 6) AS cum_pnl FROM markets")
def cumulative_pnl(spark, sf):
    from tickweave.plans.series import running

    m = simple_mispriced(spark, sf).withColumn("pred", (F.col("mispricing") > 0).cast("int"))
    c = running(K.binary_pnl(m, ["pred"]), [], ["market_id"], {"cum_pnl": ("sum", "pnl_pred")})
    return c.select("market_id", r6("cum_pnl").alias("cum_pnl"))


# --- indicator rules -----------------------------------------------------------------------

_UP = "close > span_a AND close > span_b AND tenkan > kijun AND chikou > close"
_DOWN = "close < span_a AND close < span_b AND tenkan < kijun AND chikou < close"


@register("b13_ichimoku_signal", f"WITH {ICHIMOKU} SELECT symbol, ts::VARCHAR AS ts, CASE WHEN {_UP} THEN 1 WHEN {_DOWN} THEN -1 ELSE 0 END AS signal FROM cloud")
def ichimoku_signal(spark, sf):
    return K.ichimoku_signal(I.ichimoku(bars(spark, sf))).select("symbol", "ts", "signal")


_SAR_CTE = SAR[len(BARS):].lstrip(", ")
_EMA_CTE = EMA[len(BARS):].lstrip(", ")


@register("b13_confirmed_signal", f"""WITH RECURSIVE {ICHIMOKU}, {_EMA_CTE}, {_SAR_CTE},
z AS (SELECT c.symbol, CASE WHEN {_UP} AND e12 - e26 > sig AND c.close > sar THEN 1 WHEN {_DOWN} AND e12 - e26 < sig AND c.close < sar THEN -1 ELSE 0 END AS signal
 FROM (SELECT * FROM cloud) c JOIN (SELECT symbol, ts, e12, e26, sig FROM ema) e ON e.symbol = c.symbol AND e.ts = c.ts JOIN (SELECT symbol, ts, sar FROM sar) q ON q.symbol = c.symbol AND q.ts = c.ts) SELECT symbol, signal, count(*) AS n FROM z GROUP BY 1, 2""")
def confirmed_signal(spark, sf):
    b = I.ichimoku(bars(spark, sf))
    b = b.join(I.macd(bars(spark, sf)).select("symbol", "ts", "macd", "macd_signal"), ["symbol", "ts"])
    b = b.join(I.parabolic_sar(bars(spark, sf)).select("symbol", "ts", "sar"), ["symbol", "ts"])
    return K.ichimoku_signal(b, ["macd", "sar"]).groupBy("symbol", "signal").agg(F.count(F.lit(1)).alias("n"))


_RANGE = BARS + """, ra AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN avg(high - low) OVER w END AS atr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
entry AS (SELECT symbol, ts AS entry_ts, close AS entry_price, atr FROM ra WHERE close > open AND atr IS NOT NULL),
ord AS (SELECT *, entry_price - k * atr AS stop, entry_price + m * atr AS target FROM entry, (SELECT unnest([0.5, 1.0])::DOUBLE AS k), (SELECT unnest([0.5, 1.5])::DOUBLE AS m)),
hit AS (SELECT o.symbol, o.entry_ts, o.k, o.m, arg_min(CASE WHEN low <= stop THEN 'stop' ELSE 'target' END, ts) AS reason, min(ts) AS exit_ts FROM ord o JOIN bars b ON b.symbol = o.symbol AND b.ts > o.entry_ts AND (low <= stop OR high >= target) GROUP BY 1, 2, 3, 4)"""


def _bracket(spark, sf):
    b = I.indicators(bars(spark, sf), ["atr"])
    entries = b.filter((F.col("close") > F.col("open")) & F.col("atr14").isNotNull()).select("symbol", "ts", "close", F.col("atr14").alias("atr"))
    return K.bracket_exit(entries, bars(spark, sf), [0.5, 1.0], [0.5, 1.5])


@register("b14_bracket_exit", f"WITH {_RANGE} SELECT o.symbol, o.entry_ts::VARCHAR AS entry_ts, o.k, o.m, entry_price, exit_ts::VARCHAR AS exit_ts, reason AS exit_reason, round(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target END - entry_price, 6) AS pnl FROM ord o LEFT JOIN hit h ON h.symbol = o.symbol AND h.entry_ts = o.entry_ts AND h.k = o.k AND h.m = o.m")
def bracket_exit(spark, sf):
    return _bracket(spark, sf).withColumn("pnl", r6("pnl"))


@register("b14_bracket_grid", f"WITH {_RANGE}, r AS (SELECT o.symbol, o.k, o.m, CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target END - entry_price AS pnl FROM ord o LEFT JOIN hit h ON h.symbol = o.symbol AND h.entry_ts = o.entry_ts AND h.k = o.k AND h.m = o.m) SELECT symbol, k, m, count(pnl) AS n_closed, count(*) AS n_entries, round(sum(pnl), 4) AS total_pnl, round(avg((pnl > 0)::INT), 6) AS win_rate FROM r GROUP BY 1, 2, 3")
def bracket_grid(spark, sf):
    g = K.grid_score(_bracket(spark, sf))
    return g.withColumns({"total_pnl": r6("total_pnl", 4), "win_rate": r6("win_rate")})


@register("b15_ensemble", f"""WITH {BARS}, f AS (SELECT symbol, ts, close AS price, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nxt, vwap AS prediction, (high + low) / 2 AS median, high - low AS dispersion, volume / 1000.0 AS volatility FROM bars),
d AS (SELECT *, prediction > price AND median > price AND NOT dispersion > 100 AND NOT volatility > 0.4 AS up, prediction < price AND median < price AND NOT dispersion > 100 AND NOT volatility > 0.4 AS down FROM f WHERE nxt IS NOT NULL)
SELECT symbol, ts::VARCHAR AS ts, CASE WHEN up THEN 'Comprar' WHEN down THEN 'Vender en Corto' ELSE 'No operar' END AS decision, round(CASE WHEN up THEN nxt - price WHEN down THEN price - nxt ELSE 0 END, 6) AS gain FROM d""")
def ensemble(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", F.col("close").alias("price"), F.col("vwap").alias("prediction"), ((F.col("high") + F.col("low")) / 2).alias("median"), (F.col("high") - F.col("low")).alias("dispersion"), (F.col("volume") / 1000.0).alias("volatility"))
    return K.ensemble_decision(b, 100.0, 0.4).select("symbol", "ts", "decision", r6("gain").alias("gain"))
