"""Queries for ordered series: returns, rolling values, grids, indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import BARS, PATHS, RAW_BARS, TICKS, bars, paths, r6, raw_bars, ticks
from tickweave.catalog.tables import RETS, aligned, candidates, universe
from tickweave.functions.scalars import ratio
from tickweave.operators import bars as B
from tickweave.operators import indicators as I
from tickweave.operators import leadlag as L
from tickweave.operators import series as R
from tickweave.plans.registry import register
from tickweave.plans.series import over_series

T_ORDER = ["ts", "event_id"]
_W = "PARTITION BY symbol ORDER BY ts"
_WT = "PARTITION BY symbol ORDER BY ts, event_id"


def _rolled(fn, c, n, alias, order=_W):
    frame = f"({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {fn}({c}) OVER {frame} END AS {alias}"


GRID = TICKS + """, minutes AS (
  SELECT symbol, date_trunc('minute', ts) AS minute, arg_max(price, event_id) AS close, sum(qty) AS volume FROM ticks
  WHERE CAST(ts AS TIME) >= TIME '09:15:00' AND CAST(ts AS TIME) < TIME '16:01:00' GROUP BY 1, 2),
days AS (SELECT DISTINCT symbol, CAST(minute AS DATE) AS day FROM minutes),
slots AS (SELECT symbol, day, unnest(generate_series(day + INTERVAL 555 MINUTE, day + INTERVAL 960 MINUTE, INTERVAL 1 MINUTE)) AS ts FROM days),
joined AS (SELECT s.symbol, s.day, s.ts, m.close, coalesce(m.volume, 0)::BIGINT AS volume FROM slots s LEFT JOIN minutes m ON m.symbol = s.symbol AND m.minute = s.ts),
grid AS (SELECT symbol, day, ts, volume, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(close IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM joined)"""


def grid(spark, sf):
    """Minute grid 09:15-16:00 of trades."""
    t = ticks(spark, sf).withColumns({"close": F.col("price"), "volume": F.col("qty")})
    return B.resample_grid(t, prices=["close"], flows=["volume"], order=T_ORDER)


@register("flagship_signal_starts", f"""WITH {GRID},
s AS (SELECT *, {_rolled('avg', 'close', 15, 'sma15')}, lead(close, 5) OVER ({_W}) / close - 1 AS fwd_5 FROM grid),
f AS (SELECT *, coalesce(close > sma15 * 1.006, false) AS flag FROM s),
e AS (SELECT *, flag AND NOT coalesce(lag(flag) OVER (PARTITION BY symbol, day ORDER BY ts), false) AS start FROM f)
SELECT symbol, count(*) AS n_starts, count(fwd_5) AS n_forward, round(avg(fwd_5), 6) AS mean_fwd_5 FROM e WHERE start GROUP BY 1""")
def flagship(spark, sf):
    """Grid bars → 15-bar mean → long-signal starts → 5-bar forward return, per symbol."""

    def build(d, w):
        d = d.withColumns({"sma15": R.rolled("mean", "close", 15, w), "fwd_5": ratio(F.lead("close", 5).over(w), "close") - 1})
        d = d.withColumn("flag", F.coalesce(F.col("close") > F.col("sma15") * 1.006, F.lit(False)))
        # same day as the row before, otherwise the day begins without a signal
        before = F.lag("flag").over(w) & (F.lag("day").over(w) == F.col("day"))
        return d.withColumn("start", F.col("flag") & ~F.coalesce(before, F.lit(False)))

    # one row per symbol and minute of the calendar
    marked = over_series(grid(spark, sf), ["symbol"], ["ts"], build, before=16, after=5, bounded=True)
    return marked.filter("start").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_starts"), F.count("fwd_5").alias("n_forward"), r6(F.avg("fwd_5")).alias("mean_fwd_5"))


# no return from a price of zero, and no logarithm of a ratio that is not positive
_MOVE = f"price / nullif(lag(price) OVER ({_WT}), 0)"


@register("w01_returns", f"WITH {TICKS} SELECT event_id, round({_MOVE} - 1, 6) AS simple, round(ln(CASE WHEN {_MOVE} > 0 THEN {_MOVE} END), 6) AS log, round(price - lag(price) OVER ({_WT}), 6) AS diff FROM ticks")
def returns(spark, sf):
    def build(d, w):
        prev = F.lag("price").over(w)
        return d.withColumns({k: r6(R.change("price", prev, k)) for k in ("simple", "log", "diff")})

    return over_series(ticks(spark, sf), ["symbol"], T_ORDER, build, before=1).select("event_id", "simple", "log", "diff")


@register("w02_rolling_mean_std", f"WITH {TICKS}, r AS (SELECT event_id, {_rolled('avg', 'price', 20, 'm', _WT)}, {_rolled('stddev_samp', 'price', 20, 's', _WT)} FROM ticks) SELECT event_id, round(m, 6) AS mean20, round(s, 6) AS std20 FROM r")
def rolling_mean_std(spark, sf):
    out = R.rolling(ticks(spark, sf), {"mean20": ("mean", "price", 20), "std20": ("std", "price", 20)}, order=T_ORDER)
    return out.select("event_id", r6("mean20").alias("mean20"), r6("std20").alias("std20"))


@register("w03_rolling_max_min", f"WITH {TICKS} SELECT event_id, {_rolled('max', 'price', 26, 'max26', _WT)}, {_rolled('min', 'price', 9, 'min9', _WT)} FROM ticks")
def rolling_max_min(spark, sf):
    out = R.rolling(ticks(spark, sf), {"max26": ("max", "price", 26), "min9": ("min", "price", 9)}, order=T_ORDER)
    return out.select("event_id", "max26", "min9")


ROLLING_CORR = RETS + """, rc AS (SELECT stock_a, stock_b, ts, day, CASE WHEN count(*) OVER w = 60 THEN corr(x_a, x_b) OVER w END AS c FROM aligned
  WINDOW w AS (PARTITION BY stock_a, stock_b ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


@register("w04_rolling_corr_daily", f"WITH {ROLLING_CORR} SELECT stock_a, stock_b, day::VARCHAR AS day, round(c, 6) AS rolling_corr FROM rc")
def rolling_corr_daily(spark, sf):
    return L.rolling_corr_daily(aligned(spark, sf), 60, bounded=True).withColumn("rolling_corr", r6("rolling_corr"))


@register("w05_forward_returns", f"WITH {TICKS} SELECT event_id, " + ", ".join(f"round(lead(price, {h}) OVER ({_WT}) / nullif(price, 0) - 1, 6) AS fwd_{h}" for h in (5, 15, 30, 60)) + " FROM ticks")
def forward_returns(spark, sf):
    f = R.forward_returns(ticks(spark, sf), price="price", order=T_ORDER)
    return f.select("event_id", *[r6(f"fwd_{h}").alias(f"fwd_{h}") for h in (5, 15, 30, 60)])


@register("w06_rising_edge", f"WITH {TICKS}, e AS (SELECT symbol, CAST(ts AS DATE) AS day, price > 60 AND NOT coalesce(lag(price > 60) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id), false) AS start FROM ticks) SELECT symbol, day::VARCHAR AS day, count(*) AS n FROM e WHERE start GROUP BY 1, 2")
def rising_edge(spark, sf):
    t = ticks(spark, sf).withColumn("flag", F.col("price") > 60)
    e = R.rising_edge(t, "flag", ["symbol"], T_ORDER).filter("start")
    return e.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("w07_equity_curve", f"WITH {TICKS} SELECT event_id, round(100000 + sum(price - 50) OVER ({_WT} ROWS UNBOUNDED PRECEDING), 4) AS equity FROM ticks")
def equity_curve(spark, sf):
    t = ticks(spark, sf).withColumn("pnl", F.col("price") - 50)
    return R.equity_curve(t, "pnl", 100_000, ["symbol"], T_ORDER).select("event_id", r6("equity", 4).alias("equity"))


@register("w08_drawdown", f"WITH {TICKS} SELECT event_id, max(price) OVER ({_WT} ROWS UNBOUNDED PRECEDING) AS peak, round(price / max(price) OVER ({_WT} ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM ticks")
def drawdown(spark, sf):
    d = R.drawdown(ticks(spark, sf), "price", ["symbol"], T_ORDER)
    return d.select("event_id", "peak", r6("drawdown").alias("drawdown"))


EMA = BARS + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
ema AS (SELECT symbol, ts, i, close, close AS e10, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig FROM n WHERE i = 1
 UNION ALL SELECT n.symbol, n.ts, n.i, n.close, e10 + 2.0 / 11 * (n.close - e10), e12 + 2.0 / 13 * (n.close - e12), e26 + 2.0 / 27 * (n.close - e26),
   sig + 0.2 * ((e12 + 2.0 / 13 * (n.close - e12)) - (e26 + 2.0 / 27 * (n.close - e26)) - sig) FROM ema JOIN n ON n.symbol = ema.symbol AND n.i = ema.i + 1)"""


@register("w09_ewm", f"WITH RECURSIVE {EMA} SELECT symbol, ts::VARCHAR AS ts, round(e10, 6) AS ema10, round(e26, 6) AS ema26 FROM ema")
def ewm(spark, sf):
    e = R.ewm(bars(spark, sf), {"ema10": ("close", 10), "ema26": ("close", 26)})
    return e.select("symbol", "ts", r6("ema10").alias("ema10"), r6("ema26").alias("ema26"))


@register("w10_resample_grid", f"WITH {GRID} SELECT symbol, ts::VARCHAR AS ts, close, volume FROM grid")
def resample_grid(spark, sf):
    return grid(spark, sf).select("symbol", "ts", "close", "volume")


@register("a22_minute_last", f"WITH {TICKS} SELECT symbol, date_trunc('minute', ts)::VARCHAR AS minute, arg_max(price, event_id) AS close, sum(qty)::BIGINT AS volume FROM ticks GROUP BY 1, 2")
def minute_last(spark, sf):
    t = ticks(spark, sf).withColumns({"close": F.col("price"), "volume": F.col("qty")})
    return B.minute_last(t, ["close"], ["volume"], order=T_ORDER).select("symbol", "minute", "close", "volume")


@register("w11_resample_observed", TICKS.join(["WITH ", """, m AS (SELECT symbol, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute, arg_max(price, event_id) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2, 3),
slots AS (SELECT symbol, day, unnest(generate_series(min(minute), max(minute), INTERVAL 1 MINUTE)) AS ts FROM m GROUP BY 1, 2),
g AS (SELECT s.symbol, s.ts, coalesce(m.volume, 0)::BIGINT AS volume, last_value(m.close IGNORE NULLS) OVER (PARTITION BY s.symbol, s.day ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM slots s LEFT JOIN m ON m.symbol = s.symbol AND m.minute = s.ts)
SELECT symbol, ts::DATE::VARCHAR AS day, count(*) AS n, sum(volume)::BIGINT AS volume, round(sum(close), 4) AS closes FROM g GROUP BY 1, 2"""]))
def resample_observed(spark, sf):
    t = ticks(spark, sf).withColumns({"close": F.col("price"), "volume": F.col("qty")})
    g = B.resample_observed(t, prices=["close"], flows=["volume"], order=T_ORDER)
    return g.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), r6(F.sum("close"), 4).alias("closes"))


_NUMBERED = PATHS + ", num AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY market_id) AS n FROM paths)"


@register("w12_early_slice_floor5", f"WITH {_NUMBERED} SELECT market_id, h::DOUBLE AS horizon, count(*) AS n_rows, round(avg(p), 6) AS mean_p FROM num, (SELECT unnest([0.25, 0.5, 0.75]) AS h) WHERE rn <= greatest(floor(n * h), 5) GROUP BY 1, 2")
def early_slice_floor5(spark, sf):
    s = R.early_slice(paths(spark, sf), [0.25, 0.5, 0.75], "floor5", ["market_id"], T_ORDER)
    return s.groupBy("market_id", "horizon").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("p")).alias("mean_p"))


@register("w13_early_slice_ceil2", f"""WITH {_NUMBERED}, life AS (SELECT market_id, min(ts) AS a, max(ts) AS b FROM paths GROUP BY 1)
SELECT market_id, h::DOUBLE AS horizon, max(n) AS total_n_obs, count(*) AS early_n_obs, round(count(*) / max(n), 6) AS early_obs_share, round(epoch(max(ts) - any_value(a)), 3) AS early_time_seconds, round(epoch(max(ts) - any_value(a)) / epoch(any_value(b) - any_value(a)), 6) AS early_time_share
FROM num JOIN life USING (market_id), (SELECT unnest([0.25, 0.5, 0.75]) AS h) WHERE rn <= greatest(ceil(n * h), 2) GROUP BY 1, 2""")
def early_slice_ceil2(spark, sf):
    p = paths(spark, sf)
    s = R.early_shares(R.early_slice(p, [0.25, 0.5, 0.75], "ceil2", ["market_id"], T_ORDER), p, ["market_id"])
    return s.select("market_id", "horizon", "total_n_obs", "early_n_obs", r6("early_obs_share").alias("early_obs_share"), r6("early_time_seconds", 3).alias("early_time_seconds"), r6("early_time_share").alias("early_time_share"))


@register("w14_autocorr", f"WITH {TICKS}, d AS (SELECT symbol, event_id, ts, price - lag(price) OVER ({_WT}) AS r FROM ticks), q AS (SELECT symbol, r, lag(r) OVER ({_WT}) AS p FROM d WHERE r IS NOT NULL) SELECT symbol, round(corr(r, p), 6) AS autocorr FROM q GROUP BY 1")
def autocorr(spark, sf):
    r = R.returns(ticks(spark, sf), "diff", "price", order=T_ORDER)
    return R.autocorr1(r, "ret", ["symbol"], T_ORDER).withColumn("autocorr", r6("autocorr"))


@register("w15_displaced", f"WITH {TICKS} SELECT event_id, lag(price, 26) OVER ({_WT}) AS back26, lead(price, 26) OVER ({_WT}) AS ahead26 FROM ticks")
def displaced(spark, sf):
    return R.lagged(ticks(spark, sf), ["symbol"], T_ORDER, {"back26": ("price", 26), "ahead26": ("price", -26)}).select("event_id", "back26", "ahead26")


@register("w16_run_length", f"""WITH {TICKS}, f AS (SELECT *, qty > 30 AS s FROM ticks), c AS (SELECT *, s IS DISTINCT FROM lag(s) OVER ({_WT}) OR row_number() OVER ({_WT}) = 1 AS is_new FROM f), g AS (SELECT *, sum(is_new::INT) OVER ({_WT} ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT event_id, s AS state, row_number() OVER (PARTITION BY symbol, run ORDER BY ts, event_id) AS run_count, (first_value(ts) OVER (PARTITION BY symbol, run ORDER BY ts, event_id))::VARCHAR AS run_start FROM g""")
def run_length(spark, sf):
    t = ticks(spark, sf).withColumn("state", F.col("qty") > 30)
    return R.run_length(t, "state", ["symbol"], T_ORDER).select("event_id", "state", "run_count", "run_start")


@register("w17_lead_lag", "WITH " + RETS + ", m AS (SELECT stock_a, stock_b, x_a, x_b" + "".join(f", lead(x_b, {k}) OVER w AS y{k}, lead(x_a, {k}) OVER w AS x{k}" for k in (1, 5, 15, 30)) + " FROM aligned WINDOW w AS (PARTITION BY stock_a, stock_b ORDER BY ts)), s AS (" + " UNION ALL ".join(f"SELECT stock_a, stock_b, {k} AS lag, corr(x_a, y{k}) AS f, corr(x_b, x{k}) AS r FROM m GROUP BY 1, 2" for k in (1, 5, 15, 30)) + ") SELECT stock_a, stock_b, lag, round(f, 6) AS forward, round(r, 6) AS reverse, round(f - r, 6) AS lead_score, CASE WHEN f - r > 0 THEN stock_a ELSE stock_b END AS leader FROM s")
def lead_lag(spark, sf):
    s = L.lead_lag(aligned(spark, sf), bounded=True)
    return s.withColumns({c: r6(c) for c in ("forward", "reverse", "lead_score")})


@register("t03_daily_pair_universe", f"""WITH {ROLLING_CORR}, d AS (SELECT day, lead(day) OVER (ORDER BY day) AS trading_day FROM (SELECT DISTINCT day FROM rc)),
k AS (SELECT trading_day, stock_a, stock_b, c, row_number() OVER (PARTITION BY trading_day ORDER BY round(c, 9) DESC, stock_a, stock_b) AS rank FROM rc JOIN d USING (day) WHERE c IS NOT NULL AND trading_day IS NOT NULL)
SELECT trading_day::VARCHAR AS trading_day, stock_a, stock_b, rank, round(c, 6) AS rolling_corr, CASE WHEN a.market_cap >= b.market_cap THEN stock_a ELSE stock_b END AS leader FROM k JOIN universe a ON a.symbol = stock_a JOIN universe b ON b.symbol = stock_b WHERE rank <= 10""")
def daily_pair_universe(spark, sf):
    u = L.daily_universe(aligned(spark, sf), candidates(spark, sf), universe(spark, sf), 60, top=10, bounded=True)
    return u.select("trading_day", "stock_a", "stock_b", "rank", r6("rolling_corr").alias("rolling_corr"), "leader")


@register("w18_frame_windows", f"WITH {BARS}, f AS (SELECT symbol, ts, close, count(*) OVER w AS n, sum(close) OVER w AS s, first_value(volume) OVER w AS v FROM bars WINDOW w AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT symbol, ts::VARCHAR AS ts, close AS target, round(s, 4) AS sum_close, v::DOUBLE AS first_volume FROM f WHERE n = 10")
def frame_windows(spark, sf):
    f = R.frame_windows(bars(spark, sf), 10, ["close", "volume"], "close")
    s = F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x[0])
    return f.select("symbol", "ts", "target", r6(s, 4).alias("sum_close"), F.col("window")[0][1].alias("first_volume"))


@register("w19_temporal_split", "WITH d AS (SELECT CAST(ts AS DATE) AS day, * FROM events), k AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM d)) SELECT r <= floor(n * 0.8) AS is_train, count(*) AS n FROM d JOIN k USING (day) GROUP BY 1")
def temporal_split(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.to_date("ts"))
    return R.temporal_split(t, "day").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@register("w20_market_state_features", f"""WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({_W})) AS ret, {_rolled('avg', 'close', 5, 'm5')}, {_rolled('avg', 'volume', 20, 'v20')} FROM bars), b AS (SELECT *, {_rolled('stddev_samp', 'ret', 20, 'rv')} FROM a)
SELECT symbol, ts::VARCHAR AS ts, round(close - m5, 6) AS momentum, round(volume / v20, 6) AS rel_volume, round(high - low, 6) AS spread_proxy, round((high - low) / close, 6) AS spread_pct, round(rv, 6) AS rolling_vol FROM b""")
def market_state_features(spark, sf):
    f = R.market_state_features(bars(spark, sf))
    return f.select("symbol", "ts", *[r6(c).alias(c) for c in ("momentum", "rel_volume", "spread_proxy", "spread_pct", "rolling_vol")])


# --- indicators ------------------------------------------------------------------------

_BASE = BARS + f""", d AS (SELECT *, close - lag(close) OVER ({_W}) AS dx, high - low AS tr, (high + low + close) / 3 AS tp FROM bars),
u AS (SELECT *, CASE WHEN dx > 0 THEN dx ELSE 0 END AS up, CASE WHEN dx < 0 THEN -dx ELSE 0 END AS dn FROM d),
ind AS (SELECT *, {_rolled('avg', 'close', 10, 'sma10')}, {_rolled('avg', 'tr', 14, 'atr14')}, {_rolled('avg', 'up', 14, 'gain')}, {_rolled('avg', 'dn', 14, 'loss')},
 {_rolled('avg', 'close', 20, 'mid')}, {_rolled('stddev_samp', 'close', 20, 'sd')}, {_rolled('min', 'low', 14, 'lo')}, {_rolled('max', 'high', 14, 'hi')}, lag(close, 5) OVER ({_W}) AS c5,
 {_rolled('avg', 'tp', 20, 'tm')}, {_rolled('stddev_samp', 'tp', 20, 'tsd')}, {_rolled('avg', 'volume', 14, 'v14')} FROM u)"""


def _ind(name, which, cols, exprs):
    sql = f"WITH {_BASE} SELECT symbol, ts::VARCHAR AS ts, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in zip(cols, exprs)) + " FROM ind"

    @register(name, sql)
    def run(spark, sf):
        return I.indicators(bars(spark, sf), which).select("symbol", "ts", *[r6(c).alias(c) for c in cols])


_ind("i01_sma", ["sma"], ["sma10"], ["sma10"])
_ind("i04_range_mean", ["atr"], ["tr", "atr14"], ["tr", "atr14"])
_ind("i05_rsi", ["rsi"], ["rsi14"], ["CASE WHEN loss = 0 AND gain > 0 THEN 100 WHEN loss = 0 THEN NULL ELSE 100 - 100 / (1 + gain / loss) END"])
_ind("i06_bollinger", ["bollinger"], ["bb_mid", "bb_up", "bb_low"], ["mid", "mid + 2 * sd", "mid - 2 * sd"])
_ind("i07_stochastic", ["stochastic"], ["stoch_k"], ["100 * (close - lo) / nullif(hi - lo, 0)"])


@register("i08_momentum_cci_volume", f"WITH {_BASE} SELECT symbol, ts::VARCHAR AS ts, round(coalesce(close / c5 - 1, 0), 6) AS momentum5, round(tp, 6) AS typical, round(coalesce((tp - tm) / nullif(0.015 * tsd, 0), 0), 6) AS cci20, round(coalesce(v14, 0), 6) AS volume_sma14 FROM ind")
def momentum_cci_volume(spark, sf):
    i = I.indicators(bars(spark, sf), ["momentum", "cci", "volume"])
    i = I.fill_indicators(i, ["momentum5", "cci20", "volume_sma14"])
    return i.select("symbol", "ts", *[r6(c).alias(c) for c in ("momentum5", "typical", "cci20", "volume_sma14")])


@register("i02_sma_vs_ema", f"WITH RECURSIVE {EMA}, s AS (SELECT symbol, ts, e10, {_rolled('avg', 'close', 10, 'm')} FROM ema) SELECT symbol, ts::VARCHAR AS ts, round(e10, 6) AS ema, round(m - e10, 6) AS sma_vs_ema FROM s")
def sma_vs_ema(spark, sf):
    return I.sma_vs_ema(bars(spark, sf)).select("symbol", "ts", r6("ema").alias("ema"), r6("sma_vs_ema").alias("sma_vs_ema"))


@register("i03_macd", f"WITH RECURSIVE {EMA} SELECT symbol, ts::VARCHAR AS ts, round(e12 - e26, 6) AS macd, round(sig, 6) AS macd_signal FROM ema")
def macd(spark, sf):
    return I.macd(bars(spark, sf)).select("symbol", "ts", r6("macd").alias("macd"), r6("macd_signal").alias("macd_signal"))


ICHIMOKU = BARS + f""", l AS (SELECT *, {_rolled('max', 'high', 9, 'h9')}, {_rolled('min', 'low', 9, 'l9')}, {_rolled('max', 'high', 26, 'h26')}, {_rolled('min', 'low', 26, 'l26')}, {_rolled('max', 'high', 52, 'h52')}, {_rolled('min', 'low', 52, 'l52')} FROM bars),
m AS (SELECT *, (h9 + l9) / 2 AS tenkan, (h26 + l26) / 2 AS kijun, (h52 + l52) / 2 AS b52 FROM l),
cloud AS (SELECT *, lag((tenkan + kijun) / 2, 26) OVER ({_W}) AS span_a, lag(b52, 26) OVER ({_W}) AS span_b, lead(close, 26) OVER ({_W}) AS chikou FROM m)"""


@register("i09_ichimoku", f"WITH {ICHIMOKU} SELECT symbol, ts::VARCHAR AS ts, round(tenkan, 6) AS tenkan, round(kijun, 6) AS kijun, round(span_a, 6) AS span_a, round(span_b, 6) AS span_b, chikou FROM cloud")
def ichimoku(spark, sf):
    return I.ichimoku(bars(spark, sf)).select("symbol", "ts", *[r6(c).alias(c) for c in ("tenkan", "kijun", "span_a", "span_b")], "chikou")


@register("i10_wilder_atr", "WITH RECURSIVE " + BARS + f""", n AS (SELECT *, row_number() OVER ({_W}) AS i, lag(close) OVER ({_W}) AS pc FROM bars), t AS (SELECT symbol, ts, i, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n),
seed AS (SELECT symbol, avg(tr) AS a FROM t WHERE i <= 14 GROUP BY 1 HAVING count(*) = 14),
rec AS (SELECT t.symbol, t.ts, t.i, a FROM t JOIN seed USING (symbol) WHERE i = 14 UNION ALL SELECT t.symbol, t.ts, t.i, (a * 13 + t.tr) / 14 FROM rec JOIN t ON t.symbol = rec.symbol AND t.i = rec.i + 1)
SELECT t.symbol, t.ts::VARCHAR AS ts, round(a, 6) AS atr FROM t LEFT JOIN rec ON rec.symbol = t.symbol AND rec.i = t.i""")
def wilder_atr(spark, sf):
    return I.wilder_atr(bars(spark, sf)).select("symbol", "ts", r6("atr").alias("atr"))


SAR = BARS + """, sn AS (SELECT symbol, ts, high, low, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
sar AS (SELECT symbol, ts, i, high, low, high AS ph, low AS pl, low AS sar, high AS ep, 0.02::DOUBLE AS af, 1 AS up FROM sn WHERE i = 1
 UNION ALL SELECT symbol, ts, i, high, low, ph, pl, CASE WHEN flip THEN ep ELSE s END, CASE WHEN flip THEN (CASE WHEN up = 1 THEN low ELSE high END) WHEN up = 1 THEN greatest(ep, high) ELSE least(ep, low) END,
   CASE WHEN flip THEN 0.02 WHEN (CASE WHEN up = 1 THEN greatest(ep, high) ELSE least(ep, low) END) <> ep THEN least(af + 0.02, 0.2) ELSE af END, CASE WHEN flip THEN -up ELSE up END
 FROM (SELECT *, CASE WHEN up = 1 THEN low < s ELSE high > s END AS flip FROM (
   SELECT n.symbol, n.ts, n.i, n.high, n.low, sar.high AS ph, sar.low AS pl, ep, af, up, CASE WHEN up = 1 THEN least(sar + af * (ep - sar), sar.low, sar.pl) ELSE greatest(sar + af * (ep - sar), sar.high, sar.ph) END AS s
   FROM sar JOIN sn n ON n.symbol = sar.symbol AND n.i = sar.i + 1)))"""


@register("i10_parabolic_sar", f"WITH RECURSIVE {SAR} SELECT symbol, ts::VARCHAR AS ts, round(sar, 6) AS sar, up::DOUBLE AS up FROM sar")
def parabolic_sar(spark, sf):
    return I.parabolic_sar(bars(spark, sf)).select("symbol", "ts", r6("sar").alias("sar"), "up")


@register("j01_minute_grid_metadata", f"WITH {RAW_BARS} SELECT symbol, CAST(ts AS DATE)::VARCHAR AS day, arg_min(sector, event_id) AS sector, count(DISTINCT date_trunc('minute', ts)) AS n_minutes FROM raw_bars WHERE CAST(ts AS TIME) BETWEEN TIME '09:15:00' AND TIME '16:00:00' GROUP BY 1, 2")
def minute_grid_metadata(spark, sf):
    from tickweave.operators.select import session_filter

    raw = session_filter(raw_bars(spark, sf), "09:15", "16:00")
    g = B.resample_grid(raw, meta=["sector"], order=T_ORDER)
    return g.groupBy("symbol", "day").agg(F.max("sector").alias("sector"), F.count(F.when(F.col("transactions") > 0, 1)).alias("n_minutes"))
