"""Queries for execution, portfolio and calibration analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import BARS, DAILY, MARKETS, bars, daily, markets, r6, table
from tickweave.operators import calibration as C
from tickweave.operators import execution as E
from tickweave.operators import portfolio as O
from tickweave.operators.series import returns
from tickweave.plans.registry import register
from tickweave.plans.spread import dealt
from tickweave.session import cut


def orders(spark, sf):
    """Parent orders from the order table: quantity by price, 5 to 14 slices."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("order_id"), (F.sqrt("o_totalprice") * 100).alias("quantity"), F.lit(1.0).alias("horizon"), (5 + k % 10).cast("int").alias("slices"),
        F.lit(0.3).alias("sigma"), F.lit(0.05).alias("eta"), ((k % 7) / 10.0).alias("risk_aversion"))


ORD = """o AS (SELECT o_orderkey AS order_id, sqrt(o_totalprice) * 100 AS q, 1.0::DOUBLE AS h, (5 + o_orderkey % 10)::INT AS n, 0.3::DOUBLE AS sigma, 0.05::DOUBLE AS eta, (o_orderkey % 7) / 10.0::DOUBLE AS lam FROM orders),
sl AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM o)"""
_INV = "CASE WHEN lam < 1e-12 THEN q * (1 - ({t}) / h) ELSE q * sinh(sqrt(lam * sigma * sigma / eta) * (h - ({t}))) / sinh(sqrt(lam * sigma * sigma / eta) * h) END"
AC = ORD + f", ac AS (SELECT order_id, k, q, n, sigma, eta, h / n AS tau, {_INV.format(t='k * h / n')} AS inv, {_INV.format(t='(k - 1) * h / n')} - {_INV.format(t='k * h / n')} AS shares FROM sl)"


def profile(spark, sf):
    o = orders(spark, sf)
    return o.select("order_id", F.explode(F.sequence(F.lit(1), F.col("slices"))).alias("slice_idx")).withColumn("volume", 1 + (F.col("order_id") + 3 * F.col("slice_idx")) % 11)


VW = ORD + ", vp AS (SELECT *, 1 + (order_id + 3 * k) % 11 AS v FROM sl), vw AS (SELECT *, q * v / sum(v) OVER (PARTITION BY order_id) AS shares FROM vp)"


@register("x01_vwap", f"WITH {BARS} SELECT symbol, round(sum(close * volume) / sum(volume), 6) AS vwap FROM bars GROUP BY 1")
def vwap(spark, sf):
    return E.vwap(bars(spark, sf)).withColumn("vwap", r6("vwap"))


@register("x02_twap", f"WITH {ORD} SELECT order_id, k AS slice_idx, round(k * h / n, 6) AS t, round(q / n, 4) AS shares, round(q * (1 - k / n), 4) AS inventory FROM sl")
def twap(spark, sf):
    return E.twap(orders(spark, sf)).withColumns({"t": r6("t"), "shares": r6("shares", 4), "inventory": r6("inventory", 4)})


@register("x03_vwap_schedule", f"WITH {VW} SELECT order_id, k AS slice_idx, round(shares, 4) AS shares, round(abs(q - sum(shares) OVER (PARTITION BY order_id ORDER BY k)), 3) AS inventory FROM vw")
def vwap_schedule(spark, sf):
    s = E.vwap_schedule(orders(spark, sf), profile(spark, sf))
    return s.withColumns({"shares": r6("shares", 4), "inventory": r6(F.abs("inventory"), 3)})


@register("x04_risk_averse_schedule", f"WITH {AC} SELECT order_id, k AS slice_idx, round(shares, 4) AS shares, round(abs(inv), 4) AS inventory FROM ac")
def risk_averse_schedule(spark, sf):
    return E.ac_schedule(orders(spark, sf)).select("order_id", "slice_idx", r6("shares", 4).alias("shares"), r6(F.abs("inventory"), 4).alias("inventory"))


_BLEND = f"""WITH {AC}, vp AS (SELECT *, 1 + (order_id + 3 * k) % 11 AS v FROM sl), vw AS (SELECT order_id, k, q * v / sum(v) OVER (PARTITION BY order_id) AS vs FROM vp),
raw AS (SELECT ac.order_id, ac.k, al::DOUBLE AS alpha, al * shares + (1 - al) * vs AS x, shares FROM ac JOIN vw ON vw.order_id = ac.order_id AND vw.k = ac.k, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS al)),
bl AS (SELECT order_id, k, alpha, x * sum(shares) OVER w / sum(x) OVER w AS shares FROM raw WINDOW w AS (PARTITION BY order_id, alpha))"""


@register("x05_blended_schedule", _BLEND + " SELECT order_id, alpha, k AS slice_idx, round(shares, 4) AS shares FROM bl")
def blended_schedule(spark, sf):
    o = orders(spark, sf)
    b = E.blend(E.ac_schedule(o), E.vwap_schedule(o, profile(spark, sf)), [0.0, 0.5, 1.0])
    return b.withColumn("shares", r6("shares", 4))


@register("x06_inventory", f"WITH {VW} SELECT order_id, k AS slice_idx, round(abs(sum(shares) OVER (PARTITION BY order_id) - sum(shares) OVER (PARTITION BY order_id ORDER BY k)), 3) AS inventory FROM vw UNION ALL SELECT order_id, 0, round(q, 3) FROM o")
def inventory(spark, sf):
    i = E.inventory(E.vwap_schedule(orders(spark, sf), profile(spark, sf)))
    return i.withColumn("inventory", r6(F.abs("inventory"), 3))


FILLS = VW + ", fl AS (SELECT order_id, k, shares, 100 + k + 1e-6 * coalesce(sum(shares) OVER (PARTITION BY order_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1e-5 * shares / 0.1 AS price FROM vw)"


def fills(spark, sf):
    s = E.vwap_schedule(orders(spark, sf), profile(spark, sf)).select("order_id", "slice_idx", "shares")
    mids = profile(spark, sf).select("order_id", "slice_idx", (100.0 + F.col("slice_idx")).alias("mid"))
    return E.impact_prices(s, mids, 1e-6, 1e-5, 0.1)


@register("x07_impact_prices", f"WITH {FILLS} SELECT order_id, k AS slice_idx, round(price, 6) AS price FROM fl")
def impact_prices(spark, sf):
    return fills(spark, sf).select("order_id", "slice_idx", r6("price").alias("price"))


@register("x08_shortfall", f"WITH {FILLS} SELECT order_id, round(sum(shares * (price - 100)), 2) AS shortfall, round(sum(shares * price) / sum(shares), 6) AS avg_price, round(sum(shares * (price - 100)) / sum(shares), 6) AS shortfall_per_share FROM fl GROUP BY 1")
def shortfall(spark, sf):
    s = E.shortfall(fills(spark, sf).withColumn("arrival", F.lit(100.0)))
    return s.withColumns({"shortfall": r6("shortfall", 2), "avg_price": r6("avg_price"), "shortfall_per_share": r6("shortfall_per_share")})


@register("x09_timing_risk", f"WITH {AC} SELECT order_id, round(max(sigma) * sqrt(max(tau) * sum(inv * inv)), 3) AS timing_risk FROM ac GROUP BY 1")
def timing_risk(spark, sf):
    o = orders(spark, sf).withColumn("tau", F.col("horizon") / F.col("slices"))
    # slices of an order are made where its risk is summed, and carry what they need of it
    path = E.ac_schedule(dealt(o, o.agg(F.coalesce(F.sum("slices"), F.lit(0))).first()[0], "order_id"), keep=["sigma", "tau"])
    return E.timing_risk(path, ["order_id"]).withColumn("timing_risk", r6("timing_risk", 3))


_LAM = [0.0, 0.05, 0.1, 0.2, 0.4]


@register("x09_calibrate", f"""WITH o AS (SELECT o_orderkey AS order_id, sqrt(o_totalprice) * 100 AS q, 1.0::DOUBLE AS h, (5 + o_orderkey % 10)::INT AS n, 0.3::DOUBLE AS sigma, 0.05::DOUBLE AS eta, unnest({_LAM})::DOUBLE AS lam FROM orders), sl AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM o),
ac AS (SELECT order_id, lam, q, n, sigma, eta, h / n AS tau, {_INV.format(t='k * h / n')} AS inv, {_INV.format(t='(k - 1) * h / n')} - {_INV.format(t='k * h / n')} AS shares FROM sl),
sc AS (SELECT order_id, lam, sum(eta * shares * shares / tau) AS cost, max(sigma) * sqrt(max(tau) * sum(inv * inv)) AS risk, max(eta * q * q / n / tau) AS even FROM ac GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY risk, lam) AS rn FROM sc WHERE cost <= 1.02 * even) SELECT order_id, lam AS risk_aversion, round(cost / even, 6) AS cost_ratio, round(risk, 3) AS timing_risk FROM b WHERE rn = 1""")
def calibrate(spark, sf):
    c = E.calibrate(orders(spark, sf), _LAM)
    return c.select("order_id", "risk_aversion", r6(F.col("cost") / F.col("even_cost")).alias("cost_ratio"), r6("timing_risk", 3).alias("timing_risk"))


@register("x10_volume_profile", f"WITH {BARS} SELECT symbol, ts::VARCHAR AS ts, round(volume / sum(volume) OVER (PARTITION BY symbol), 8) AS weight FROM bars")
def volume_profile(spark, sf):
    return E.volume_profile(bars(spark, sf)).select("symbol", "ts", r6("weight", 8).alias("weight"))


@register("x10_volatility", f"WITH {BARS}, d AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, round(stddev_samp(ln(close / p)), 6) AS sigma_return, round(stddev_samp(close - p), 6) AS sigma_price FROM d GROUP BY 1")
def volatility(spark, sf):
    return E.volatility(bars(spark, sf)).withColumns({"sigma_return": r6("sigma_return"), "sigma_price": r6("sigma_price")})


# --- portfolio: the regions are the assets ---------------------------------------------------



def region_prices(spark, sf):
    d = daily(spark, sf).groupBy(F.col("sector").alias("symbol"), "ts")
    return d.agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("close"))


RETURNS = DAILY + """, rp AS (SELECT sector AS symbol, ts, sum(close * volume) / sum(volume) AS close FROM daily GROUP BY 1, 2),
r0 AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM rp),
r1 AS (SELECT * FROM r0 WHERE ret IS NOT NULL), rets AS (SELECT * FROM r1 WHERE ts IN (SELECT ts FROM r1 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM rp))),
cov AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS c FROM rets x JOIN rets y USING (ts) GROUP BY 1, 2), mu AS (SELECT symbol, avg(ret) AS m FROM rets GROUP BY 1)"""


def region_returns(spark, sf):
    return O.return_panel(region_prices(spark, sf), bounded=True)


@register("o01_return_panel", f"WITH {RETURNS} SELECT symbol, ts::VARCHAR AS ts, round(ret, 6) AS ret FROM rets")
def return_panel(spark, sf):
    return region_returns(spark, sf).select("symbol", "ts", r6("ret").alias("ret"))


@register("o02_covariance", f"WITH {RETURNS} SELECT a, b, round(c, 8) AS cov FROM cov")
def covariance(spark, sf):
    return O.covariance(region_returns(spark, sf)).withColumn("cov", r6("cov", 8))


@register("o02_covariance_all_symbols", f"""WITH {DAILY}, r0 AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM daily)
SELECT x.symbol AS a, y.symbol AS b, round(covar_samp(x.ret, y.ret), 8) AS cov FROM r0 x JOIN r0 y USING (ts) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""")
def covariance_all_symbols(spark, sf):
    d = daily(spark, sf)
    return O.covariance(returns(d, "simple", "close", ["symbol"], ["ts"], bounded=True)).withColumn("cov", r6("cov", 8))


def weights(spark, sf):
    """One candidate per supplier, weights from its key."""
    regions = table(spark, sf, "region").agg(F.sort_array(F.collect_set("r_name"))).scalar()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("candidate"), F.posexplode(regions).alias("i", "symbol"))
    return O.normalise_weights(s.select("candidate", "symbol", ((F.col("candidate") * 7919 + F.col("i") * 104729) % 10007).cast("double").alias("weight")))


SCORES = RETURNS + """, w0 AS (SELECT s_suppkey AS candidate, a.symbol, ((s_suppkey * 7919 + a.i * 104729) % 10007)::DOUBLE AS w FROM supplier, (SELECT r_name AS symbol, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region) a),
w AS (SELECT candidate, symbol, w / sum(w) OVER (PARTITION BY candidate) AS w FROM w0),
pr AS (SELECT candidate, sum(w * m) * 252 AS r FROM w JOIN mu USING (symbol) GROUP BY 1), pv AS (SELECT x.candidate, sqrt(sum(x.w * y.w * c) * 252) AS s FROM w x JOIN w y ON x.candidate = y.candidate JOIN cov ON cov.a = x.symbol AND cov.b = y.symbol GROUP BY 1), sc AS (SELECT candidate, r, s, (r - 0.05) / s AS sharpe FROM pr JOIN pv USING (candidate))"""


def scores(spark, sf, **kw):
    rets = cut(region_returns(spark, sf))
    return O.score_portfolios(weights(spark, sf), O.mean_returns(rets), O.covariance(rets), 0.05, **kw)


@register("o03_portfolio_scores", f"WITH {SCORES} SELECT candidate, round(r, 5) AS portfolio_return, round(s, 5) AS portfolio_risk, round(sharpe, 5) AS sharpe FROM sc")
def portfolio_scores(spark, sf):
    return scores(spark, sf).withColumns({c: r6(c, 5) for c in ("portfolio_return", "portfolio_risk", "sharpe")})


@register("o04_best_portfolio", f"WITH {SCORES} SELECT candidate, round(r, 5) AS portfolio_return, round(s, 5) AS portfolio_risk, round(sharpe, 5) AS sharpe FROM sc ORDER BY round(sharpe, 10) DESC, candidate LIMIT 1")
def best_portfolio(spark, sf):
    b = O.best_portfolio(scores(spark, sf))
    return b.withColumns({c: r6(c, 5) for c in ("portfolio_return", "portfolio_risk", "sharpe")})


# --- calibration ------------------------------------------------------------------------------

_BIN = "CASE WHEN {p} BETWEEN 0 AND 1 THEN " + " + ".join(f"({{p}} > {e!r})::INT" for e in C.EDGES[1:-1]) + " END"
# mean probabilities fill more bins than final ones
CAL = MARKETS + f""", sq AS (SELECT market_id, outcome, pow(mean_probability, 20) AS p FROM markets), bi AS (SELECT *, {_BIN.format(p='p')} AS bin FROM sq),
tab AS (SELECT b.bin::INT AS bin, count(p) AS n, avg(p) AS mp, avg(outcome) AS obs, coalesce(sum(outcome), 0)::BIGINT AS s FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN bi ON bi.bin = b.bin GROUP BY 1),
priced AS (SELECT market_id, outcome, p, (1.0 + s) / (n + 2) AS fair FROM bi JOIN tab USING (bin))"""


def spread_markets(spark, sf):
    return markets(spark, sf).select("market_id", "outcome", F.pow("mean_probability", F.lit(20.0)).alias("p"))


def curve(m):
    return C.beta_fair_value(C.calibration_table(m, "p", "outcome"))


@register("c01_brier", f"WITH {CAL} SELECT round(avg(pow(p - outcome, 2)), 6) AS brier FROM sq")
def brier(spark, sf):
    return C.brier(spread_markets(spark, sf), "p", "outcome").withColumn("brier", r6("brier"))


@register("c02_probability_bins", f"WITH l AS (SELECT l_discount * 10 AS p FROM lineitem) SELECT {_BIN.format(p='p')} AS bin, count(*) AS n FROM l GROUP BY 1")
def probability_bins(spark, sf):
    line = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("p"))
    return C.bin_probability(line, "p").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@register("c03_calibration_table", f"WITH {CAL} SELECT bin, n, round(mp, 6) AS mean_probability, round(obs, 6) AS observed_rate, s AS successes, round(obs - mp, 6) AS gap FROM tab")
def calibration_table(spark, sf):
    t = C.calibration_table(spread_markets(spark, sf), "p", "outcome")
    return t.withColumns({c: r6(c) for c in ("mean_probability", "observed_rate", "gap")})


@register("c04_ece", f"WITH {CAL} SELECT round(sum(n * abs(obs - mp)) / sum(n), 6) AS ece FROM tab")
def ece(spark, sf):
    return C.ece(C.calibration_table(spread_markets(spark, sf), "p", "outcome")).withColumn("ece", r6("ece"))


@register("c05_beta_fair_value", f"WITH {CAL} SELECT bin, round((1.0 + s) / (n + 2), 6) AS fair FROM tab")
def beta_fair_value(spark, sf):
    return curve(spread_markets(spark, sf)).select("bin", r6("fair").alias("fair"))


@register("c06_mispricing", f"WITH {CAL} SELECT market_id, round(fair, 6) AS bayesian_fair_probability, round(fair - p, 6) AS mispricing, round(abs(fair - p), 6) AS abs_mispricing FROM priced")
def mispricing(spark, sf):
    m = spread_markets(spark, sf)
    p = C.mispricing(m, curve(m), "p")
    return p.select("market_id", *[r6(c).alias(c) for c in ("bayesian_fair_probability", "mispricing", "abs_mispricing")])


@register("c06_brier_improvement", f"WITH {CAL}, s AS (SELECT avg(pow(p - outcome, 2)) AS a, avg(pow(fair - outcome, 2)) AS b FROM priced) SELECT round(a, 6) AS brier_market, round(b, 6) AS brier_fair, round((a - b) / a * 100, 4) AS improvement_pct FROM s")
def brier_improvement(spark, sf):
    m = spread_markets(spark, sf)
    s = C.brier_improvement(C.mispricing(m, curve(m), "p"), "p", "bayesian_fair_probability", "outcome")
    return s.withColumns({"brier_market": r6("brier_market"), "brier_fair": r6("brier_fair"), "improvement_pct": r6("improvement_pct", 4)})


@register("j11_apply_curve", f"WITH {CAL} SELECT market_id, round(fair, 6) AS bayesian_fair_probability FROM priced")
def apply_curve(spark, sf):
    m = spread_markets(spark, sf)
    return C.apply_curve(m, curve(m), "p").select("market_id", r6("bayesian_fair_probability").alias("bayesian_fair_probability"))


@register("c07_efficient_label", f"WITH {CAL} SELECT market_id, (abs(outcome - p) <= (SELECT median(abs(outcome - p)) FROM sq))::INT AS efficient_market FROM sq")
def efficient_label(spark, sf):
    m = spread_markets(spark, sf).withColumn("abs_surprise", F.abs(F.col("outcome") - F.col("p")))
    return C.efficient_label(m).select("market_id", "efficient_market")


@register("c08_median_split", "WITH h AS (SELECT l_extendedprice > (SELECT median(l_extendedprice) FROM lineitem) AS high, l_quantity AS y FROM lineitem) SELECT high, count(y) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median FROM h GROUP BY 1")
def median_split(spark, sf):
    m = C.median_split(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return m.withColumns({"mean": r6("mean"), "median": r6("median")})
