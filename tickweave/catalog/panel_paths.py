"""Queries for return-panel features, probability paths and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.catalog.fixtures import PANEL, PATHS, panel, paths, r6, table
from tickweave.functions import panel as P
from tickweave.operators import panelprep as Z
from tickweave.operators import trajectory as T
from tickweave.operators.series import temporal_split
from tickweave.plans.registry import register

ORDER = ["ts", "event_id"]


def split_panel(spark, sf):
    return temporal_split(panel(spark, sf), "day")


# the last day of the training part: four fifths of the days that occur
LAST_TRAIN_DAY = "(SELECT list_sort(list(DISTINCT day))[floor(0.8 * count(DISTINCT day))::INT] FROM panel)"
TRAIN = PANEL + f""", tr AS (SELECT *, day <= {LAST_TRAIN_DAY} AS is_train FROM cells)"""


@register("q01_winsor", f"""WITH {TRAIN}, b AS (SELECT i, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM tr WHERE is_train GROUP BY 1)
SELECT tr.is_train, i AS "interval", count(x) AS n, round(sum(CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END), 8) AS total, round(max(CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END), 8) AS top FROM tr JOIN b USING (i) GROUP BY 1, 2""")
def winsor(spark, sf):
    p = split_panel(spark, sf)
    w = Z.apply_winsor(p, "r", Z.fit_winsor(p.filter("is_train"), "r"))
    long = Z.long_panel(w, "r", ["is_train"])
    return long.groupBy("is_train", F.col("interval").cast("bigint").alias("interval")).agg(F.count("value").alias("n"), r6(F.sum("value"), 8).alias("total"), r6(F.max("value"), 8).alias("top"))


_S = lambda cond: f"coalesce(sum(x) FILTER ({cond}), 0)"
_A = lambda cond: f"coalesce(sum(abs(x)) FILTER ({cond}), 0)"
_E = lambda cond: f"coalesce(sum(x * x) FILTER ({cond}), 0)"
SUMS = PANEL + f""", sums AS (SELECT id, count(x) AS n_obs, {_S('true')} AS path, {_S('i < 18')} AS early, {_S('i BETWEEN 18 AND 35')} AS middle, {_S('i >= 36')} AS late,
  {_A('true')} AS ab, {_E('true')} AS sq, {_E('i < 18')} AS sq_e, {_E('i >= 36')} AS sq_l, max(x * x) AS top, {_A('i < 26')} AS h1, {_A('i >= 26')} AS h2 FROM cells GROUP BY 1),
sgn AS (SELECT id, avg(CASE WHEN x IS NOT NULL THEN (sign(x) = sign(path))::INT END) AS persist,
  avg(CASE WHEN x IS NOT NULL AND i >= 36 THEN (sign(x) = sign(late))::INT END) AS late_same FROM cells JOIN sums USING (id) GROUP BY 1)"""


@register("q02_missingness", f"WITH {SUMS} SELECT id, n_obs, 53 - n_obs AS missing_count, round((53 - n_obs) / 53, 6) AS missing_share FROM sums")
def missingness(spark, sf):
    m = P.missingness(panel(spark, sf), "r")
    return m.select("id", "n_obs", "missing_count", r6("missing_share").alias("missing_share"))


def _features(name, cols, exprs):
    sql = f"WITH {SUMS} SELECT id, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in zip(cols, exprs)) + " FROM sums JOIN sgn USING (id)"

    @register(name, sql)
    def run(spark, sf):
        return P.path_features(panel(spark, sf), "r").select("id", *[r6(c).alias(c) for c in cols])


_features("q03_path_sums", ["path_return_bps", "abs_path_return_bps", "return_early_bps", "return_middle_bps", "return_late_bps", "early_late_change_bps"], ["path", "abs(path)", "early", "middle", "late", "late - early"])
_features("q05_realised_vol", ["realized_vol_bps", "adjusted_vol_bps"], ["sqrt(sq)", "sqrt(53.0 / n_obs * sq)"])
_features("q06_path_efficiency", ["path_efficiency"], ["CASE WHEN ab > 0 THEN abs(path) / ab ELSE 0 END"])
_features("q07_vol_shares", ["early_vol_share", "late_vol_share", "vol_concentration"], ["CASE WHEN sq > 0 THEN sq_e / sq ELSE 0 END", "CASE WHEN sq > 0 THEN sq_l / sq ELSE 0 END", "CASE WHEN sq > 0 THEN top / sq ELSE 0 END"])
_features("q08_sign_persistence", ["sign_persistence"], ["persist"])
_features("q09_path_asymmetry", ["path_asymmetry"], ["(h2 - h1) / nullif(h1 + h2, 0)"])


@register("q04_compounded_return", f"WITH {PANEL} SELECT id, round((exp(sum(ln(1 + x / 10000))) - 1) * 10000, 5) AS complete_bps FROM (SELECT id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings JOIN cells ON vec_id = id) GROUP BY 1")
def compounded_return(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 53), lambda x: x.cast("double")).alias("r"))
    return e.select("id", r6(P.compounded_return_bps("r"), 5).alias("complete_bps"))


@register("q10_reversals", f"""WITH {PANEL}, s AS (SELECT id, i, sign(x) AS s, lag(sign(x)) OVER (PARTITION BY id ORDER BY i) AS p FROM cells WHERE x IS NOT NULL AND x <> 0),
c AS (SELECT id, count(*) AS n, sum((s <> p)::INT) AS k FROM s GROUP BY 1)
SELECT p.id, coalesce(CASE WHEN n >= 2 THEN k END, 0)::BIGINT AS reversal_count, round(CASE WHEN n >= 2 THEN k / (n - 1) END, 6) AS reversal_intensity FROM panel p LEFT JOIN c USING (id)""")
def reversals(spark, sf):
    return panel(spark, sf).select("id", P.count_reversals("r").alias("reversal_count"), r6(P.reversal_intensity("r")).alias("reversal_intensity"))


@register("q11_signs_and_transition", f"""WITH {SUMS}, sh AS (SELECT id, avg((x > 0)::INT) AS pos, avg((x < 0)::INT) AS neg FROM cells WHERE x IS NOT NULL GROUP BY 1)
SELECT id, round(pos, 6) AS positive_share, round(neg, 6) AS negative_share, CASE WHEN early < 0 AND late < 0 THEN 'Neg → Neg' WHEN early < 0 AND late > 0 THEN 'Neg → Pos' WHEN early > 0 AND late < 0 THEN 'Pos → Neg' WHEN early > 0 AND late > 0 THEN 'Pos → Pos' ELSE 'Con cero' END AS transition FROM sums JOIN sh USING (id)""")
def signs_and_transition(spark, sf):
    p = P.path_features(panel(spark, sf), "r")
    return p.select("id", r6(P.sign_share("r")).alias("positive_share"), r6(P.sign_share("r", False)).alias("negative_share"), P.path_transition("return_early_bps", "return_late_bps").alias("transition"))


@register("q12_late_momentum", f"""WITH {SUMS}, l AS (SELECT id, row_number() OVER w - 1 AS t, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS y FROM cells WHERE i >= 36 AND x IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY i)), s AS (SELECT id, regr_slope(y, t) AS b FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT id, round(late_same, 6) AS late_momentum_consistency, round(b, 8) AS late_trend FROM sgn LEFT JOIN s USING (id)""")
def late_momentum(spark, sf):
    return panel(spark, sf).select("id", r6(P.late_momentum_consistency("r")).alias("late_momentum_consistency"), r6(P.late_trend("r"), 8).alias("late_trend"))


ROBUST = TRAIN + """, q AS (SELECT i, median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM tr WHERE is_train GROUP BY 1),
scaled AS (SELECT id, i, is_train, (x - m) / nullif(iqr, 0) AS z FROM tr JOIN q USING (i))"""


@register("q13_robust_scale", f"WITH {ROBUST} SELECT id, round(sum(CASE WHEN z IS NULL THEN 0 ELSE greatest(least(z, 2), -2) END), 6) AS total, count(*) FILTER (z IS NULL) AS zeros FROM scaled GROUP BY 1")
def robust_scale(spark, sf):
    p = split_panel(spark, sf)
    params = Z.fit_robust(p.filter("is_train"), "r")
    s = Z.apply_robust(p.withColumn("missing", F.size("r") - F.size(P.observed("r"))), "r", params, 2.0)
    return s.select("id", r6(P.total("r")).alias("total"), F.col("missing").cast("bigint").alias("zeros"))


@register("q14_clip_audit", f"WITH {ROBUST} SELECT count(z) AS n_values, count(*) FILTER (abs(z) > 2) AS n_clipped, round(100 * count(*) FILTER (abs(z) > 2) / count(z), 6) AS pct_clipped, round(max(abs(z)), 6) AS max_before, 2.0::DOUBLE AS max_after FROM scaled")
def clip_audit(spark, sf):
    p = split_panel(spark, sf)
    a = Z.clip_audit(Z.scale_robust(p, "r", Z.fit_robust(p.filter("is_train"), "r")), "r", 2.0)
    return a.withColumns({"pct_clipped": r6("pct_clipped"), "max_before": r6("max_before")})


_EXT = PANEL + ", t AS (SELECT quantile_cont(abs(x), 0.99) AS t FROM cells), ex AS (SELECT cells.* FROM cells, t WHERE abs(x) > t)"


@register("q14_extreme_concentration", f"WITH {_EXT} SELECT (SELECT count(*) FROM ex) AS n_extreme, round(100 * (SELECT count(DISTINCT equity) FROM ex) / (SELECT count(DISTINCT equity) FROM panel), 6) AS pct_equity, round(100 * (SELECT count(DISTINCT day) FROM ex) / (SELECT count(DISTINCT day) FROM panel), 6) AS pct_day, round(100 * (SELECT count(DISTINCT id) FROM ex) / (SELECT count(DISTINCT id) FROM panel), 6) AS pct_id")
def extreme_concentration(spark, sf):
    c = Z.extreme_concentration(panel(spark, sf), "r", ["equity", "day", "id"], 0.99)
    return c.select("n_extreme", *[r6(x).alias(x) for x in c.columns[1:]])


@register("q14_extremes_by_interval", f"WITH {_EXT} SELECT i AS \"interval\", count(*) FILTER (abs(x) > t) AS n_extreme FROM cells, t GROUP BY 1")
def extremes_by_interval(spark, sf):
    return Z.extremes_by(panel(spark, sf), "r", ["id"], "interval", 0.99).withColumn("interval", F.col("interval").cast("bigint"))


_EDGES = SUMS + ", e AS (SELECT list_sort(list_distinct(quantile_cont(vol, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM (SELECT sqrt(sq) AS vol FROM sums))"


@register("q15_quantile_buckets", f"WITH {_EDGES} SELECT id, greatest(len(list_filter(e, lambda y: y < sqrt(sq))) - 1, 0) AS bucket FROM sums, e")
def quantile_buckets(spark, sf):
    p = P.path_features(panel(spark, sf), "r").select("id", F.col("realized_vol_bps").alias("vol"))
    return Z.bucket(p, "vol", Z.fit_edges(p, "vol", [0, 0.2, 0.4, 0.6, 0.8, 1]), "bucket").select("id", "bucket")


@register("q15_train_edge_buckets", f"""WITH {SUMS}, v AS (SELECT id, day, sqrt(sq) AS vol FROM sums JOIN panel USING (id)), e AS (SELECT list_sort(list_distinct(quantile_cont(vol, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM v WHERE day <= {LAST_TRAIN_DAY})
SELECT id, least(greatest(len(list_filter(e, lambda y: y < vol)) - 1, 0), len(e) - 2) AS bucket FROM v, e""")
def train_edge_buckets(spark, sf):
    p = P.path_features(split_panel(spark, sf), "r").select("id", "is_train", F.col("realized_vol_bps").alias("vol"))
    edges = Z.fit_edges(p.filter("is_train"), "vol", [0, 0.2, 0.4, 0.6, 0.8, 1])
    return Z.bucket(p, "vol", edges, "bucket", open_ends=True).select("id", "bucket")


@register("q16_two_way_surface", f"""WITH {SUMS}, v AS (SELECT id, reod, sqrt(sq) AS vol, ab FROM sums JOIN panel USING (id)),
ev AS (SELECT list_sort(list_distinct(quantile_cont(vol, [0, 0.25, 0.5, 0.75, 1]))) AS ev, list_sort(list_distinct(quantile_cont(ab, [0, 0.25, 0.5, 0.75, 1]))) AS ea FROM v),
b AS (SELECT (reod <> 0)::INT AS d, greatest(len(list_filter(ev, lambda y: y < vol)) - 1, 0) AS bx, greatest(len(list_filter(ea, lambda y: y < ab)) - 1, 0) AS b_abs FROM v, ev)
SELECT bx AS b_vol, """ + ", ".join(f"round(avg(d) FILTER (b_abs = {k}), 6) AS b_abs_{k}" for k in range(4)) + " FROM b GROUP BY 1")
def two_way_surface(spark, sf):
    p = P.path_features(panel(spark, sf), "r").select("reod", F.col("realized_vol_bps").alias("vol"), P.total("r", F.abs).alias("ab"))
    qs = [0, 0.25, 0.5, 0.75, 1]
    b = Z.bucket(Z.bucket(p, "vol", Z.fit_edges(p, "vol", qs), "b_vol"), "ab", Z.fit_edges(p, "ab", qs), "b_abs")
    s = Z.surface(b, "b_vol", "b_abs", (F.col("reod") != 0).cast("double"), range(4))
    return s.select("b_vol", *[r6(c).alias(c) for c in s.columns[1:]])


# --- probability paths --------------------------------------------------------------------

STEPS = PATHS + """, d0 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY market_id) AS n, p - lag(p) OVER w AS d, max(p) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM paths WINDOW w AS (PARTITION BY market_id ORDER BY ts, event_id)),
d1 AS (SELECT *, lag(d) OVER w AS pd FROM d0 WINDOW w AS (PARTITION BY market_id ORDER BY pos)),
nz AS (SELECT market_id, pos, (sign(d) <> lag(sign(d)) OVER (PARTITION BY market_id ORDER BY pos))::INT AS flip FROM d0 WHERE d <> 0),
steps AS (SELECT d1.*, coalesce((sign(d) <> sign(pd))::INT, 0) AS fz, coalesce(flip, 0) AS flip FROM d1 LEFT JOIN nz USING (market_id, pos))"""


def _hist(source, keys):
    return f"""lim AS (SELECT {keys}, min(d) AS lo, max(d) AS hi, count(d) AS m FROM {source} GROUP BY ALL),
hb AS (SELECT {keys}, CASE WHEN hi > lo THEN least(floor((d - lo) / (hi - lo) * 10), 9) ELSE 0 END AS b, any_value(m) AS m, count(*) AS c FROM {source} JOIN lim USING ({keys}) WHERE d IS NOT NULL GROUP BY ALL),
ent AS (SELECT {keys}, CASE WHEN max(m) >= 10 THEN sum(-(c / m) * ln(c / m)) END AS h FROM hb GROUP BY ALL)"""


_CORE = "round(max(p) - min(p), 6) AS {0}probability_range, round(regr_slope(p, pos), 8) AS {0}trend, round(max((peak - p) / nullif(peak, 0)), 6) AS {0}max_drawdown"
_SIGN_H = "(SELECT coalesce(-sum(x * ln(x)), 0) FROM (SELECT unnest([count(*) FILTER (d > 0) / nullif(count(*) FILTER (d <> 0), 0), count(*) FILTER (d < 0) / nullif(count(*) FILTER (d <> 0), 0)]) AS x) WHERE x > 0)"


def _round(df, skip=("market_id", "horizon", "n_obs", "early_n_obs", "reversals", "early_reversals", "early_near_boundary")):
    return df.select(*[F.col(c) if c in skip else r6(c, 8 if "trend" in c else 6).alias(c) for c in df.columns])


@register("q17_trajectory_features_a", f"""WITH {STEPS}, {_hist('steps', 'market_id')}, mo AS (SELECT market_id, avg(d) AS mu FROM steps GROUP BY 1),
c AS (SELECT market_id, avg(pow(d - mu, 2)) AS m2, avg(pow(d - mu, 3)) AS m3, avg(pow(d - mu, 4)) AS m4 FROM steps JOIN mo USING (market_id) WHERE d IS NOT NULL GROUP BY 1),
f AS (SELECT market_id, count(p) AS n_obs, {_CORE.format('')}, round(sum(d * d), 6) AS realized_volatility, sum(fz)::BIGINT AS reversals, round(CASE WHEN count(d) >= 10 THEN corr(d, pd) END, 6) AS autocorrelation FROM steps GROUP BY 1)
SELECT f.*, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, round(h, 6) AS shannon_entropy FROM f LEFT JOIN c USING (market_id) LEFT JOIN ent USING (market_id)""")
def trajectory_features_a(spark, sf):
    return _round(T.trajectory_features(paths(spark, sf), ["market_id"], ORDER, "a"))


_SIGN_COUNTS = "count(*) FILTER (d > 0) AS nu, count(*) FILTER (d < 0) AS nd"
_SIGN_ENT = "round(CASE WHEN nu > 0 THEN -(nu / (nu + nd)) * ln(nu / (nu + nd)) ELSE 0 END + CASE WHEN nd > 0 THEN -(nd / (nu + nd)) * ln(nd / (nu + nd)) ELSE 0 END, 6)"


@register("q17_trajectory_features_b", f"""WITH {STEPS}, f AS (SELECT market_id, count(p) AS n_obs, {_CORE.format('')}, round(coalesce(stddev_samp(d), 0), 6) AS realized_volatility, sum(flip)::BIGINT AS reversals, {_SIGN_COUNTS} FROM steps GROUP BY 1)
SELECT * EXCLUDE (nu, nd), {_SIGN_ENT} AS entropy FROM f""")
def trajectory_features_b(spark, sf):
    return _round(T.trajectory_features(paths(spark, sf), ["market_id"], ORDER, "b"))


_H = "(SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS horizon)"


@register("q21_early_features_a", f"""WITH {STEPS}, part AS (SELECT * FROM steps, {_H} WHERE pos < greatest(floor(n * horizon), 5)), {_hist('part', 'market_id, horizon')},
f AS (SELECT market_id, horizon, {_CORE.format('early_')}, round(sum(d * d), 6) AS early_realized_volatility, sum(fz)::BIGINT AS early_reversals FROM part GROUP BY 1, 2)
SELECT f.*, round(h, 6) AS early_entropy FROM f LEFT JOIN ent USING (market_id, horizon)""")
def early_features_a(spark, sf):
    return _round(T.early_features(paths(spark, sf), [0.25, 0.5, 0.75], "a", ["market_id"], ORDER))


@register("q22_early_features_b", f"""WITH {STEPS}, part AS (SELECT * FROM steps, {_H} WHERE pos < greatest(ceil(n * horizon), 2)),
f AS (SELECT market_id, horizon, count(p) AS early_n_obs, {_CORE.format('early_')}, round(coalesce(stddev_samp(d), 0), 6) AS early_realized_volatility, sum(flip)::BIGINT AS early_reversals, {_SIGN_COUNTS},
 arg_min(p, pos) AS fp, arg_max(p, pos) AS lp, round(avg(p), 6) AS early_mean_probability, round(stddev_samp(p), 6) AS early_std_probability, round(avg(least(p, 1 - p)), 6) AS early_mean_distance_to_boundary, round(min(least(p, 1 - p)), 6) AS early_min_distance_to_boundary FROM part GROUP BY 1, 2)
SELECT * EXCLUDE (nu, nd, fp, lp), {_SIGN_ENT} AS early_entropy, round(fp, 6) AS early_first_probability, round(lp, 6) AS early_last_probability, round(least(lp, 1 - lp), 6) AS early_distance_to_boundary, (lp <= 0.05 OR lp >= 0.95)::INT AS early_near_boundary FROM f""")
def early_features_b(spark, sf):
    return _round(T.early_features(paths(spark, sf), [0.25, 0.5, 0.75], "b", ["market_id"], ORDER))


@register("q24_activity_stats", """WITH g AS (SELECT user_id, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT user_id, date_trunc('second', ts) AS s, count(*) AS c FROM events GROUP BY 1, 2), b AS (SELECT user_id, max(c) AS max_per_second, round(avg(c), 6) AS mean_per_second, count(*) AS active_seconds FROM s GROUP BY 1)
SELECT user_id, round(min(gap), 3) AS min_gap, round(avg(gap), 3) AS mean_gap, round(max(gap), 3) AS max_gap, """ + ", ".join(f"round(quantile_cont(gap, {q}), 3) AS {n}_gap" for n, q in T.ACTIVITY_QS.items()) + ", any_value(max_per_second) AS max_per_second, any_value(mean_per_second) AS mean_per_second, any_value(active_seconds) AS active_seconds FROM g JOIN b USING (user_id) GROUP BY 1")
def activity_stats(spark, sf):
    a = T.activity_stats(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", ORDER)
    return a.select("user_id", *[r6(c, 3).alias(c) for c in a.columns if c.endswith("_gap")], "max_per_second", r6("mean_per_second").alias("mean_per_second"), "active_seconds")
