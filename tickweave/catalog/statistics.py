"""Queries for tests, resampling and data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.catalog.fixtures import BARS, PANEL, TICKS, bars, panel, r6, table, ticks, universe
from tickweave.catalog.panel_paths import LAST_TRAIN_DAY, TRAIN, split_panel
from tickweave.catalog.tables import RETS, aligned, candidates
from tickweave.operators import audit as D
from tickweave.operators import bars as B
from tickweave.operators import joins as J
from tickweave.operators import stats as H
from tickweave.plans.registry import register
from tickweave.plans.spread import permuted_sql, round_draws_sql

_U = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@register("h01_welch", """WITH m AS (SELECT count(*) FILTER (g) AS n1, avg(y) FILTER (g) AS m1, var_samp(y) FILTER (g) AS v1, count(*) FILTER (NOT g) AS n0, avg(y) FILTER (NOT g) AS m0, var_samp(y) FILTER (NOT g) AS v0 FROM (SELECT l_returnflag = 'R' AS g, l_extendedprice AS y FROM lineitem))
SELECT round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS statistic, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 4) AS df FROM m""")
def welch(spark, sf):
    line = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("g"), F.col("l_extendedprice").alias("y"))
    return H.welch(line, "g", "y").select(r6("statistic").alias("statistic"), r6("df", 4).alias("df"))


@register("h02_mann_whitney", """WITH r AS (SELECT l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity)),
s AS (SELECT sum(rk) FILTER (g)::DOUBLE AS r1, count(*) FILTER (g)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM r), u AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n0, n, ties FROM s, t)
SELECT u, round(greatest((greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0), 6) AS z FROM u""")
def mann_whitney(spark, sf):
    line = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("g"), F.col("l_quantity").alias("y"))
    return H.mann_whitney(line, "g", "y").select("u", r6("z").alias("z"))


PERM = RETS + f""", base AS (SELECT stock_a, stock_b, x_b, row_number() OVER w - 1 AS pos, lag(x_a) OVER w AS xp, lead(x_a) OVER w AS xn FROM aligned WINDOW w AS (PARTITION BY stock_a, stock_b ORDER BY ts)),
rep AS (SELECT b, {round_draws_sql("b", 42)} AS d FROM (SELECT unnest(range(1, 11)) AS b)),
src AS (SELECT stock_a, stock_b, x_b, pos AS place, n, b, d FROM (SELECT *, count(*) OVER (PARTITION BY stock_a, stock_b) AS n FROM base), rep),
walk AS ({permuted_sql("stock_a, stock_b, x_b", "src")}), mv AS (SELECT *, p AS pos FROM walk WHERE p < n),
nul AS (SELECT stock_a, stock_b, b, corr(xp, mv.x_b) - corr(xn, mv.x_b) AS s FROM mv JOIN base USING (stock_a, stock_b, pos) GROUP BY 1, 2, 3),
rl AS (SELECT stock_a, stock_b, count(*) AS n_obs, corr(xp, x_b) - corr(xn, x_b) AS lead_score FROM base GROUP BY 1, 2),
perm AS (SELECT stock_a, stock_b, any_value(lead_score) AS lead_score, any_value(n_obs) AS n_obs, avg(s) AS random_mean, stddev_pop(s) AS random_std, avg((abs(s) >= abs(lead_score))::INT) AS p_value FROM nul JOIN rl USING (stock_a, stock_b) GROUP BY 1, 2)"""


def permuted(spark, sf):
    return H.permutation_lead_score(aligned(spark, sf), 1, 10, bounded=True)


@register("h03_permutation_lead_score", f"WITH RECURSIVE {PERM} SELECT stock_a, stock_b, round(lead_score, 6) AS lead_score, n_obs, round(random_mean, 6) AS random_mean, round(random_std, 6) AS random_std, round(p_value, 6) AS p_value FROM perm")
def permutation_lead_score(spark, sf):
    return permuted(spark, sf).withColumns({c: r6(c) for c in ("lead_score", "random_mean", "random_std", "p_value")})


@register("h04_subset_bootstrap", f"""WITH RECURSIVE rep AS (SELECT b, {round_draws_sql("b")} AS d FROM (SELECT unnest(range(1, 31)) AS b)),
src AS (SELECT y0, place, n, b, d FROM (SELECT c_acctbal AS y0, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer), rep),
walk AS ({permuted_sql("y0", "src")}), m AS (SELECT b, avg(y0) AS mean FROM walk WHERE p < least(n, 50) GROUP BY 1) SELECT round(avg(mean), 4) AS bootstrap_mean, round(stddev_pop(mean), 4) AS bootstrap_std, round(avg((mean < 4600)::INT), 6) AS percentile FROM m""")
def subset_bootstrap(spark, sf):
    m = H.subset_bootstrap(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 50, 30)
    return H.bootstrap_percentile(m, 4600).withColumns({"bootstrap_mean": r6("bootstrap_mean", 4), "bootstrap_std": r6("bootstrap_std", 4), "percentile": r6("percentile")})


@register("h05_bootstrap_corr", f"""WITH base AS (SELECT o_orderstatus, c_acctbal AS x, o_totalprice AS y, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
pt AS (SELECT o_orderstatus, b, {_U.format("'0-' || b || '-' || pos")} % n AS pos FROM base, (SELECT unnest(range(1, 41)) AS b)), c AS (SELECT o_orderstatus, b, corr(x, y) AS r FROM pt JOIN base USING (o_orderstatus, pos) GROUP BY 1, 2)
SELECT o_orderstatus, round(quantile_cont(r, 0.025), 6) AS lower, round(quantile_cont(r, 0.975), 6) AS upper FROM c GROUP BY 1""")
def bootstrap_corr(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("o_orderstatus", "o_orderkey", "c_acctbal", "o_totalprice")
    out = H.bootstrap_corr(j, "c_acctbal", "o_totalprice", ["o_orderkey"], 40, keys=["o_orderstatus"])
    return out.withColumns({"lower": r6("lower"), "upper": r6("upper")})


@register("h06_ols_single", "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem")
def ols_single(spark, sf):
    m = H.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return m.select("term", r6("coefficient", 4).alias("coefficient"), r6("r2").alias("r2"))


@register("h06_ols_interaction")
def ols_interaction(spark, sf):
    m = H.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], [("l_quantity", "l_discount")])
    return m.select("term", *[r6(c, 4).alias(c) for c in ("coefficient", "std_error", "t", "p_value", "r2")])


@register("h07_vif", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a FROM lineitem) SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, round(1 / (1 - a * a), 6) AS vif FROM r")
def vif(spark, sf):
    return H.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("vif", r6("vif"))


_JB = lambda c, t: f"""SELECT '{c}' AS "column", round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 3) AS statistic FROM (SELECT count(*) AS n, avg(pow({c} - mu, 2)) AS m2, avg(pow({c} - mu, 3)) AS m3, avg(pow({c} - mu, 4)) AS m4 FROM {t}, (SELECT avg({c}) AS mu FROM {t}))"""


@register("h08_jarque_bera", _JB("l_quantity", "lineitem") + " UNION ALL " + _JB("l_extendedprice", "lineitem"))
def jarque_bera(spark, sf):
    return H.jarque_bera(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).select("column", r6("statistic", 3).alias("statistic"))


@register("h08_ks_normal")
def ks_normal(spark, sf):
    return H.ks_normal(table(spark, sf, "customer"), "c_acctbal").select(r6("p_value").alias("p_value"), r6("statistic").alias("statistic"))


_IQR = lambda c: f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS n_outliers FROM events, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM events)"""


@register("h09_iqr_outliers", _IQR("value") + " UNION ALL " + _IQR("user_id"))
def iqr_outliers(spark, sf):
    return H.iqr_outliers(table(spark, sf, "events"), ["value", "user_id"])


@register("h10_target_corr", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS corr FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def target_corr(spark, sf):
    return H.target_corr(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("corr", r6("corr"))


@register("h11_role_accuracy", f"""WITH RECURSIVE {PERM}, m AS (SELECT p_value, (CASE WHEN lead_score > 0 THEN stock_a ELSE stock_b END) = (CASE WHEN a.market_cap >= b.market_cap THEN stock_a ELSE stock_b END) AS ok FROM perm JOIN universe a ON a.symbol = stock_a JOIN universe b ON b.symbol = stock_b)
SELECT count(*) AS n_pairs, round(avg(ok::INT), 6) AS agreement, round(avg(CASE WHEN p_value < 0.25 THEN ok::INT END), 6) AS agreement_significant FROM m""")
def role_accuracy(spark, sf):
    roles = J.assign_roles(candidates(spark, sf), universe(spark, sf))
    r = H.role_accuracy(permuted(spark, sf), roles, alpha=0.25)
    return r.withColumns({"agreement": r6("agreement"), "agreement_significant": r6("agreement_significant")})


# --- audits -------------------------------------------------------------------------------

_UNIQ = lambda t, k: f"SELECT '{k}' AS key, count(*) AS n_rows, count(DISTINCT ({k})) AS n_distinct, count(*) - count(DISTINCT ({k})) AS n_surplus FROM {t}"


@register("d01_uniqueness", _UNIQ("lineitem", "l_orderkey,l_linenumber") + " UNION ALL " + _UNIQ("conversations", "conv_id,turn"))
def uniqueness(spark, sf):
    a = D.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return a.unionByName(D.uniqueness(table(spark, sf, "conversations"), ["conv_id", "turn"]))


@register("d01_duplicate_rows", "SELECT 'all columns' AS key, (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_distinct, (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_surplus")
def duplicate_rows(spark, sf):
    return D.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


@register("d02_integrity_report", """SELECT 'data_rows' AS "check", (SELECT count(*) FROM documents) AS value UNION ALL SELECT 'data_repeated_ids', (SELECT count(*) - count(DISTINCT doc_id) FROM documents) UNION ALL SELECT 'label_rows', (SELECT count(*) FROM labels) UNION ALL SELECT 'label_repeated_ids', (SELECT count(*) - count(DISTINCT doc_id) FROM labels)
UNION ALL SELECT 'repeated_tuples', (SELECT count(*) - count(DISTINCT (lang, source, n_chars)) FROM documents) UNION ALL SELECT 'repeated_rows', 0 UNION ALL SELECT 'only_in_data', (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) UNION ALL SELECT 'only_in_labels', (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) UNION ALL SELECT 'infinite_values', 0""")
def integrity_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))
    return D.integrity_report(d, table(spark, sf, "labels"), "doc_id", ["lang", "source", "n_chars"], ["n_chars"])


@register("d03_missing_columns", 'WITH t AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT \'quality\' AS "column", count(*) FILTER (quality IS NULL) AS n_missing, round(count(*) FILTER (quality IS NULL) * 100 / count(*), 6) AS pct_missing FROM t UNION ALL SELECT \'toxic\', count(*) FILTER (toxic IS NULL), round(count(*) FILTER (toxic IS NULL) * 100 / count(*), 6) FROM t')
def missing_columns(spark, sf):
    t = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return D.missing_report(t, ["quality", "toxic"]).withColumn("pct_missing", r6("pct_missing"))


@register("d03_panel_missing", f"WITH {PANEL}, m AS (SELECT id, count(*) - count(x) AS gone, count(*) AS n FROM cells GROUP BY 1) SELECT sum(n)::BIGINT AS n_cells, sum(gone)::BIGINT AS n_missing, round(sum(gone) * 100 / sum(n), 6) AS pct_missing, count(*) FILTER (gone > 0) AS rows_any, count(*) FILTER (gone = n) AS rows_all FROM m")
def panel_missing(spark, sf):
    return D.panel_missing(panel(spark, sf), "r").withColumn("pct_missing", r6("pct_missing"))


@register("d03_panel_missing_quantiles", f"WITH {PANEL}, m AS (SELECT id, count(*) - count(x) AS gone FROM cells GROUP BY 1) SELECT 'missing_count' AS \"column\", unnest([0.25, 0.5, 0.9]) AS q, unnest(quantile_cont(gone, [0.25, 0.5, 0.9]))::DOUBLE AS value FROM m")
def panel_missing_quantiles(spark, sf):
    return D.panel_missing_quantiles(panel(spark, sf), "r", [0.25, 0.5, 0.9])


@register("d04_zero_vs_missing", f"WITH {PANEL} SELECT i AS \"interval\", count(*) - count(x) AS n_missing, count(*) FILTER (x = 0) AS n_zero, count(*) AS n_cells FROM cells GROUP BY 1")
def zero_vs_missing(spark, sf):
    return D.panel_missing_by_interval(panel(spark, sf), "r").withColumn("interval", F.col("interval").cast("bigint"))


@register("d04_zero_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} IS NULL) AS n_missing FROM lineitem" for c in ("l_discount", "l_tax")))
def zero_report(spark, sf):
    return D.zero_report(table(spark, sf, "lineitem"), ["l_discount", "l_tax"])


@register("d05_bars_per_day", f"WITH {BARS} SELECT symbol, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n_bars, count(*) = 24 AS complete FROM bars GROUP BY 1, 2")
def bars_per_day(spark, sf):
    return B.bars_per_day(bars(spark, sf), 24)


@register("d06_balance", f"WITH {TICKS}, c AS (SELECT count(*) AS n FROM ticks GROUP BY symbol) SELECT round(max(n) / sum(n), 6) AS max_share, round(min(n) / sum(n), 6) AS min_share, max(n) / sum(n) - min(n) / sum(n) < 0.1 AS balanced FROM c")
def balance(spark, sf):
    return D.balance_report(ticks(spark, sf), "symbol").withColumns({"max_share": r6("max_share"), "min_share": r6("min_share")})


_SPEC = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "int", "event_type": "string", "amount": "double", "props": "string"}
_DUCK = {"bigint": "BIGINT", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@register("d07_schema_check", f"""WITH spec AS (SELECT unnest({list(_SPEC)}) AS name, unnest({[_DUCK[k] for k in _SPEC.values()]}) AS kind), have AS (SELECT column_name AS name, data_type AS kind FROM information_schema.columns WHERE table_name = 'events')
SELECT 'missing' AS issue, name FROM spec ANTI JOIN have USING (name) UNION ALL SELECT 'extra', name FROM have ANTI JOIN spec USING (name) UNION ALL SELECT 'type', name FROM spec JOIN have USING (name) WHERE spec.kind <> have.kind""")
def schema_check(spark, sf):
    """Differences of the events table from a specification with one missing, one extra and one retyped column."""
    spec = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in _SPEC.items()))
    return spark.createDataFrame(D.schema_check(table(spark, sf, "events"), spec), "issue string, name string")


@register("d08_shift", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", median({c}) FILTER (tr) AS median_train, quantile_cont({c}, 0.75) FILTER (tr) - quantile_cont({c}, 0.25) FILTER (tr) AS iqr_train, 0.0::DOUBLE AS missing_train,
 median({c}) FILTER (NOT tr) AS median_test, quantile_cont({c}, 0.75) FILTER (NOT tr) - quantile_cont({c}, 0.25) FILTER (NOT tr) AS iqr_test, 0.0::DOUBLE AS missing_test FROM (SELECT *, l_shipdate < TIMESTAMP '1999-01-01' AS tr FROM lineitem)""" for c in ("l_quantity", "l_extendedprice")))
def shift(spark, sf):
    line = table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return D.shift_report(line.filter(early), line.filter(~early), ["l_quantity", "l_extendedprice"])


@register("d08_class_shift", f"WITH {PANEL}, p AS (SELECT day <= {LAST_TRAIN_DAY} AS tr, reod FROM panel) SELECT reod, round(count(*) FILTER (tr) / (SELECT count(*) FROM p WHERE tr), 6) AS share_train, round(count(*) FILTER (NOT tr) / (SELECT count(*) FROM p WHERE NOT tr), 6) AS share_test FROM p GROUP BY 1")
def class_shift(spark, sf):
    p = split_panel(spark, sf)
    s = D.class_shift(p.filter("is_train"), p.filter("NOT is_train"), "reod")
    return s.withColumns({"share_train": r6("share_train"), "share_test": r6("share_test")})
