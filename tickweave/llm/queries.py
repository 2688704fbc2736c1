"""Registered queries of this package: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import centroids, decontamination, jaccard_join, line_dedup, mixing, nearest, packing, quality, secrets, token_counts, toxicity, url_lists, whitening
from tickweave.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return add


@register("op1_quality")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf, "labels")), threshold=0.3)


@register("op2_line_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf, "documents"), rare=line_dedup.RARE)
    return done.select("doc_id", "n_lines", "n_deleted", "copy_of", "text")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the pages: of a third of the hosts, some domains and first folders.

    m is the smallest page_id of the named thing; it sets the days of additions and removals.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    named = pages.filter("url IS NOT NULL AND page_id IS NOT NULL").select("page_id", F.explode(url_lists.keys_of(F.col("url"))).alias("k")).select("page_id", "k.*")
    m = named.groupBy("kind", "value").agg(F.min("page_id").alias("m"))
    listed = m.filter("(kind = 'host' AND m % 3 = 1) OR (kind = 'domain' AND m % 4 = 1) OR (kind = 'prefix' AND m % 5 = 1)")
    entry = lambda where, kind, action, n: listed.filter(where).select(F.lit(kind).alias("list"), "kind", "value", F.lit(action).alias("action"), day(n).alias("at"))
    added = F.col("m") * 37 % 200
    return (
        entry("kind <> 'prefix' OR m % 2 = 0", "block", "add", added)
        .unionByName(entry("kind = 'host' AND m % 2 = 0", "block", "remove", added + 30 + F.col("m") % 60))
        .unionByName(entry("kind = 'host' AND m % 4 = 0", "block", "add", added + 120))
        .unionByName(entry("kind = 'prefix' AND m % 2 = 1", "allow", "add", added))
    )


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
URL_SQL = rf"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS folders,
    DATE '2024-01-01' + (page_id * 53 % 365)::INT AS fetched FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p),
keyed AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS value FROM l WHERE host <> ''
  UNION SELECT page_id, url, fetched, 'domain', array_to_string(labels[len(labels) - k + 1:], '.') FROM l, range(2, 20) r(k) WHERE host <> '' AND k <= len(labels)
  UNION SELECT page_id, url, fetched, 'prefix', host || '/' || array_to_string(folders[1:k], '/') FROM l, range(1, 9) r(k) WHERE host <> '' AND k <= len(folders)),
named AS (SELECT kind, value, min(page_id) AS m, min(page_id) * 37 % 200 AS d FROM keyed GROUP BY 1, 2),
listed AS (SELECT * FROM named WHERE (kind = 'host' AND m % 3 = 1) OR (kind = 'domain' AND m % 4 = 1) OR (kind = 'prefix' AND m % 5 = 1)),
events AS (
  SELECT 'block' AS list, kind, value, FALSE AS off, d AS n FROM listed WHERE kind <> 'prefix' OR m % 2 = 0
  UNION ALL SELECT 'block', kind, value, TRUE, d + 30 + m % 60 FROM listed WHERE kind = 'host' AND m % 2 = 0
  UNION ALL SELECT 'block', kind, value, FALSE, d + 120 FROM listed WHERE kind = 'host' AND m % 4 = 0
  UNION ALL SELECT 'allow', kind, value, FALSE, d FROM listed WHERE kind = 'prefix' AND m % 2 = 1),
state AS (SELECT list, kind, value, off, DATE '2024-01-01' + n::INT AS at FROM events),
found AS (
  SELECT k.page_id, k.url, k.fetched, s.list || ':' || s.kind || ':' || s.value AS rule, s.list FROM keyed k JOIN state s USING (kind, value) WHERE s.at <= k.fetched
  GROUP BY 1, 2, 3, s.list, s.kind, s.value HAVING NOT arg_max(s.off, s.at)),
j AS (SELECT page_id, url, fetched, array_to_string(list_sort(list(rule)), ',') AS rules, count(*) AS n_active,
    bool_or(list = 'block') AND NOT bool_or(list = 'allow') AS blocked FROM found GROUP BY 1, 2, 3)
SELECT p.page_id, p.url, p.fetched::VARCHAR AS fetched, p.host, coalesce(n_active, 0) AS n_active, coalesce(rules, '') AS rules, coalesce(blocked, FALSE) AS blocked
FROM p LEFT JOIN j USING (page_id, url, fetched)"""


@register("op3_url_lists", URL_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 53 % 365).cast("int")).alias("fetched"))
    return url_lists.judge(captures, list_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


@register("op4_secret_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(table(spark, sf, "documents"))


@register("op5_jaccard_join")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf, "documents"), size=4, percent=85)


@register("op6_best_fit_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), capacity=4096)


@register("op7_nearest")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest(table(spark, sf, "embeddings"), every=100, k=10)


@register("op8_token_counts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), limit=1024)


@register("op9_decontamination", decontamination.LEAKS_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")), threshold=0.7)


@register("op11_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"), components=4)


@register("op12_mixing")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).taken()


@register("op13_centroids", centroids.CLUSTER_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings"), k=40, rounds=5)
