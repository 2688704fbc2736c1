"""URL filters by a temporal list join, in DataFrame functions only.

Dated entries (add, remove) of block lists become validity intervals. Every capture is looked up under its host, each parent
domain and each path prefix, and an as-of join keeps the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def folders_of(url: Column) -> Column:
    """Folder names of the path, without empty ones, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def keys_of(url: Column) -> Column:
    """Array of (kind, value): the host, its parent domains of two labels or more, and host/folder prefixes of every depth."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    n = F.size(labels)
    counts = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: k <= n)
    domains = F.transform(counts, lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("value")))
    folders = folders_of(url)
    depths = F.filter(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda k: k <= F.size(folders))
    prefixes = F.transform(depths, lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(folders, 1, k), "/")).alias("value")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until): intervals [since, until) in which an entry was active; until is null while it is.

    `entries`: list, kind (host, domain, prefix), value, action (add, remove), at (date). On one day the removal counts
    last; repeated additions and removals change nothing; rows with a null in any of these columns, or another action, are no entries.
    Hosts and domains match in any case, as does the host of a prefix; its folders match in their own case, as in the url.
    """
    host, rest = F.regexp_extract("value", "^[^/]*", 0), F.regexp_extract("value", "(?s)^[^/]*(.*)$", 1)
    value = F.when(F.col("kind") == "prefix", F.concat(F.lower(host), rest)).otherwise(F.lower("value"))
    named = entries.select("list", "kind", value.alias("value"), "at", F.col("action").alias("_action")).dropna().filter(F.col("_action").isin("add", "remove"))
    days = named.groupBy("list", "kind", "value", "at").agg(F.max(F.col("_action") == "remove").alias("_off"))
    # The days on which one entry changed: the calendar bounds them.
    order = W.partitionBy("list", "kind", "value").orderBy("at")
    turns = days.withColumn("_was", F.lag("_off").over(order)).filter("_was IS NULL OR _was <> _off")
    spans = turns.withColumn("until", F.lead("at").over(order)).filter("NOT _off")
    return spans.select("list", "kind", "value", F.col("at").alias("since"), "until")


def matches(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(page_id, url, fetched, list, kind, value) for each capture and entry active when it was fetched, once each."""
    rows = captures.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("fetched")).filter("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    keyed = rows.select("page_id", "url", "fetched", F.explode(keys_of(F.col("url"))).alias("_k")).select("page_id", "url", "fetched", "_k.*")
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    return keyed.join(validity(entries), ["kind", "value"]).filter(active).select("page_id", "url", "fetched", "list", "kind", "value")


def judge(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """page_id, url, fetched, host, n_active, rules, blocked per row of `captures`.

    A capture is blocked by any active entry of list 'block' unless an entry of list 'allow' is active too. rules: the active
    entries as list:kind:value, sorted, comma-joined. Captures without a url or a date match nothing and are not blocked;
    repeated rows get the same answer; other columns are not read.
    """
    rows = captures.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("fetched"))
    # The keys of one url bound what is gathered for it.
    found = matches(rows, entries).groupBy("page_id", "url", "fetched").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "list", "kind", "value"))), ",").alias("rules"),
        F.count(F.lit(1)).cast("bigint").alias("n_active"),
        (F.max(F.col("list") == "block") & ~F.max(F.col("list") == "allow")).alias("blocked"),
    )
    found = found.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
    same = rows.page_id.eqNullSafe(found._page_id) & (rows.url == found._url) & (rows.fetched == found._fetched)
    joined = rows.join(found, same, "left")
    return joined.select("page_id", "url", "fetched", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("_n_active", F.lit(0)).alias("n_active"), F.coalesce("_rules", F.lit("")).alias("rules"), F.coalesce("_blocked", F.lit(False)).alias("blocked"))
