"""Secret scan over an inverted index of trigrams, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: any match holds all trigrams of one of the query's
alternatives. Only trigrams of queries are indexed, as rows (trigram, document); a rule's candidates are the
documents that stand in all postings of one alternative. Candidates are verified with the expression itself, rules without
mandatory trigrams scan every document. Spans come from the texts between and in matches, in code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alternatives that a rule's query has at most; beyond it the rule scans fully.
MOST_ALTERNATIVES = 64
#: Matches of a text whose places are summed up together.
PART = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` is shorter than `least` are dropped; they still take up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# The kinds of the base contract, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of further keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9+/_.~=-]+)", 1, 20, True),
)
RULES = BASE + MORE


def required_runs(pattern: str) -> list[list[str]]:
    """Alternatives of an expression, each as the literal runs (lower case) that any match of it must hold."""
    parts = re._parser.parse(pattern)
    # An alternative under way: finished runs and the run that the next literal continues.
    Open = tuple[tuple[str, ...], str]

    def close(found: list[Open]) -> list[Open]:
        return [((*runs, run) if run else runs, "") for runs, run in found]

    def through(items, found: list[Open]) -> list[Open]:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                found = [(runs, run + chr(arg).lower()) for runs, run in found]
            elif name == "SUBPATTERN":
                found = through(arg[3], found)
            elif name == "BRANCH":
                found = [x for branch in arg[1] for x in through(branch, found)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                if low == 0 and high == 1:
                    found = found + through(body, found)
                elif low:
                    found = close(through(body, found)) if (low, high) != (1, 1) else through(body, found)
                else:
                    found = close(found)
            else:
                found = close(found)
            if len(found) > MOST_ALTERNATIVES:
                return [((), "")]
        return found

    return [list(runs) for runs, _ in close(through(parts, [((), "")]))]


def trigram_query(rule: Rule) -> list[list[str]]:
    """The rule as alternatives of trigrams that must all occur; empty if some match need not hold any trigram."""
    alternatives = {tuple(sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})) for runs in required_runs(rule.pattern)}
    if () in alternatives:
        return []
    return [list(a) for a in sorted(alternatives) if not any(set(b) < set(a) for b in alternatives)]


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, leftmost and not overlapping, in code points."""
    pattern = F.lit(rule.java)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.java, -1)
    lengths = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: F.struct(F.length(x["gap"]).cast("bigint").alias("gap"), F.length(x["hit"]).cast("bigint").alias("hit"), F.length(x["value"]).alias("value")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:int>>")
    state = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("end"), x["value"].alias("value")))
        return F.struct((start + x["hit"]).alias("at"), F.concat(s["out"], one).alias("out"))

    # Lists grow by copying, so matches go in parts; each part starts where the one before ended.
    def in_parts(all_of: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(all_of) - 1) / PART).cast("int")), lambda n: F.slice(all_of, n * PART + 1, PART))
        step = lambda done, part: F.concat(done, F.array(F.aggregate(part, state(F.element_at(done, -1)["at"]), add)))
        return F.flatten(F.transform(F.aggregate(parts, F.array(state(F.lit(0).cast("bigint"))), step), lambda x: x["out"]))

    # The array of one element gives `lengths` a name, so that it is evaluated once.
    spans = F.element_at(F.transform(F.array(lengths), in_parts), 1)
    found = F.filter(spans, lambda x: x["value"] >= rule.least)
    return F.when(text.rlike(rule.java), F.transform(found, lambda x: F.struct(x["start"], x["end"]))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def candidates(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_doc, _key, kinds): per document the indexed rules with an alternative all of whose postings hold it."""
    queries = [(r.kind, n, t, len(a)) for r in rules for n, a in enumerate(trigram_query(r)) for t in a]
    vocabulary = sorted({q[2] for q in queries})
    lower = docs.select("_doc", "_key", F.lower("text").alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    postings = lower.select("_doc", "_key", F.explode(held).alias("trigram")).distinct()
    # One row per trigram of the rules' queries: the rules bound it.
    side = F.broadcast(spark.createDataFrame(queries, "kind string, alternative int, trigram string, need int"))
    whole = postings.join(side, "trigram").groupBy("_doc", "_key", "kind", "alternative").agg((F.count(F.lit(1)) == F.first("need")).alias("_all"))
    return whole.filter("_all").groupBy("_doc", "_key").agg(F.collect_set("kind").alias("_kinds"))


def named(number: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and found: array of (start, kind number, kind, end) by start, then kind, per row of `docs`.

    Null and empty texts have no spans. Repeated rows and null ids are rows like others: candidates are kept by id and
    text hash. Other columns are not read. `rules` bound the number of kinds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    indexed = {r.kind for r in rules if trigram_query(r)}
    kinds = candidates(spark, rows, rules).withColumnRenamed("_doc", "_doc2").withColumnRenamed("_key", "_key2")
    joined = rows.join(kinds, (F.col("_key") == F.col("_key2")) & F.col("_doc").eqNullSafe(F.col("_doc2")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    parts = []
    for number, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule)
        if rule.kind in indexed:
            spans = F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(none)
        parts.append(F.transform(spans, named(number, rule.kind)))
    return joined.select(F.col("_doc").alias("doc_id"), F.array_sort(F.concat(*parts)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, the SHA-256 of the base spans, and all spans as text."""
    found = scan(docs, rules)
    base = F.filter("found", lambda x: x["number"] < len(BASE))
    counts = [F.size(F.filter("found", of_kind(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
