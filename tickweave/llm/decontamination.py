"""Benchmark decontamination on canonical templates, in DataFrame functions only.

Words of documents and benchmark items become a template: numbers, units after a number and names (capitalised words inside a
sentence) turn into typed placeholders, other words are lowered without punctuation at their ends. Windows of `window`
template words are hash-joined. A document's windows of one item that lie at one offset are one occurrence; it is kept if
its slots are consistent, that is each slot value of the item stands for one value of the document. So a question with
other numbers and names is found, and a chance match of placeholders is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.session import cut

WINDOW = 8
#: Share of an item's windows that a document must hold, or so many of them: 13 words in a row.
SHARE = 0.5
ENOUGH = 6
#: Windows of the benchmark up to which it is broadcast (8 bytes of hash and a few of slots each); beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000

# Units of measure.
UNITS = "mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hours hour minutes minute seconds days day weeks years usd eur dollars euros percent % kb mb gb w kw v hz c f"

NUMBER = r"^[+-]?[$€£]?[0-9]+([.,/:][0-9]+)*%?$"
#: Punctuation that a word has at its start or end, without the signs of numbers: ASCII and general punctuation.
LEADING = r"[!-#&-*,./:-@\[-`{-~¡¿«»\x{2010}-\x{206F}\x{3001}-\x{3003}]"
TRAILING = r"[!-$&-/:-@\[-`{-~€£¡¿«»\x{2010}-\x{206F}\x{3001}-\x{3003}]"
EDGES = rf"^{LEADING}+|{TRAILING}+$"
SENTENCE_END = rf"[.!?]{TRAILING}*"

# In texts under way: the mark of a sentence's end, and what parts a placeholder from its value.
MARK, PART = "\x02", "\x03"

#: The same result of `leaks` in DuckDB SQL.
LEAKS_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
split AS (SELECT side, id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\r\n\x02\x03]+', ' . ', 'g'), '\s+'), lambda w: w <> '') AS w FROM texts),
cores AS (SELECT side, id, list_filter(flatten(list_transform(w, lambda x: [regexp_replace(x, '{EDGES}', '', 'g'), CASE WHEN regexp_matches(x, '{SENTENCE_END}$') THEN chr(2) ELSE '' END])), lambda x: x <> '') AS c FROM split),
kinds AS (SELECT side, id, c, list_transform(c, lambda x, k: CASE
    WHEN regexp_matches(x, '{NUMBER}') THEN '<num>'
    WHEN k > 1 AND regexp_matches(c[k - 1], '{NUMBER}') AND list_contains(string_split('{UNITS}', ' '), lower(x)) THEN '<unit>'
    WHEN regexp_matches(x, '^\p{{Lu}}') AND k > 1 AND c[k - 1] <> chr(2) THEN '<name>' ELSE lower(x) END) AS t FROM cores),
pairs AS (SELECT side, id, list_filter(list_zip(t, list_transform(c, lambda x, k: CASE WHEN t[k] IN ('<num>', '<unit>', '<name>') THEN lower(x) ELSE '' END)), lambda p: p[1] <> chr(2)) AS p FROM kinds),
templ AS (SELECT side, id, list_transform(p, lambda x: x[1]) AS t, list_transform(p, lambda x: x[2]) AS s FROM pairs WHERE len(p) > 0),
wins AS (SELECT side, id, k AS pos, array_to_string(t[k + 1:k + {WINDOW}], chr(2)) AS w, s[k + 1:k + {WINDOW}] AS s FROM templ, LATERAL (SELECT unnest(range(greatest(len(t) - {WINDOW} + 1, 1))) AS k)),
total AS (SELECT id AS item_id, count(DISTINCT pos) AS n_windows FROM wins WHERE side = 'i' GROUP BY 1),
found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, i.pos AS item_at, d.pos - i.pos AS diff, d.s AS ours, i.s AS theirs FROM wins d JOIN wins i ON d.w = i.w AND d.side = 'd' AND i.side = 'i'),
used AS (SELECT doc_id, item_id, diff, unnest(theirs) AS a, unnest(ours) AS b FROM found),
torn AS (SELECT DISTINCT doc_id, item_id, diff FROM (SELECT doc_id, item_id, diff, a FROM used WHERE a <> '' GROUP BY ALL HAVING count(DISTINCT b) > 1)),
whole AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS n_found, bool_and(ours = theirs) AS verbatim FROM found ANTI JOIN torn USING (doc_id, item_id, diff) GROUP BY 1, 2)
SELECT doc_id, item_id, n_windows, n_found, n_found / n_windows AS share, verbatim FROM whole JOIN total USING (item_id) WHERE n_found >= least({SHARE} * n_windows, {ENOUGH})"""


def template(text: Column) -> Column:
    """Array of template words, in passes over the whole text; a placeholder carries its value behind PART.

    Sentence and line ends become marks, punctuation goes from the ends of words, then numbers, units behind a number
    and capitalised words that no mark precedes are replaced.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SENTENCE_END}(?=\s|$)|[\r\n{MARK}{PART}]+", f" {MARK} ")
    # The first look ahead passes over letters at once.
    clean = F.regexp_replace(marked, rf"(?={TRAILING})(?:{TRAILING}+(?!\S)|(?<!\S){LEADING}+)", "")
    numbered = F.regexp_replace(clean, rf"(?<!\S){NUMBER[1:-1]}(?!\S)", f"<num>{PART}$0")
    with_units = F.regexp_replace(numbered, rf"(?i)(<num>{PART}\S+\s+)({UNITS.replace(' ', '|')})(?!\S)", f"$1<unit>{PART}$2")
    counted = F.when(text.rlike("[0-9]"), with_units).otherwise(clean)
    named = F.regexp_replace(counted, rf"(?=\s)(?<=[^\s{MARK}])(\s+)(\p{{Lu}}\S*)", f"$1<name>{PART}$2")
    return F.array_remove(F.array_remove(F.split(F.lower(named), r"\s+"), ""), MARK)


def window_hashes(parts: DataFrame, column: str, window: int) -> DataFrame:
    """Replace an array of hashes by those of its windows, by doubling: a run of 2n joins two runs of n. Past the end runs are cut short."""
    def joined(runs: str, later: str, shift: int) -> Column:
        return F.transform(runs, lambda x, i: F.xxhash64(x, F.get(F.col(later), i + shift)))

    done, size = None, 1
    parts = parts.withColumnRenamed(column, "_runs")
    while size <= window:
        if window & size:
            parts = parts.withColumn("_done", F.col("_runs") if done is None else joined("_done", "_runs", done))
            done = (done or 0) + size
        size *= 2
        if size <= window:
            parts = parts.withColumn("_runs", joined("_runs", "_runs", size // 2))
    return parts.withColumnRenamed("_done", column).drop("_runs")


def windows(texts: DataFrame, key: str, window: int) -> DataFrame:
    """(key, n, at, hash, slots): each window of the template; a shorter template is one window, an empty one none."""
    typed = texts.select(key, template(F.col("text")).alias("_t"))
    marked = typed.select(key, "_t", F.contains(F.array_join("_t", " "), F.lit(PART)).alias("_any"))
    hashes = F.when(F.col("_any"), F.transform("_t", lambda t: F.xxhash64(F.substring_index(t, PART, 1)))).otherwise(F.transform("_t", lambda t: F.xxhash64(t)))
    values = F.transform("_t", lambda t: F.when(F.contains(t, F.lit(PART)), F.substring_index(t, PART, -1)).otherwise(""))
    parts = window_hashes(marked.select(key, hashes.alias("_h"), F.when(F.col("_any"), values).alias("_s")), "_h", window)
    count = F.greatest(F.size("_h") - window + 1, F.lit(1))
    filled = lambda i: F.exists(F.slice("_s", i + 1, window), lambda s: s != "")
    slots = lambda i: F.when(filled(i), F.array_join(F.slice("_s", i + 1, window), "\x01")).otherwise("")
    whole = F.slice("_h", F.lit(1), count)
    cells = F.when(F.col("_s").isNull(), F.transform(whole, lambda x: F.struct(x.alias("hash"), F.lit("").alias("slots")))).otherwise(F.transform(whole, lambda x, i: F.struct(x.alias("hash"), slots(i).alias("slots"))))
    return parts.select(key, count.alias("n"), F.posexplode(cells).alias("at", "_w")).select(key, "n", "at", "_w.*")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, share, verbatim) per document and benchmark item with `share` or `enough` of the item's windows.

    verbatim: all slots have the item's own values. Null and empty texts hold no windows; an item shorter than a window is
    one window and only equals a document of the same template. Rows of one doc_id (item_id) count as one document (item),
    rows without an id are left out, repeated rows count once. Other columns are not read.
    """
    items = cut(windows(benchmark.filter("item_id IS NOT NULL").select("item_id", "text").distinct(), "item_id", window))
    total = items.groupBy("item_id").agg(F.count_distinct("at").cast("bigint").alias("n_windows"))
    side = items.select("item_id", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"))
    if items.count() <= BROADCAST_WINDOWS:
        side, total = F.broadcast(side), F.broadcast(total)
    found = windows(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id", window).drop("n").join(side, "hash")
    found = found.select("doc_id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), "slots", "item_slots").distinct()
    # Values that each slot value of the item stands for, one row per distinct pair of values and occurrence.
    empty = F.col("item_slots") == ""
    found = cut(found)
    pairs = F.arrays_zip(F.split("item_slots", "\x01").alias("theirs"), F.split("slots", "\x01").alias("ours"))
    used = found.filter(~empty).select("doc_id", "item_id", "offset", F.explode(F.array_distinct(F.filter(pairs, lambda p: p["theirs"] != ""))).alias("_p"))
    used = used.select("doc_id", "item_id", "offset", "_p.theirs", "_p.ours").distinct()
    spread = used.groupBy("doc_id", "item_id", "offset", "theirs").agg(F.count(F.lit(1)).alias("_n"))
    torn = spread.filter("_n > 1").select("doc_id", "item_id", "offset").distinct()
    kept = found.join(torn, ["doc_id", "item_id", "offset"], "left_anti")
    whole = kept.groupBy("doc_id", "item_id").agg(F.count_distinct("item_at").cast("bigint").alias("n_found"), F.min(F.col("slots") == F.col("item_slots")).alias("verbatim"))
    return whole.join(total, "item_id").filter(F.col("n_found") >= F.least(share * F.col("n_windows"), F.lit(float(enough)))).select("doc_id", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("share"), "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, enough: int = ENOUGH) -> DataFrame:
    """The rows of `docs` whose doc_id has no leak; rows without a doc_id stay."""
    return docs.join(leaks(docs, benchmark, window, share, enough).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
