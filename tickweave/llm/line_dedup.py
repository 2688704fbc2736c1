"""Line dedup by pairwise alignment.

Runs of consecutive lines that just reach `min_words` words are hashed; such a run is rare unless it was copied. The earliest
document that holds a run is its source, so a run in any number of documents gives one pair a document, never all pairs. A
later document is aligned with each of its sources by patience diff over line hashes, and aligned common blocks of
`min_words` words or more are deleted from it. Exact copies of a text need no alignment: their whole text is the block.
With `rare`, a shorter line that few texts hold names its first holder as a source too, and a block with such a line is
deleted whatever its length; the word rule is then for frequent lines only.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.frames import map_slices, texts, unused
from tickweave.session import cut

MIN_WORDS = 20
#: Distinct texts that hold a rare line at most. In the given tables copied lines stand in 2 or 3 texts, boilerplate in 10 and more.
RARE = 5


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first place, that also rises in the second."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(ends, j)
        back[k] = at[p - 1] if p else -1
        if p == len(ends):
            ends.append(j), at.append(k)
        else:
            ends[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_unique(a: Sequence, b: Sequence, range_a: range, range_b: range) -> list[tuple[int, int]]:
    """Places of the lines that stand once in either range; where there is none, of equal numbered repeats."""
    count_a, count_b = Counter(a[i] for i in range_a), Counter(b[j] for j in range_b)
    place = {b[j]: j for j in range_b if count_b[b[j]] == 1}
    pairs = [(i, place[a[i]]) for i in range_a if count_a[a[i]] == 1 and a[i] in place]
    if pairs or not count_a.keys() & count_b.keys():
        return pairs
    seen: Counter = Counter()
    numbered = {}
    for j in range_b:
        numbered[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen.clear()
    for i in range_a:
        if (j := numbered.get((a[i], seen[a[i]]))) is not None:
            pairs.append((i, j))
        seen[a[i]] += 1
    return pairs


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines, rising in both: equal ends, then the longest rising chain of unique common lines, then between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a == hi_a or lo_b == hi_b:
            continue
        chain = longest_increasing(common_unique(a, b, range(lo_a, hi_a), range(lo_b, hi_b)))
        if not chain:
            continue
        out += chain
        edges = [(lo_a - 1, lo_b - 1), *chain, (hi_a, hi_b)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


def automaton(lines: Sequence) -> tuple[list[dict], list[int], list[int]]:
    """Suffix automaton of a text of lines: per state its next states, its suffix link and its longest length."""
    after: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for x in lines:
        new, p = len(after), last
        after.append({}), link.append(0), length.append(length[last] + 1)
        while p >= 0 and x not in after[p]:
            after[p][x] = new
            p = link[p]
        if p >= 0:
            q = after[p][x]
            if length[q] > length[p] + 1:
                q, old = len(after), q
                after.append(dict(after[old])), link.append(link[old]), length.append(length[p] + 1)
                while p >= 0 and after[p].get(x) == old:
                    after[p][x] = q
                    p = link[p]
                link[old] = q
            link[new] = q
        last = new
    return after, link, length


def common_blocks(later: Sequence, earlier: Sequence, words: Sequence[int], min_words: int, rare: Collection = ()) -> list[int]:
    """Lines of `later` in aligned blocks (consecutive in both) of at least `min_words` words or with a line of `rare`.

    An alignment uses each line of `earlier` once and rises in both, so blocks that moved or stand twice in `later` fall
    out of it: of the lines left over, every run that stands anywhere in `earlier` and is long enough goes too.
    """
    enough = lambda places: sum(words[k] for k in places) >= min_words or any(later[k] in rare for k in places)
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if enough(block):
                out += block
            block = []
        block.append(i)
        last = (i, j)
    shared, gone = set(earlier), set(out)
    rest = [i for i in range(len(later)) if i not in gone and later[i] in shared]
    if not enough(rest):
        return sorted(out)
    total, few = [0], [0]
    for x, n in zip(later, words, strict=True):
        total.append(total[-1] + n), few.append(few[-1] + (x in rare))
    after, link, length = automaton(earlier)
    state = run = done = 0
    for at, i in enumerate(rest):
        if not at or i != rest[at - 1] + 1:
            state = run = 0
        while later[i] not in after[state]:
            state = link[state]
            run = length[state]
        # The longest run that ends here and stands in `earlier`; its start never moves back.
        state, run = after[state][later[i]], run + 1
        start = i + 1 - run
        if total[i + 1] - total[start] >= min_words or few[i + 1] > few[start]:
            out += range(max(start, done), i + 1)
            done = i + 1
    return sorted(out)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def run_hashes(hashes: Sequence[int], words: Sequence[int], min_words: int) -> list[int]:
    """Hash of the shortest run of lines from each line on that reaches `min_words` words."""
    out, total, end, n = [], 0, 0, len(hashes)
    for start in range(n):
        while end < n and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        if words[start]:
            out.append(signed(xxhash.xxh3_64_intdigest(array("q", hashes[start:end]).tobytes())))
        total -= words[start]
    return out


def hashed(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, key of the text, and per line its hash and number of words, and the hashes of its runs."""

    def make():
        def step(batch: pa.RecordBatch):
            lines, words, runs = [], [], []
            for text in texts(batch.column(2)):
                split = [line.strip() for line in text.split("\n")]
                lines.append([signed(xxhash.xxh3_64_intdigest(line.encode("utf-8"))) for line in split])
                words.append([len(line.split()) for line in split])
                runs.append(run_hashes(lines[-1], words[-1], min_words))
            return batch.column(0), batch.column(1), lines, words, runs

        return step

    return map_slices(docs, make, "doc_id long, key string, lines array<long>, words array<long>, runs array<long>")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = 0) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) with n_lines, n_deleted, copy_of and the text that stays.

    Lines end at \\n and are compared without blanks at their ends. The earlier document is the one of smaller doc_id, then of
    smaller text hash; null ids come last. An exact copy of an earlier text has its doc_id in copy_of and no text left. Null
    texts are empty; an empty text stays as it is. Rows equal in doc_id and text are one document and get the same
    result. Blocks under `min_words` words stay unless a line of theirs stands in at most `rare` distinct texts (0: no line
    counts as rare), so short frequent lines alone change nothing. Columns of the input with the names n_lines, n_deleted
    or copy_of are replaced.
    """
    rows = docs.drop("n_lines", "n_deleted", "copy_of").withColumn("text", F.coalesce("text", F.lit("")))
    keyed = rows.filter("text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("key"), "text")
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    firsts = hashed(keyed, min_words).groupBy("key").agg(
        F.min_by(F.struct("doc_id", "lines", "words", "runs"), order).alias("_first"),
        (F.count(F.lit(1)) > 1).alias("copied"),
    )
    firsts = cut(firsts.select("key", "copied", "_first.*"))

    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    tagged = lambda marks, line: F.transform(F.array_distinct(marks), lambda m: F.struct(F.lit(line).alias("line"), m.alias("mark")))
    # A line of `min_words` words is a run by itself.
    short = F.transform(F.filter(F.arrays_zip("lines", "words"), lambda x: (x["words"] > 0) & (x["words"] < min_words)), lambda x: x["lines"])
    marks = F.concat(tagged(F.col("runs"), False), tagged(short, True)) if rare else tagged(F.col("runs"), False)
    held = firsts.select("key", rank.alias("rank"), F.explode(marks).alias("_m")).select("key", "rank", "_m.*")
    sources = held.groupBy("line", "mark").agg(F.min("rank")["key"].alias("source"), F.count(F.lit(1)).alias("_n"))
    sources = sources.filter((F.col("_n") > 1) & (~F.col("line") | (F.col("_n") <= rare))).drop("_n")
    found = held.drop("rank").join(sources, ["line", "mark"]).filter("key <> source")
    # A document's lines bound what is gathered for it.
    found = cut(found.groupBy("key").agg(F.collect_set("source").alias("sources"), F.collect_set(F.when(F.col("line"), F.col("mark"))).alias("rare")))
    pairs = found.select("key", F.explode("sources").alias("source"), "rare")
    aligned = pairs.join(firsts.select("key", F.col("lines").alias("later"), "words"), "key").join(firsts.select(F.col("key").alias("source"), F.col("lines").alias("earlier")), "source")

    def make():
        def step(batch: pa.RecordBatch):
            key, later, earlier, words, few = (batch.column(i).to_pylist() for i in range(5))
            return key, [common_blocks(a, b, n, min_words, set(r)) for a, b, n, r in zip(later, earlier, words, few, strict=True)]

        return step

    blocks = map_slices(aligned.select("key", "later", "earlier", "words", "rare"), make, "key string, gone array<long>")
    # A document's lines bound what is gathered for it.
    gone = blocks.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone")).filter(F.size("_gone") > 0)
    changes = firsts.select("key", "copied", F.col("doc_id").alias("_first")).join(gone, "key", "left").filter("copied OR _gone IS NOT NULL")

    key, copied, first, cuts = unused(rows, "_key", "_copied", "_first", "_gone")
    marked = cut(changes.select(F.col("key").alias(key), F.col("copied").alias(copied), F.col("_first").alias(first), F.col("_gone").alias(cuts)))
    joined = rows.withColumn(key, F.md5("text")).join(marked, key, "left")
    copy = F.coalesce(copied, F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col(first))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(cuts, i.cast("bigint"))), "\n")
    deleted = F.when(copy, F.size(lines)).otherwise(F.coalesce(F.size(cuts), F.lit(0))).cast("bigint")
    left = F.when(copy, F.lit("")).when(F.col(cuts).isNotNull(), kept).otherwise(F.col("text"))
    return joined.select(
        *[left.alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns],
        F.size(lines).cast("bigint").alias("n_lines"),
        deleted.alias("n_deleted"),
        F.when(copy, F.col(first)).alias("copy_of"),
    )
