"""Mixing sources to target weights.

The words of each source, document after document, are cut into blocks of fixed length. Output shards have a fixed number of slots, one
block each; how many slots of a shard go to each source is a multinomial draw. The slots of a source are numbered through
all shards, and a pseudorandom permutation of the source's block numbers, another one for every time round, says
which block each slot holds. Blocks are then joined by number; no text moves before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.llm.hashing import mix as spread_bits
from tickweave.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of a shard, and how often a source may be repeated.
BLOCK, SHARD, REPEATS = 64, 65_536, 3
#: Documents of a source are put in order by buckets of about this many.
BUCKET = 2_000
#: The driver holds one row a source and sends it to all executors; more sources than this are an error.
SOURCES = 200_000
#: Slots that one task fills, about.
TASK_SLOTS = 200_000
#: Rows of an Arrow batch that a task gives out at once.
BATCH = 65_536


# --- plan: one entry a source, on the driver ---------------------------------------------


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of the total by weight, none above `repeats` times its size; what is over goes to the others by weight."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - repeats * sum(sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = Fraction(rest, weight) if weight else Fraction(0)
        over = {i for i, w in enumerate(weights) if i not in capped and share * w > repeats * sizes[i]}
        if not over:
            return [Fraction(repeats * n) if i in capped else share * w for i, (n, w) in enumerate(zip(sizes, weights, strict=True))]
        capped |= over


@dataclass(frozen=True)
class Plan:
    """What the driver knows of each source: its size, target, blocks and slots."""

    names: list[str | None]
    documents: list[int]
    sizes: list[int]
    targets: list[Fraction]
    blocks: np.ndarray
    slots: np.ndarray
    shard: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-int(self.slots.sum()) // self.shard)

    def sources(self, spark) -> DataFrame:
        """number, name, source_size, target, buckets: at most SOURCES rows."""
        rows = [(i, name, size, float(goal), -(-n // BUCKET)) for i, (name, n, size, goal) in enumerate(zip(self.names, self.documents, self.sizes, self.targets, strict=True))]
        return F.broadcast(spark.createDataFrame(rows, "number int, name string, source_size long, target double, buckets int"))


def plan(sized: DataFrame, weights: tuple[int, ...], block: int, shard: int, seed: int) -> Plan:
    """Sources by code point, null last; whole rounds take every block of a source, a broken round as many as its rest needs."""
    found = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: merge the rare ones")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"] or 0) for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))]) if sizes else []
    blocks = np.array([-(-n // block) for n in sizes], dtype=np.int64)
    slots = []
    for n, goal, count in zip(sizes, wanted, blocks.tolist(), strict=True):
        rounds = int(goal // n) if n else 0
        slots.append(rounds * count + min(count, round((goal - rounds * n) / block)) if n else 0)
    return Plan([r["source"] for r in found], [int(r["n"]) for r in found], sizes, wanted, blocks, np.array(slots, dtype=np.int64), shard, seed)


# --- permutations ---------------------------------------------------------------------


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..count-1 for every key: a four-round Feistel network, walked until it ends inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(count, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, key = index.astype(np.uint64), key.astype(np.uint64)
    going = np.arange(len(out))
    while len(going):
        h, m = half[going], mask[going]
        left, right = out[going] >> h, out[going] & m
        for turn in range(4):
            left, right = right, left ^ (spread_bits(right + spread_bits(key[going] + np.uint64(turn))) & m)
        out[going] = (left << h) | right
        going = going[out[going] >= count[going].astype(np.uint64)]
    return out.astype(np.int64)


def _key(*parts: np.ndarray | int) -> np.ndarray:
    out = np.zeros(1, dtype=np.uint64)
    for part in parts:
        out = spread_bits(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(part).astype(np.uint64) + np.uint64(1))
    return out


# --- slots ----------------------------------------------------------------------------


def draws(spark, made: Plan) -> DataFrame:
    """(shard, source, n, first): a multinomial draw of slots per shard, and the number of the first of them within its source."""
    total = int(made.slots.sum())
    chance = made.slots / max(total, 1)
    kept = np.flatnonzero(made.slots)
    fields = pa.schema([("shard", pa.int64()), ("source", pa.int32()), ("at", pa.int64()), ("n", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                size = min(made.shard, total - shard * made.shard)
                n = np.random.default_rng([made.seed, shard]).multinomial(size, chance[kept])
                some = n > 0
                n, source = n[some], kept[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(source, pa.int32()), pa.array(np.cumsum(n) - n), pa.array(n)], schema=fields)

    counts = spark.range(made.shards).mapInArrow(draw, "shard long, source int, at long, n long")
    # Rows of a source: one a shard of 65,536 slots.
    earlier = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _settled(made: Plan, drawn: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each source the pieces (from, to, source, shift) of its drawn slots: what lies above its slots goes to sources that drew too few."""
    short = [(t, int(made.slots[t]) - drawn[t]) for t in range(len(drawn)) if drawn[t] < made.slots[t]]
    given = {t: drawn[t] for t, _ in short}
    out: list[list[tuple[int, int, int, int]]] = []
    for s, n in enumerate(drawn):
        own = min(n, int(made.slots[s]))
        pieces = [(0, own, s, 0)] if own else []
        while own < n:
            t, lack = short[-1]
            some = min(lack, n - own)
            pieces.append((own, own + some, t, given[t] - own))
            given[t] += some
            own += some
            short[-1] = (t, lack - some)
            if lack == some:
                short.pop()
        out.append(pieces)
    return out


def slots(spark, made: Plan) -> DataFrame:
    """(shard, slot, source, block): every output slot and the block it holds; `source` is the number of the source in the plan.

    Draws are settled so that every source gets exactly its slots: the last ones of a source that drew too many go to those that drew too few.
    """
    drawn = draws(spark, made)
    got = dict(drawn.groupBy("source").agg(F.sum("n")).collect())
    pieces = _settled(made, [int(got.get(s, 0)) for s in range(len(made.sizes))])
    total = int(made.slots.sum())
    fields = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.int32()), ("block", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, source, at, n, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for low, high, target, shift in pieces[source]:
                    for a in range(max(low, first), min(high, first + n), BATCH):
                        k = np.arange(a, min(a + BATCH, high, first + n), dtype=np.int64)
                        place = at + k - first
                        size = min(made.shard, total - shard * made.shard)
                        slot = permuted(place, np.full(len(k), size), np.broadcast_to(_key(made.seed, 1, shard), len(k)))
                        k += shift
                        count = np.full(len(k), made.blocks[target])
                        block = permuted(k % count, count, _key(made.seed, 2, target, k // count))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(slot, pa.int32()), pa.array(np.full(len(k), target), pa.int32()), pa.array(block)], schema=fields)

    dealt = drawn.select("shard", "source", "at", "n", "first").repartition(-(-total // TASK_SLOTS) or 1, "shard", "source")
    return dealt.mapInArrow(fill, "shard long, slot int, source int, block long")


# --- blocks ---------------------------------------------------------------------------


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h): narrow rows of all documents; the only reading of the texts but for their output."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(f"`{text}`").alias("size"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("h"))


def placed(sized: DataFrame, made: Plan) -> DataFrame:
    """(doc_id, source, bucket, rank, h, size, start): each document's place in the words of its source, in hash order.

    (source, bucket, rank) is unique; buckets of a source are summed, so a hot source is many tasks.
    """
    sources = made.sources(sized.sparkSession)
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["name"])).select("doc_id", F.col("number").alias("source"), "size", "h", F.pmod("h", "buckets").cast("int").alias("bucket"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    local = rows.withColumns({"rank": F.row_number().over(inside), "through": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("size").over(W.partitionBy("source", "bucket"))})
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    joined = local.join(before.select("source", "bucket", "before"), ["source", "bucket"])
    return joined.select("doc_id", "source", "bucket", "rank", "h", "size", (F.col("before") + F.col("through") - F.col("size")).alias("start"))


def block_parts(located: DataFrame, block: int) -> DataFrame:
    """One row per document and block that it reaches into: `block`, `first` (word of the document) and `words` there; empty documents get
    one row without words under a block number of their own below 0."""
    end = F.col("start") + F.col("size")
    reached = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).otherwise(F.array(-1 - F.col("rank").cast("bigint") - F.lit(BUCKET) * F.col("bucket")))
    parts = located.withColumn("block", F.explode(reached))
    begin = F.greatest(F.col("block") * block, F.col("start"))
    words = F.when(F.col("size") > 0, F.least((F.col("block") + 1) * block, end) - begin).otherwise(0)
    return parts.withColumns({"first": begin - F.col("start"), "words": words})


@dataclass(frozen=True)
class Mix:
    """Slots are made by tasks from a handful of shard numbers, so Spark takes them for few: joins with them ask for a sorted merge."""

    made: Plan
    located: DataFrame
    slots: DataFrame
    block: int

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken (words the mix takes of the document) for every row of the documents."""
        times = self.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
        parts = block_parts(self.located, self.block).join(times.hint("merge"), ["source", "block"], "left")
        took = F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("bigint")
        rows = parts.groupBy("source", "bucket", "rank", "doc_id", "size").agg(took.alias("taken"))
        sources = self.made.sources(rows.sparkSession).withColumnRenamed("number", "source")
        return rows.join(sources, "source").select("doc_id", "size", "source_size", "target", "taken")

    def pieces(self) -> DataFrame:
        """shard, slot, source, block, start (first word of the block in its source), doc_id, h, first, words: what every slot holds, document by document."""
        parts = block_parts(self.located, self.block).filter("words > 0").select("source", "block", "start", "doc_id", "h", "first", "words")
        return self.slots.join(parts.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", (F.col("start") + F.col("first")).alias("start"), "doc_id", "h", "first", "words")

    def texts(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """shard, slot, source, text: the words of every slot, joined by single spaces. Each block's text is put together once and then copied to its slots."""
        words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({WORD})"))
        read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("h"), words.alias("_words")).dropDuplicates(["doc_id", "h"])
        parts = block_parts(self.located, self.block).filter("words > 0").withColumnRenamed("doc_id", "_doc")
        held = parts.join(read, parts["_doc"].eqNullSafe(read["doc_id"]) & (parts["h"] == read["h"]))
        piece = F.struct((F.col("start") + F.col("first")).alias("at"), F.slice("_words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")).alias("w"))
        # A block has `block` words, so at most as many pieces.
        whole = held.groupBy("source", "block").agg(F.array_sort(F.collect_list(piece)).alias("p"))
        block_text = whole.select("source", "block", F.array_join(F.flatten(F.transform("p", lambda x: x["w"])), " ").alias("text"))
        sources = self.made.sources(docs.sparkSession).select(F.col("number").alias("source"), "name")
        named = self.slots.join(block_text.hint("merge"), ["source", "block"]).join(sources, "source")
        return named.select("shard", "slot", F.col("name").alias("source"), "text")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shard: int = SHARD, seed: int = 12, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """A mix of all documents as large as all of them together.

    Sources by code point, null last, weigh `weights` in turn; a target is at most 3 times its source's words, and what is over is shared again.
    Words are runs outside space and the controls tab to carriage return. Null and empty texts have no words and are taken 0 times;
    repeated rows are documents of their own; a null doc_id is kept. The same rows, weights and seed give the same mix, whatever the number of tasks.
    An empty table gives an empty mix. A source's words are met to within about a block.
    """
    sized = cut(measured(docs, doc_id, text, source))
    made = plan(sized, weights, block, shard, seed)
    located = cut(placed(sized, made))
    return Mix(made, located, slots(docs.sparkSession, made), block)
