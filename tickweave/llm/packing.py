"""Best-fit packing of token pieces into sequences, large pieces by matching first.

Lengths are whole numbers up to the capacity, so the packing itself is decided on the histogram of lengths, whose
size the capacity bounds and the data does not: pieces above a third of the capacity go at most two to a bin, the
largest left with the largest that still fits beside it; the others, longest first, go to the smallest gap that
takes them. Bins that look alike are one run, so a step places a whole run. Pieces are then numbered within
their length and read their place from the plan.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.llm.frames import kept, map_slices, pick, texts
from tickweave.llm.token_counts import byte_letters
from tickweave.session import cut

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END_ID = 1
#: Entries of the per-task tables of known words; a table is emptied when full.
KNOWN = 250_000
#: Pieces of one length that one task numbers, about.
NUMBERED_TOGETHER = 20_000

#: Texts of these characters only are lowered and split without the library: no composition, no special casing.
_SIMPLE = re.compile("[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
#: The split pattern of the vocabulary file, for such texts.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, as the library gives them.

    The vocabulary drops white space and never merges across it, so the ids of a simple text are those of its words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            out = self.packed([t.id for t in self.model.tokenize(spelt)])
            if len(self.words) >= KNOWN:
                self.words.clear()
            self.words[word] = out
        return out

    def learn(self, chunks: set[str]) -> None:
        if len(self.chunks) > KNOWN:
            self.chunks.clear()
        for c in chunks:
            self.chunks[c] = b"".join(map(self.word, _WORDS.findall(c)))

    def encode(self, rows: list[str]) -> list[bytes]:
        split = [t.lower().split() if _SIMPLE.fullmatch(t) and "<|" not in t else None for t in rows]
        out = []
        for text, chunks in zip(rows, split, strict=True):
            if chunks is None:
                out.append(self.packed(self.library.encode(text, add_special_tokens=False).ids))
                continue
            known = self.chunks
            distinct = set(chunks)
            self.learn(distinct if len(known) > KNOWN else distinct.difference(filter(known.__contains__, distinct)))
            out.append(b"".join(map(known.__getitem__, chunks)))
        return out


def encoder(path: str) -> Encoder:
    return kept(path, lambda: Encoder(path))


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids: little-endian unsigned 32-bit numbers) per piece of a document.

    A document is its ids and the end id; only longer ones than `capacity` are cut. Null text is empty: one piece with the end id.
    """

    def make():
        model = encoder(path)

        def step(batch: pa.RecordBatch):
            ids, piece, start, length, crc, kept = [], [], [], [], [], []
            for name, packed in zip(batch.column(0).to_pylist(), model.encode(texts(batch.column(1))), strict=True):
                packed += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    ids.append(name), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            return [ids, piece, start, length, crc] + ([kept] if keep_ids else [])

        return step

    slim = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_slices(slim, make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


@dataclass
class Plan:
    """Where the pieces of each length go: (length, first rank, count, first bin, pieces a bin, offset in it)."""

    capacity: int
    bins: int = 0
    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    _next: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    _runs: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    _gaps: list[int] = field(default_factory=list)

    def put(self, length: int, count: int, bin_from: int, per_bin: int, offset: int) -> None:
        self.slots.append((length, self._next[length], count, bin_from, per_bin, offset))
        self._next[length] += count

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def leave(self, gap: int, bin_from: int, count: int) -> None:
        if gap and count:
            if not self._runs[gap]:
                bisect.insort(self._gaps, gap)
            self._runs[gap].append((bin_from, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A run of bins with the smallest gap that takes `length`: gap, first bin, count."""
        at = bisect.bisect_left(self._gaps, length)
        if at == len(self._gaps):
            return None
        gap = self._gaps[at]
        run = self._runs[gap].pop()
        if not self._runs[gap]:
            del self._gaps[at]
        return gap, *run

    def match_large(self, counts: dict[int, int]) -> None:
        left = {n: c for n, c in counts.items() if 3 * n > self.capacity}
        order = sorted(left)
        while order:
            a = order[-1]
            at = bisect.bisect_right(order, self.capacity - a) - 1
            b = order[at] if at >= 0 else None
            if b == a and left[a] == 1:
                b = order[at - 1] if at else None
            many = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            first = self.open(many)
            self.put(a, many, first, 1, 0)
            left[a] -= many
            if b is not None:
                self.put(b, many, first, 1, a)
                left[b] -= many
            self.leave(self.capacity - a - (b or 0), first, many)
            for n in {a, b} - {None}:
                if not left[n]:
                    order.remove(n)

    def fit_small(self, counts: dict[int, int]) -> None:
        for n in sorted((n for n in counts if 3 * n <= self.capacity), reverse=True):
            count = counts[n]
            while count:
                found = self.take(n)
                if found is None:
                    many = -(-count // (self.capacity // n))
                    found = self.capacity, self.open(many), many
                gap, first, bins = found
                per = gap // n
                full = min(bins, count // per)
                if full:
                    self.put(n, full * per, first, per, self.capacity - gap)
                    self.leave(gap - per * n, first, full)
                    count -= full * per
                if full < bins:
                    rest = min(count, per) if count < per else 0
                    if rest:
                        self.put(n, rest, first + full, per, self.capacity - gap)
                        self.leave(gap - rest * n, first + full, 1)
                        count = 0
                        full += 1
                    self.leave(gap, first + full, bins - full)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(capacity)
    plan.match_large(counts)
    plan.fit_small(counts)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `pieces` (doc_id, piece, length and any others) with sequence_id and offset, gapless from 0; such columns of the input are replaced.

    `pieces` is read twice, so it should be a table or checkpoint. What reaches the driver is one row per length.
    Lengths run from 1 to `capacity`; no rows give no rows.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots: dict[int, list] = defaultdict(list)
    for length, *slot in plan_bins(counts, capacity).slots:
        slots[length].append(tuple(slot))
    # One row per length, at most `capacity` rows: a bounded broadcast.
    plan = F.broadcast(
        spark.createDataFrame(
            [(n, max(1, counts[n] // NUMBERED_TOGETHER), sorted(s)) for n, s in slots.items()],
            "length long, _parts int, _slots array<struct<rank:long, n:long, bin:long, per:long, off:long>>",
        )
    )
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    tie = [c for c in ("ids_crc32",) if c in columns]
    # The input's own columns travel in one struct, so no helper clashes with them.
    rows = pieces.select("length", "doc_id", "piece", *tie, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))
    dealt = rows.join(plan, "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("length", "_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = W.partitionBy("length", "_part").orderBy("doc_id", "piece", *tie)
    ranked = dealt.withColumn("_row", F.row_number().over(order)).join(parts, ["length", "_part"])
    rank = F.col("_base") + F.col("_row") - 1
    slot = F.element_at(F.filter("_slots", lambda s: s["rank"] <= F.col("_rank")), -1)
    at = F.col("_rank") - F.col("_slot.rank")
    return ranked.withColumn("_rank", rank).withColumn("_slot", slot).select(
        *[F.col("_all")[c].alias(c) for c in columns],
        (F.col("_slot.bin") + F.floor(at / F.col("_slot.per"))).cast("bigint").alias("sequence_id"),
        (F.col("_slot.off") + at % F.col("_slot.per") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset.

    Null ids and repeated rows are packed like any other; other columns are not read; an empty table gives no rows.
    """
    return pack(cut(tokenize_pieces(docs, capacity, path, keep_ids, doc_id, text)), capacity)
