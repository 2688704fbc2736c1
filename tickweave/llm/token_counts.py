"""Exact token counts by merging adjacent pairs from a heap over a linked list.

A pretoken's symbols stand in a doubly linked list; a heap holds its adjacent pairs by (rank, place).
The lowest pair is popped, merged, and the pairs it forms with its new neighbours are pushed; entries
whose symbols have changed meanwhile are skipped. The count is the initial symbols less the merges, so
no identifiers are made. Pretokens repeat, so counts are kept in a bounded table per task.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.frames import map_slices, pick, texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Entries of the per-task table of known counts; it is emptied when full.
KNOWN = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


#: Bits of a heap entry that hold the place; the rank stands above them.
_PLACE_BITS = 40
_PLACE = (1 << _PLACE_BITS) - 1


def merges_of(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Merges that byte-pair encoding makes in one pretoken.

    `ranks` gives the rank of a pair a << 20 | b of symbols, `merged` the symbol that a rank makes.
    """
    n = len(symbols)
    rank_at = [ranks.get(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
    heap = [r << _PLACE_BITS | i for i, r in enumerate(rank_at) if r >= 0]
    if not heap:
        return 0
    rank_at.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    done = 0
    while heap:
        entry = heapq.heappop(heap)
        i, r = entry & _PLACE, entry >> _PLACE_BITS
        if rank_at[i] != r:
            continue
        j = after[i]
        k = after[j]
        symbols[i] = s = merged[r]
        after[i], rank_at[j] = k, -1
        done += 1
        if k < n:
            before[k] = i
            rank_at[i] = r = ranks.get(s << 20 | symbols[k], -1)
            if r >= 0:
                heapq.heappush(heap, r << _PLACE_BITS | i)
        else:
            rank_at[i] = -1
        h = before[i]
        if h >= 0:
            rank_at[h] = r = ranks.get(symbols[h] << 20 | s, -1)
            if r >= 0:
                heapq.heappush(heap, r << _PLACE_BITS | h)
    return done


class Counter:
    """Counts the tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: a byte-level BPE file without a normalizer is asked for")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        number = {letter: i for i, letter in enumerate(byte_letters())}
        for left, right in pairs:
            number.setdefault(left + right, len(number))
        self.ranks = {number[a] << 20 | number[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [number[a + b] for a, b in pairs]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pretokens: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def pretoken(self, word: str) -> int:
        n = self.pretokens.get(word)
        if n is None:
            symbols = list(word.encode("utf-8"))
            n = len(symbols) - merges_of(symbols, self.ranks, self.merged)
            if len(self.pretokens) >= KNOWN:
                self.pretokens.clear()
            self.pretokens[word] = n
        return n

    def whole(self, text: str) -> int:
        return sum(map(self.pretoken, self.pattern.findall(text)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. Where no two blanks meet, it falls apart before each blank."""
        if "  " in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        known = self.pieces
        total = self.whole(first)
        for piece in rest:
            n = known.get(piece)
            if n is None:
                n = self.whole(" " + piece)
                if len(known) >= KNOWN:
                    known.clear()
                known[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 1024, path: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of `docs`; one pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids stay as they are; other columns are not
    read. A text of any length is counted whole, in time n·log n for its longest run without blanks.
    """

    def make():
        model = counter(path)

        def step(batch: pa.RecordBatch):
            rows = texts(batch.column(1))
            return batch.column(0), [len(t.encode("utf-8")) for t in rows], [model.count(t) for t in rows]

        return step

    slim = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    counted = map_slices(slim, make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
