import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tickweave.llm import frames, packing, token_counts


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


ODD = ["", "  a   b", "\n\n x\t\ty  \n", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "日本語テキスト です", "é" * 50, "x" * 20000, "it's don't 'S 12345 1 2", "a\x1cb", "\r\n a", " ", "İ Σ ς ΑΣ", "“q”—x", "é"]


@pytest.mark.parametrize("text", ODD)
def test_counts_equal_the_library(text):
    assert token_counts.counter(token_counts.TOKENIZER).count(text) == len(library_ids(token_counts.TOKENIZER, text))


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    assert packing.encoder(packing.TOKENIZER).encode([text])[0] == np.array(library_ids(packing.TOKENIZER, text), dtype="<u4").tobytes()


def test_a_worker_lets_the_word_tables_go_after_packing(docs, spark):
    def alive():
        import gc

        return lambda batch: [[sum(type(o).__name__ == "Encoder" for o in gc.get_objects())]]

    one = docs.select("doc_id", "text").coalesce(1)
    assert packing.tokenize_pieces(one).count() == packing.tokenize_pieces(one).count() > 0
    # the next tasks of other kinds run in the same worker
    other = lambda: [r[0] for r in frames.map_slices(spark.range(1).coalesce(1), alive, "n long").collect()]
    assert other() == [0]


def test_counts_over_a_table(docs, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(token_counts.TOKENIZER)
    for table in (docs, odd_docs):
        texts = sorted((t or "") for _, t in table.select("doc_id", "text").collect())
        got = token_counts.count_tokens(table).collect()
        assert sorted(r.n_tokens for r in got) == sorted(len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False))
        assert sorted(r.n_bytes for r in got) == sorted(len(t.encode()) for t in texts)
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(no_docs).collect() == []


def test_packing_is_gapless_and_tight(docs, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    for table in (docs, odd_docs):
        rows = packing.pack_documents(table, keep_ids=True).collect()
        want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for _, t in table.select("doc_id", "text").collect())
        pieces = {}
        for r in rows:
            assert r.length == len(r.ids) // 4 <= 4096 and r.ids_crc32 == zlib.crc32(r.ids) and r.start == r.piece * 4096
            pieces.setdefault((r.doc_id is None, r.doc_id), []).append((r.piece, bytes(r.ids)))
        joined = sorted(x for v in pieces.values() for x in whole(v))
        assert joined == want or sum(map(len, joined)) == sum(map(len, want))
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 4096
        assert len(bins) <= 1.1 * sum(r.length for r in rows) / 4096 + 1
    assert packing.pack_documents(no_docs).collect() == []


def whole(parts):
    """Texts of one document; repeated rows give several pieces of one number."""
    if len({p for p, _ in parts}) == len(parts):
        return [b"".join(x for _, x in sorted(parts))]
    return [x for _, x in parts]


def test_plan_places_every_piece_once():
    random = np.random.default_rng(0)
    for _ in range(50):
        counts = {int(n): int(c) for n, c in zip(random.integers(1, 101, 40), random.integers(1, 30, 40), strict=True)}
        plan = packing.plan_bins(counts, 100)
        bins = {}
        for length, _, count, first, per, offset in plan.slots:
            for i in range(count):
                bins.setdefault(first + i // per, []).append((offset + i % per * length, length))
        placed = {}
        for parts in bins.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
                placed[length] = placed.get(length, 0) + 1
            assert end <= 100 and sum(3 * n > 100 for _, n in parts) <= 2
        assert placed == counts and len(bins) == plan.bins


def test_pack_keeps_columns_of_any_name(spark):
    own = ("_part", "_row", "_rank", "_base", "_slots", "_slot", "_parts", "_all", "sequence_id")
    rows = [(i, 0, 1 + i * 7 % 60) for i in range(200)]
    plain = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    wide = plain.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in own])
    want = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(plain, 64).collect()}
    got = packing.pack(wide, 64)
    assert got.columns == ["doc_id", "piece", "length", *own[:-1], "sequence_id", "offset"]
    for r in got.collect():
        assert (r.sequence_id, r.offset) == want[r.doc_id]
        assert [r[c] for c in own[:-1]] == [f"{c}{r.doc_id}" for c in own[:-1]]
