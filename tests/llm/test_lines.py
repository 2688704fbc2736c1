import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tickweave.llm import line_dedup as L


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_rises_and_matches(a, b):
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert pairs == [(i, i) for i in range(len(a))]
    if set(a) & set(b):
        assert pairs


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=9, unique=True))
def test_longest_chain(pairs):
    pairs = sorted(pairs)
    first = {}
    for i, j in pairs:
        first.setdefault(i, j)
    pairs = sorted(first.items())
    best = 0
    for mask in range(1 << len(pairs)):
        chosen = [p for k, p in enumerate(pairs) if mask >> k & 1]
        if all(x[1] < y[1] for x, y in zip(chosen, chosen[1:], strict=False)):
            best = max(best, len(chosen))
    assert len(L.longest_increasing(pairs)) == best


def brute(rows, min_words):
    """The same rules, one document after the other, over dictionaries."""
    texts = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "", i) for i, t in rows})
    first = {}
    for late, _, key, t, i in texts:
        first.setdefault(key, (late, i))
    docs = [(late, n, key, [x.strip() for x in t.split("\n")]) for late, n, key, t, i in texts if t and first[key] == (late, i)]
    source, gone = {}, {}

    def runs(lines):
        words = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            end, total = a, 0
            while end < len(lines) and total < min_words:
                total += words[end]
                end += 1
            if total < min_words:
                return
            if words[a]:
                yield tuple(lines[a:end])

    by_key = {d[2]: d[3] for d in docs}
    for *_, key, lines in docs:
        words = [len(x.split()) for x in lines]
        for other in {source[r] for r in runs(lines) if r in source}:
            gone.setdefault(key, set()).update(L.common_blocks(lines, by_key[other], words, min_words))
        for r in runs(lines):
            source.setdefault(r, key)
    out = []
    for i, t in rows:
        t = t or ""
        key, n = hashlib.md5(t.encode()).hexdigest(), len(t.split("\n"))
        if t and first[key] != (i is None, i):
            out.append((repr(i), n, n, repr(first[key][1]), ""))
        else:
            cut = gone.get(key, set())
            out.append((repr(i), n, len(cut), "None", "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)))
    return sorted(out)


def result(table):
    return sorted((repr(r.doc_id), r.n_lines, r.n_deleted, repr(r.copy_of), r.text) for r in L.line_dedup(table).collect())


def test_equals_brute_force(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        assert result(table) == brute(table.select("doc_id", "text").collect(), L.MIN_WORDS)
    assert L.line_dedup(no_docs).collect() == []
    assert L.line_dedup(odd_docs).columns == [*[c for c in odd_docs.columns if c != "n_lines"], "n_lines", "n_deleted", "copy_of"]


def test_shared_blocks_and_hot_passages(spark):
    draw = random.Random(2)
    line = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    passage, blocks, header = line(60), [[line(draw.randrange(3, 30)) for _ in range(5)] for _ in range(4)], line(9)
    rows = []
    for i in range(150):
        text = [header] + [line(draw.randrange(0, 25)) for _ in range(draw.randrange(1, 8))]
        if draw.random() < 0.4:
            text.insert(draw.randrange(len(text)), passage)
        if draw.random() < 0.5:
            at = draw.randrange(len(text))
            text[at:at] = draw.choice(blocks)[draw.randrange(3):]
        rows.append((i if i % 17 else None, "\n".join(text)))
    rows += [(draw.randrange(200, 400), rows[draw.randrange(20)][1]) for _ in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = result(table)
    assert got == brute(rows, L.MIN_WORDS)
    assert sum(passage in r[4] for r in got) == 1 and sum(header in r[4] for r in got) > 100


def brute_rare(rows, min_words, limit):
    """Lines that go when lines of at most `limit` distinct texts count as rare: {doc_id: places}; ids are distinct and texts differ."""
    docs = sorted((i, [x.strip() for x in t.split("\n")]) for i, t in rows)
    words = lambda x: len(x.split())
    held = {}
    for i, lines in docs:
        for x in set(lines):
            held.setdefault(x, []).append(i)
    rare = {x for x, at in held.items() if 0 < words(x) < min_words and 1 < len(at) <= limit}
    by_id, source, out = dict(docs), {}, {}
    for i, lines in docs:
        n = [words(x) for x in lines]
        runs = set()
        for a in range(len(lines)):
            end = next((e for e in range(a + 1, len(lines) + 1) if sum(n[a:e]) >= min_words), None)
            if end and n[a]:
                runs.add(tuple(lines[a:end]))
        few = rare & set(lines)
        for other in {source[r] for r in runs if r in source} | {held[x][0] for x in few if held[x][0] != i}:
            out.setdefault(i, set()).update(L.common_blocks(lines, by_id[other], n, min_words, few))
        for r in runs:
            source.setdefault(r, i)
    return {i: at for i, at in out.items() if at}


def test_short_rare_lines_beside_edited_ones_go(spark):
    header, rare = "one line at the top", "seven rare words that two texts share"
    rows = [(i, f"{header}\nfirst edit {i} of it\n{rare}\nlast edit {i} of it" if i in (3, 8) else f"{header}\nown words {i}") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    done = {r.doc_id: r for r in L.line_dedup(table, rare=L.RARE).collect()}
    assert done[8].text == f"{header}\nfirst edit 8 of it\nlast edit 8 of it" and done[8].n_deleted == 1
    assert all(done[i].text == t and done[i].n_deleted == 0 for i, t in rows if i != 8)


def test_rare_lines_equal_brute_force(spark, docs):
    rows, seen = [], set()
    for r in sorted(docs.filter("doc_id IS NOT NULL AND text <> ''").select("doc_id", "text").collect()):
        if r.text not in seen and (not rows or rows[-1][0] != r.doc_id):
            rows.append((r.doc_id, r.text))
            seen.add(r.text)
    want = brute_rare(rows, L.MIN_WORDS, L.RARE)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in L.line_dedup(table, rare=L.RARE).collect()}
    for i, t in rows:
        assert got[i].n_deleted == len(want.get(i, ())), i
        assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))
    assert sum(map(len, want.values())) > sum(r.n_deleted for r in L.line_dedup(table).collect())


def test_query_and_pipeline_use_rare_lines(spark, tmp_path):
    from corpus_pipeline import drop_copied_lines
    from tickweave.llm.queries import op2

    rows = [(i, f"edit {i} above\nfive words that were copied\nedit {i} below", "en", "s", 1) for i in (1, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for done in (op2(spark, str(tmp_path)), drop_copied_lines(spark, table, str(tmp_path))):
        assert {r.doc_id: r.text for r in done.collect()}[2] == "edit 2 above\nedit 2 below"


def test_repeated_and_crossing_blocks_go():
    assert L.common_blocks([1, 2, 1], [1], [30, 3, 30], 20) == [0, 2]
    assert L.common_blocks([1, 2], [1, 3, 1, 2], [12, 12], 20) == [0, 1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sets(st.integers(0, 4), max_size=1))
def test_no_long_common_run_stays(later, earlier, rare):
    words = [3 + x for x in later]
    gone = L.common_blocks(later, earlier, words, 12, rare)
    assert gone == sorted(set(gone))
    common = [range(a, b) for a in range(len(later)) for b in range(a + 1, len(later) + 1) if any(later[a:b] == earlier[j : j + b - a] for j in range(len(earlier)))]
    long = [r for r in common if sum(words[k] for k in r) >= 12 or rare & {later[k] for k in r}]
    assert all(set(r) & set(gone) for r in long)
    assert set(gone) <= {k for r in long for k in r}


def test_helper_names_as_input_columns(spark):
    rows = [(1, "the same short text"), (2, "the same short text"), (3, "edit a\nseven rare words that two texts share\nedit b"), (4, "edit c\nseven rare words that two texts share\nedit d"), (5, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    own = ("key", "_key", "_gone", "_first", "_copied", "_KEY_", "source", "rare", "lines", "rank", "mark")
    wide = plain.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in own])
    want = {r.doc_id: r for r in L.line_dedup(plain, rare=L.RARE).collect()}
    for r in L.line_dedup(wide, rare=L.RARE).collect():
        assert (r.text, r.n_deleted, r.copy_of) == (want[r.doc_id].text, want[r.doc_id].n_deleted, want[r.doc_id].copy_of)
        assert [r[c] for c in own] == [f"{c}{r.doc_id}" for c in own]
