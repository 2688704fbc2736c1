import hashlib
import re

import pytest

from tickweave.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text) if len(m[0]) >= 24]
    found.sort()
    return [sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest()


CASES = [
    "", "token=abc", "token=abcdef", "API_KEY: 'abcdefgh'", "apikey = \"x.y/z+=-_1\"", "secret:token:abcdefg", "secret:token=abcdef", "PassWord=123456 passwd=1", "AKIA" + "Q" * 15, "AKIA" + "Q" * 16 + "aKIA",
    "AKIAAKIA" + "1" * 20, "0123456789abcdef01234567", "0123456789abcdef0123456", "日本 token = geheim12 é" + "a" * 30, "token=abcdef\ntoken=ghijkl" * 50, "x" * 5000 + "secret='deadbeefdeadbeefdeadbeef'", "\U0001f600password=\U0001f600", "tokentoken==abcdefg",
]


def test_base_spans_equal_brute_force(spark, docs, odd_docs, no_docs):
    crafted = spark.createDataFrame(list(enumerate(CASES)) + [(3, None)], "doc_id long, text string")
    for table in (crafted, docs, odd_docs):
        want = sorted((repr(i), *brute(t or "")) for i, t in table.select("doc_id", "text").collect())
        got = sorted((repr(r.doc_id), [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in secrets.report(table).collect())
        assert got == want
    assert secrets.report(no_docs).collect() == []


def test_text_of_very_many_matches(spark):
    texts = ["é token=abcdefgh" * n for n in (127, 128, 129, 257)] + ["token=abcdefgh\n" * 40_000]
    for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == brute(texts[r.doc_id])


def test_further_kinds_add_spans(spark):
    text = "see ghp_" + "Z9" * 18 + " and -----BEGIN RSA PRIVATE KEY----- Bearer " + "Z" * 24
    row = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.split(":")[0] for s in row.spans.split(",")] == ["github", "private", "bearer"]
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_queries_hold_for_matches(rule):
    query = secrets.trigram_query(rule)
    assert (query == []) == (rule.kind == "hex" or (rule.kind == "github"))
    if query:
        for text in CASES + ["ghp_" + "a" * 40, "xoxb-1234567890123", "AIza" + "b" * 40, "-----BEGIN PRIVATE KEY-----", "bearer " + "q" * 30]:
            if re.search(rule.pattern, text, re.I if rule.any_case else 0):
                assert any(all(t in text.lower() for t in a) for a in query)
