import datetime

import duckdb

from tickweave.llm import decontamination as D
from tickweave.llm import url_lists as U

ITEM = "A train leaves Boston at 60 km per hour and meets another train after 3 hours so how far did Alice travel before she stopped to rest"
OTHER = "the quick committee of seven elders wrote down every rule they knew about winter grain storage and then hid the paper under stones"


def test_reparameterised_items_are_found(spark):
    other = ITEM.replace("Boston", "Denver").replace("60 km", "85 mi").replace("3 hours", "4.5 days").replace("Alice", "Bob")
    torn = "A train leaves Boston at 60 km per hour and meets another train after 3 hours. " + "no more"
    rows = [(1, f"some words before. {ITEM} and after"), (2, f"some words before. {other} and after"), (3, "nothing of the kind at all in this text of a dozen words or so"), (4, None), (5, ""), (None, ITEM), (1, f"some words before. {ITEM} and after"), (6, torn), (7, " ".join(OTHER.split()[3:17]))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, n long")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, OTHER), (None, OTHER)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (7, 12)}
    assert got[1, 10].verbatim and not got[2, 10].verbatim and got[2, 10].share == 1.0
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 4, 5, None], key=repr)
    assert D.leaks(docs.limit(0), items).collect() == D.leaks(docs, items.limit(0)).collect() == []


def test_inconsistent_slots_are_no_leak(spark):
    item = "if Anna has 5 apples and 5 pears then 5 of them and 5 more go to Anna who keeps 5 for Anna"
    other = "if Cora has 1 apples and 2 pears then 3 of them and 4 more go to Dora who keeps 6 for Emma"
    docs = spark.createDataFrame([(1, other), (2, item.replace("5", "9").replace("Anna", "Zoe"))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in D.leaks(docs, items).collect()] == [2]


def test_folders_match_in_their_own_case(spark):
    day = datetime.date(2024, 1, 1)
    entries = spark.createDataFrame([("block", "prefix", "EX.com/Docs", "add", day), ("block", "host", "Site.ORG", "add", day), ("block", "domain", "Net.Org", "add", day)], "list string, kind string, value string, action string, at date")
    urls = ["https://ex.com/Docs/a", "https://EX.com/Docs", "https://ex.com/docs/a", "https://ex.com/Docsy", "http://SITE.org/X", "http://a.net.org/", "http://site.org.uk/"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    got = {r.page_id: r.rules for r in U.judge(captures, entries).collect()}
    assert got == {0: "block:prefix:ex.com/Docs", 1: "block:prefix:ex.com/Docs", 2: "", 3: "", 4: "block:host:site.org", 5: "block:domain:net.org", 6: ""}


def test_shuffled_join_gives_the_same(spark, docs, monkeypatch):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(D.leaks(docs, benchmark).collect())
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(D.leaks(docs, benchmark).collect()) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    assert sorted((r[0], r[1], r[3]) for r in con.execute(D.LEAKS_SQL).fetchall()) == [(r.doc_id, r.item_id, r.n_found) for r in want]


def day(n):
    return datetime.date(2024, 1, n)


def test_entries_hold_from_addition_to_removal(spark):
    entries = spark.createDataFrame(
        [
            ("block", "host", "Bad.example.com", "add", day(5)), ("block", "host", "bad.example.com", "remove", day(10)), ("block", "host", "bad.example.com", "add", day(20)), ("block", "host", "bad.example.com", "add", day(22)),
            ("block", "domain", "evil.org", "add", day(3)), ("allow", "prefix", "a.evil.org/good", "add", day(4)), ("block", "prefix", "c.net/x/y", "add", day(1)),
            ("block", "host", "same.day", "add", day(7)), ("block", "host", "same.day", "remove", day(7)), ("block", "host", None, "add", day(1)), ("block", "host", "odd.net", "paused", day(1)),
        ],
        "list string, kind string, value string, action string, at date",
    )
    cases = [
        ("http://bad.example.com/p", 4, False), ("http://BAD.example.com:80/p?q#f", 5, True), ("http://bad.example.com/", 9, True), ("http://bad.example.com", 10, False), ("https://u:p@bad.example.com/", 25, True),
        ("http://evil.org/", 3, True), ("http://b.a.evil.org/good", 5, True), ("http://a.evil.org/good/1", 5, False), ("http://a.evil.org/good/1", 3, True), ("http://notevil.org/", 9, False),
        ("http://c.net/x/y/z", 2, True), ("http://c.net/x", 2, False), ("http://same.day/", 8, False), ("no url", 9, False), ("", 9, False), ("http://odd.net/", 9, False),
    ]
    rows = [(i, u, day(d), "clash") for i, (u, d, _) in enumerate(cases)] + [(90, None, day(5), "c"), (91, "http://evil.org/", None, "c"), (None, "http://evil.org/", day(5), "c"), (5, "http://evil.org/", day(3), "c")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, host string")
    got = U.judge(captures, entries).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r.blocked)
    want = {i: [b] for i, (_, _, b) in enumerate(cases)} | {90: [False], 91: [False], None: [True], 5: [True, True]}
    assert by_id == want
    assert U.judge(captures.limit(0), entries).collect() == [] and not any(r.blocked for r in U.judge(captures, entries.limit(0)).collect())


def test_prefix_entries_of_any_depth_match(spark):
    entries = spark.sql("SELECT 'block' AS list, 'prefix' AS kind, 'a.org/1/2/3/4/5/6/7/8/9' AS value, 'add' AS action, DATE '2024-01-01' AS at")
    captures = spark.sql("SELECT id AS page_id, url, DATE '2024-02-01' AS fetched FROM VALUES (1, 'http://a.org/1/2/3/4/5/6/7/8/9/10?q'), (2, 'http://a.org/1/2/3/4/5/6/7/8'), (3, 'http://a.org') AS t(id, url)")
    assert {r.page_id: r.blocked for r in U.judge(captures, entries).collect()} == {1: True, 2: False, 3: False}
