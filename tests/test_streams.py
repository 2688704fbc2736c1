"""Book stream over several micro-batches against the batch twin; logs and monitor."""

import json
import os
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickweave.plans.series import index_rows  # noqa: F401  (import check)
from tickweave.streaming import book as K
from tickweave.streaming import messages as G
from tickweave.streaming import monitor as O


def messages(n=240, seed=3):
    """Messages of three assets; asset "1" gets most of them."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        asset = rnd.choice(["1", "1", "1", "2", "3"])
        stamp = str(1_700_000_000_000 + i * 700)
        level = lambda lo: {"price": f"{rnd.randint(lo, lo + 20) / 100:.2f}", "size": str(rnd.choice([0, 50, 75, 200]))}
        if i % 40 == 0:
            m = [{"event_type": "book", "asset_id": asset, "timestamp": stamp, "bids": [level(20), level(20)], "asks": [level(45)]}]
        elif i % 31 == 7:
            m = {"event_type": "last_trade_price", "asset_id": asset}
        else:
            side = rnd.choice(["BUY", "sell"])
            changes = [{"asset_id": asset, "side": side, **level(20 if side == "BUY" else 45)}, {"side": "BUY", "price": "1", "size": "1"}]
            m = {"event_type": "price_change", "timestamp": stamp, "price_changes": changes}
        out.append((i, "{broken" if i % 53 == 9 else json.dumps(m)))
    return out


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    """Six files written one after the other, so the stream reads them in order."""
    rows, folder = messages(), tmp_path_factory.mktemp("landed")
    for b in range(6):
        with open(folder / f"part-{b}.json", "w") as f:
            for seq, value in rows[b * 40 : (b + 1) * 40]:
                f.write(json.dumps({"seq": seq, "value": value}) + "\n")
        os.utime(folder / f"part-{b}.json", (time.time() - 100 + b, time.time() - 100 + b))
    return rows, str(folder)


def loop_tops(rows):
    """Top of every asset's book after each update, by a plain loop."""
    books, tops = {}, []
    for seq, text in rows:
        try:
            ms = json.loads(text)
        except ValueError:
            continue
        for m in ms if isinstance(ms, list) else [ms]:
            if m["event_type"] == "book":
                books[m["asset_id"]] = {(s, Decimal(x["price"])): Decimal(x["size"]) for s, k in (("BUY", "bids"), ("SELL", "asks")) for x in m[k] if Decimal(x["size"]) > 0}
                touched = [m["asset_id"]]
            elif m["event_type"] == "price_change":
                touched = []
                for c in m["price_changes"]:
                    if "asset_id" not in c:
                        continue
                    b = books.setdefault(c["asset_id"], {})
                    b.pop((c["side"].upper(), Decimal(c["price"])), None)
                    if Decimal(c["size"]) > 0:
                        b[(c["side"].upper(), Decimal(c["price"]))] = Decimal(c["size"])
                    touched.append(c["asset_id"])
            else:
                continue
            for a in touched:
                bids = [p for s, p in books[a] if s == "BUY"]
                asks = [p for s, p in books[a] if s == "SELL"]
                tops.append((a, seq, max(bids, default=None), min(asks, default=None)))
    return tops


def run(df, path, mark):
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def test_stream_book_equals_loop_and_batch(spark, landed, tmp_path):
    rows, folder = landed
    stream = G.route(G.parse_messages(G.message_stream(spark, folder, files_per_trigger=1)))
    run(K.book_state(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = spark.read.schema(K.TOP).parquet(str(tmp_path / "out"))
    seen = sorted((r.asset_id, r.seq, r.best_bid, r.best_ask) for r in got.collect())
    assert [(a, s) for a, s, *_ in seen] == [(a, s) for a, s, *_ in sorted(loop_tops(rows), key=lambda t: t[:2])]
    assert seen == sorted(loop_tops(rows), key=lambda t: t[:2])
    batch = K.top_of_book(K.book_state_batch(G.route(G.parse_messages(spark.createDataFrame(rows, "seq bigint, value string")))))
    cols = ("asset_id", "best_bid", "best_ask", "bid_size", "ask_size")
    last = K.latest(got).select(*cols)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_persistence_stream_equals_batch(spark, landed, tmp_path):
    _, folder = landed
    stream = G.route(G.parse_messages(G.message_stream(spark, folder, files_per_trigger=2)))
    run(K.persistence(K.pressure_signal(K.book_features(K.book_state(stream)))), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = spark.read.parquet(str(tmp_path / "out"))
    signals = got.select("asset_id", "seq", "msg_no", "item", "signal", F.timestamp_millis("timestamp_ms").alias("ts"))
    twin = K.persistence_batch(signals, order=["seq", "msg_no", "item"])
    a = sorted((r.asset_id, r.seq, r.run_count, r.age_seconds, r.active) for r in got.collect())
    b = sorted((r.asset_id, r.seq, r.run_count, r.age_seconds, r.active) for r in twin.collect())
    assert a == b and len({r[2] for r in a}) > 1


def test_logs_and_monitor(spark, landed, tmp_path):
    _, folder = landed
    read = lambda: G.route(G.parse_messages(G.message_stream(spark, folder, files_per_trigger=3)))
    O.log_sink(K.pressure_signal(K.book_features(K.book_state(read()))), str(tmp_path / "log"), str(tmp_path / "m1")).awaitTermination()
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert tuple(log.columns) == O.SNAPSHOT_LOG and log.count() > 0
    limits = {"max_spread": 1, "min_depth": 0}
    O.start_monitor(K.book_features(K.book_state(read())), str(tmp_path / "m"), str(tmp_path / "m2"), interval=None, **limits).awaitTermination()
    snaps = spark.read.parquet(str(tmp_path / "m" / "snapshots"))
    rows = landed[0]
    for tick in (0, 1):
        tops = {}
        for a, _, bid, ask in loop_tops(rows[: 120 * (tick + 1)]):
            if bid is not None and ask is not None:
                tops[a] = (bid, ask)
        got = {r.asset_id: (r.best_bid, r.best_ask) for r in snaps.filter(F.col("tick") == tick).collect()}
        assert got == tops
    state = spark.read.parquet(str(tmp_path / "m" / "state"))
    first, second = ({r.asset_id: r for r in state.filter(F.col("tick") == t).collect()} for t in (0, 1))
    for asset, r in second.items():
        before = first.get(asset)
        held = before.signal if before else "NEUTRAL"
        assert r.run_count == ((before.run_count if before else 0) + 1 if r.signal == held else 1)
        if r.signal == "NEUTRAL" and held == "NEUTRAL":
            assert r.first_seen_ms is None


def test_unknown_side_is_an_error(spark):
    text = json.dumps({"event_type": "price_change", "price_changes": [{"asset_id": "1", "side": "HOLD", "price": "1", "size": "1"}]})
    with pytest.raises(Exception, match="unknown side"):
        G.route(G.parse_messages(spark.createDataFrame([(1, text)], "seq bigint, value string"))).collect()


def test_repeated_delivery_is_dropped(spark, landed, tmp_path):
    rows, folder = landed
    stream = G.message_stream(spark, folder, files_per_trigger=2)
    twice = G.with_event_time(G.route(G.parse_messages(stream.unionByName(stream))), "1 hour")
    run(twice, str(tmp_path / "out"), str(tmp_path / "mark"))
    once = G.route(G.parse_messages(spark.createDataFrame(rows, "seq bigint, value string"))).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == once


def test_monitor_ticks_without_messages(spark, landed, tmp_path):
    _, folder = landed
    beats = tmp_path / "beats"
    beats.mkdir()
    for i in range(4):
        (beats / f"b{i}.json").write_text(json.dumps({"timestamp": f"2023-11-14 23:0{i}:00"}) + "\n")
        os.utime(beats / f"b{i}.json", (time.time() - 50 + i, time.time() - 50 + i))
    clock = spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).json(str(beats))
    # all messages come with the first beat; three ticks have none
    book = K.book_features(K.book_state(G.route(G.parse_messages(G.message_stream(spark, folder, files_per_trigger=6)))))
    O.start_monitor(book, str(tmp_path / "m"), str(tmp_path / "mark"), interval=None, beats=clock, max_spread=1, min_depth=0).awaitTermination()
    state = spark.read.parquet(str(tmp_path / "m" / "state"))
    # the last two ticks are kept
    assert sorted(r[0] for r in state.select("tick").distinct().collect()) == [2, 3]
    first, second = ({r.asset_id: r for r in state.filter(F.col("tick") == t).collect()} for t in (2, 3))
    assert set(first) == set(second) == {"1", "2", "3"}
    for asset, r in second.items():
        assert r.tradable and r.signal == first[asset].signal and r.run_count == first[asset].run_count + 1
        assert r.tick_ms - first[asset].tick_ms == 60_000 and r.timestamp_ms == first[asset].timestamp_ms and r.first_seen_ms == first[asset].first_seen_ms
    snapshots = spark.read.parquet(str(tmp_path / "m" / "snapshots"))
    assert {r.tick: r["count"] for r in snapshots.groupBy("tick").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 3}
    signals = spark.read.parquet(str(tmp_path / "m" / "signals"))
    for r in signals.filter("tick = 3").collect():
        assert r.run_count == second[r.asset_id].run_count and r.age_seconds == (second[r.asset_id].tick_ms - second[r.asset_id].first_seen_ms) / 1000


class States(dict):
    """Map state in memory that counts what is read and written."""

    reads = writes = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.reads += 1
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self[key]


def test_ladder_touches_few_pages():
    index, pages, want, rnd = States(), States(), {}, random.Random(4)
    whole = K.Ladder("BUY", index, pages)
    for p in range(10_000):
        whole.set(Decimal(p * 7919 % 10_000), Decimal(p + 1))
        want[Decimal(p * 7919 % 10_000)] = Decimal(p + 1)
    whole.save()
    assert sum(len(v[0]) for v in pages.values()) == 10_000 and max(len(v[0]) for v in pages.values()) <= K.PAGE
    for _ in range(300):
        index.reads = index.writes = pages.reads = pages.writes = 0
        ladder = K.Ladder("BUY", index, pages)
        # often the best level goes, so the next one must be known
        price = rnd.choice([max(want), min(want), Decimal(rnd.randrange(10_000))])
        size = Decimal(rnd.choice([0, 0, 5]))
        ladder.set(price, size)
        want.pop(price, None)
        if size:
            want[price] = size
        assert ladder.best(True) == (max(want), want[max(want)]) and ladder.best(False) == (min(want), want[min(want)])
        ladder.save()
        assert index.reads <= 1 and pages.reads <= 4 and pages.writes <= 2
    last = K.Ladder("BUY", index, pages)
    last.clear()
    last.save()
    assert not pages and K.Ladder("BUY", index, pages).best(True) == (None, None)
