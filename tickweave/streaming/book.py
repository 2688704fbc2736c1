"""Order-book state, top-of-book features, pressure signals and their persistence."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.operators.series import run_length
from tickweave.operators.select import tradable
from tickweave.streaming.messages import PRICE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER = ("seq", "msg_no", "item")
TOP = f"asset_id string, seq bigint, msg_no int, item int, timestamp_ms bigint, best_bid {PRICE}, best_ask {PRICE}, bid_size {PRICE}, ask_size {PRICE}"


# --- batch ---------------------------------------------------------------------------------


def book_state_batch(updates: DataFrame) -> DataFrame:
    """Levels alive after the last update: newest size per (asset, side, price), not older than the last reset.

    Resets share the aggregate (their side and price are NULL), so the messages
    are read once and a hot asset merges before the shuffle. The window that
    follows sees one row per price level.
    """
    at = F.struct(*ORDER)
    newest = updates.groupBy("asset_id", "side", "price").agg(F.max_by("size", at).alias("size"), F.max(at).alias("_at"))
    reset = F.max(F.when(F.col("side").isNull(), F.col("_at"))).over(W.partitionBy("asset_id"))
    levels = newest.withColumn("_reset", reset).filter(F.col("side").isNotNull())
    alive = levels.filter(F.col("_reset").isNull() | (F.col("_at") > F.col("_reset")))
    return alive.filter(F.col("size") > 0).select("asset_id", "side", "price", "size")


def top_of_book(levels: DataFrame) -> DataFrame:
    bid, ask = F.col("side") == "BUY", F.col("side") == "SELL"
    p, s = F.col("price"), F.col("size")
    return levels.groupBy("asset_id").agg(
        F.max(F.when(bid, p)).alias("best_bid"), F.max_by(F.when(bid, s), F.when(bid, p)).alias("bid_size"),
        F.min(F.when(ask, p)).alias("best_ask"), F.min_by(F.when(ask, s), F.when(ask, p)).alias("ask_size"),
    )


# --- features and signals (stream or batch) -------------------------------------------------


def book_features(top: DataFrame) -> DataFrame:
    """Spread, mid, imbalance, microprice and depth; rows without a usable book drop out."""
    usable = top.filter(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull() & (F.col("bid_size") + F.col("ask_size") > 0))
    bid, ask, b, a = (F.col(c) for c in ("best_bid", "best_ask", "bid_size", "ask_size"))
    total = b + a
    return usable.withColumns(
        {
            "spread": ask - bid,
            "mid_price": ((bid + ask) / 2).cast("decimal(20,8)"),
            "imbalance": (b / total).cast("decimal(20,12)"),
            "microprice": ((ask * b + bid * a) / total).cast("decimal(20,12)"),
            "depth": total,
        }
    ).withColumn("edge", F.col("microprice") - F.col("mid_price"))


def pressure_signal(features: DataFrame, min_edge: str = "0.002", buy: str = "0.65", sell: str = "0.35") -> DataFrame:
    d = lambda v: F.lit(Decimal(v))
    up = (F.col("edge") >= d(min_edge)) & (F.col("imbalance") >= d(buy))
    down = (F.col("edge") <= -d(min_edge)) & (F.col("imbalance") <= d(sell))
    return features.withColumn("signal", F.when(up, "BUY_PRESSURE").when(down, "SELL_PRESSURE").otherwise("NEUTRAL"))


def persistence_batch(signals: DataFrame, keys: Sequence[str] = ("asset_id",), order: Sequence[str] = ("seq",), ts: str = "ts", min_count: int = 2, bounded: bool = False) -> DataFrame:
    """Consecutive count, run start, age; active = not neutral and seen at least ``min_count`` times.

    A tracker begins neutral with no start time, so a first run of NEUTRAL has none.
    """
    runs = run_length(signals, "signal", keys, order, ts, bounded, opening="_opening")
    opening = (F.col("signal") == "NEUTRAL") & F.col("_opening")
    start = F.when(~opening, F.col("run_start"))
    age = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
    return runs.withColumns(
        {
            "first_seen": start,
            "age_seconds": F.coalesce(age, F.lit(0.0)),
            "active": (F.col("signal") != "NEUTRAL") & (F.col("run_count") >= min_count),
        }
    ).drop("_opening", "run_start")


def latest(features: DataFrame, keys: Sequence[str] = ("asset_id",), order: Sequence[str] = ORDER) -> DataFrame:
    """Newest features per asset; on a stream use output mode "update"."""
    rest = [c for c in features.columns if c not in keys]
    return features.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def periodic_snapshots(features: DataFrame, ts: str = "event_time", every: str = "5 seconds", order: Sequence[str] = ORDER) -> DataFrame:
    """Event-time twin of the monitor: last features of each asset per tumbling window."""
    keys = ["asset_id"]
    rest = [c for c in features.columns if c not in keys]
    last = features.groupBy(F.window(ts, every).alias("_w"), *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return last.select(F.col("_w.end").cast("timestamp_ntz").alias("snapshot_time"), *keys, "_f.*")


def top_lists(features: DataFrame, n: int = 5) -> DataFrame:
    """Widest spreads, strongest buy and sell imbalance, deepest books among tradable assets."""
    t = tradable(features)
    lists = {
        "spread": F.col("spread").desc(), "buy_imbalance": F.col("imbalance").desc(), "sell_imbalance": F.col("imbalance").asc(), "depth": F.col("depth").desc(),
    }
    out = None
    for name, order in lists.items():
        rows = t.orderBy(order, "asset_id").limit(n).withColumn("list", F.lit(name))
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy("list").orderBy(order, "asset_id")))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- streaming state -------------------------------------------------------------------------


PAGE = 128


class Ladder:
    """Price levels of one side of one book, ascending, in pages of at most ``PAGE`` levels.

    Only the list of pages (their lowest prices) is read with every batch; a page is read when an update or
    the best price needs it, and written back when it changed. An update touches one page, however deep the book.
    """

    def __init__(self, side: str, index, pages) -> None:
        self.side, self.index, self.pages = side, index, pages
        lows, ids, self.next = index.getValue((side,)) if index.containsKey((side,)) else ([], [], 0)
        self.lows, self.ids = [Decimal(p) for p in lows], list(ids)
        self.loaded: dict[int, tuple[list[Decimal], list[Decimal]]] = {}
        self.changed: set[int] = set()
        self.dropped: set[int] = set()
        self.moved = False

    def _page(self, at: int) -> tuple[list[Decimal], list[Decimal]]:
        number = self.ids[at]
        if number not in self.loaded:
            prices, sizes = self.pages.getValue((self.side, number))
            self.loaded[number] = [Decimal(p) for p in prices], [Decimal(x) for x in sizes]
        return self.loaded[number]

    def _new_page(self, at: int, prices: list[Decimal], sizes: list[Decimal]) -> None:
        self.lows.insert(at, prices[0])
        self.ids.insert(at, self.next)
        self.loaded[self.next] = prices, sizes
        self.changed.add(self.next)
        self.next += 1
        self.moved = True

    def _drop_page(self, at: int) -> None:
        number = self.ids.pop(at)
        self.lows.pop(at)
        self.loaded.pop(number, None)
        self.changed.discard(number)
        self.dropped.add(number)
        self.moved = True

    def set(self, price: Decimal, size: Decimal) -> None:
        """New size of a level; zero or less takes the level away."""
        if not self.ids:
            if size > 0:
                self._new_page(0, [price], [size])
            return
        at = max(bisect_right(self.lows, price) - 1, 0)
        prices, sizes = self._page(at)
        i = bisect_left(prices, price)
        found = i < len(prices) and prices[i] == price
        if size > 0 and found:
            sizes[i] = size
        elif size > 0:
            prices.insert(i, price)
            sizes.insert(i, size)
        elif found:
            del prices[i], sizes[i]
        else:
            return
        self.changed.add(self.ids[at])
        if not prices:
            self._drop_page(at)
        elif len(prices) > PAGE:
            half = len(prices) // 2
            self._new_page(at + 1, prices[half:], sizes[half:])
            del prices[half:], sizes[half:]

    def clear(self) -> None:
        while self.ids:
            self._drop_page(len(self.ids) - 1)

    def best(self, highest: bool) -> tuple[Decimal | None, Decimal | None]:
        if not self.ids:
            return None, None
        end = -1 if highest else 0
        prices, sizes = self._page(len(self.ids) - 1 if highest else 0)
        return prices[end], sizes[end]

    def save(self) -> None:
        for number in self.dropped:
            if self.pages.containsKey((self.side, number)):
                self.pages.removeKey((self.side, number))
        for number in self.changed:
            prices, sizes = self.loaded[number]
            self.pages.updateValue((self.side, number), ([str(p) for p in prices], [str(x) for x in sizes]))
        if self.moved:
            self.index.updateValue((self.side,), ([str(p) for p in self.lows], self.ids, self.next))


class BookProcessor(StatefulProcessor):
    """Keeps the price levels of one asset and emits the top of the book after every update."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getMapState("index", "side string", "lows array<string>, ids array<int>, next int")
        self.pages = handle.getMapState("pages", "side string, page int", "prices array<string>, sizes array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one asset's updates of one micro-batch, which the source's rate limit bounds; the shuffle keeps no order
        pdf = pd.concat(list(rows)).sort_values(list(ORDER), ignore_index=True)
        book = {side: Ladder(side, self.index, self.pages) for side in ("BUY", "SELL")}
        out = []
        marks = list(zip(pdf["seq"], pdf["msg_no"], pdf["kind"]))
        for i, r in enumerate(pdf.itertuples(index=False)):
            if r.kind == "reset":
                for ladder in book.values():
                    ladder.clear()
            else:
                book[r.side].set(r.price, r.size)
            # a snapshot is one update: wait for its last level
            if r.kind != "level" and i + 1 < len(marks) and marks[i + 1] == (r.seq, r.msg_no, "snapshot"):
                continue
            (bid, bid_size), (ask, ask_size) = book["BUY"].best(True), book["SELL"].best(False)
            out.append((key[0], r.seq, r.msg_no, r.item, r.timestamp_ms, bid, ask, bid_size, ask_size))
        for ladder in book.values():
            ladder.save()
        columns = [c.split()[0] for c in TOP.split(", ")]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


class PersistenceProcessor(StatefulProcessor):
    """Consecutive count and start of the current signal of one asset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "signal string, count bigint, first_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(list(ORDER), ignore_index=True)
        signal, count, first = self.run.get() if self.run.exists() else ("NEUTRAL", 0, None)
        counts, firsts = [], []
        for s, now in zip(pdf["signal"], pdf["timestamp_ms"]):
            if s == signal:
                count += 1
            else:
                signal, count, first = s, 1, int(now)
            counts.append(count)
            firsts.append(first)
        self.run.update((signal, count, first))
        first_ms = pd.array(firsts, dtype="Int64")
        age = (pdf["timestamp_ms"].astype("Int64") - first_ms).fillna(0).astype("float64") / 1000
        yield pdf.assign(run_count=counts, first_seen_ms=first_ms, age_seconds=age)

    def close(self) -> None:
        pass


def book_state(updates: DataFrame, output_mode: str = "append") -> DataFrame:
    """Stream of top-of-book rows, state partitioned by asset."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return updates.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=BookProcessor(), outputStructType=TOP, outputMode=output_mode, timeMode="None"
    )


def persistence(signals: DataFrame, output_mode: str = "append", min_count: int = 2) -> DataFrame:
    """Stream of signals with their persistence."""
    signals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema)
    out = signals.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=PersistenceProcessor(), outputStructType=f"{fields}, run_count bigint, first_seen_ms bigint, age_seconds double", outputMode=output_mode, timeMode="None"
    )
    return out.withColumn("active", (F.col("signal") != "NEUTRAL") & (F.col("run_count") >= min_count))
