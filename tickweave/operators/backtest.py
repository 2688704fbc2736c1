"""Pair signals, trade matching, equity and performance, event studies, rule signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.scalars import ratio
from tickweave.operators.series import rolled
from tickweave.plans.series import index_rows, over_series, running
from tickweave.plans.spread import DRAWS, hash_draw, salted_join
from tickweave.session import cut

PAIR = ("leader", "follower")
NOTIONAL, COST, MIN_PRICE = 100_000.0, 0.0035, 10.0
LEADER_EDGE, FOLLOWER_EDGE, SMA = 0.006, 0.002, 15


def pair_bars(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Leader and follower prices per pair-day of the universe (leader, follower, trading_day), one scan for all pairs."""
    left = bars.select(F.col("symbol").alias("leader"), F.to_date("ts").alias("trading_day"), "ts", F.col("close").alias("leader_price"))
    right = bars.select(F.col("symbol").alias("follower"), "ts", F.col("close").alias("follower_price"))
    return left.join(universe.select(*PAIR, "trading_day"), ["leader", "trading_day"]).join(right, ["follower", "ts"])


def pair_prices(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leader and follower prices of each pair over all days."""
    left = bars.select(F.col("symbol").alias("leader"), "ts", F.col("close").alias("leader_price"))
    right = bars.select(F.col("symbol").alias("follower"), "ts", F.col("close").alias("follower_price"))
    joined = salted_join(left, pairs.select(*PAIR), ["leader"], ["ts"]).join(right, ["follower", "ts"])
    return joined.withColumn("trading_day", F.to_date("ts"))


def _signal_columns(d: DataFrame, w, leader_edge: float, follower_edge: float, n: int) -> DataFrame:
    d = d.withColumns({"leader_sma": rolled("mean", "leader_price", n, w), "follower_sma": rolled("mean", "follower_price", n, w)})
    lead, lead_sma, foll, foll_sma = (F.col(c) for c in ("leader_price", "leader_sma", "follower_price", "follower_sma"))
    # the follower is tested with "<" on both sides, as in the source rule
    long = (lead > lead_sma * (1 + leader_edge)) & (foll < foll_sma * (1 + follower_edge))
    short = (lead < lead_sma * (1 - leader_edge)) & (foll < foll_sma * (1 - follower_edge))
    return d.withColumns({"long_signal": F.coalesce(long, F.lit(False)), "short_signal": F.coalesce(short, F.lit(False))})


def pair_signals(prices: DataFrame, leader_edge: float = LEADER_EDGE, follower_edge: float = FOLLOWER_EDGE, n: int = SMA) -> DataFrame:
    """Signals with means that start afresh each pair-day (at most one row per minute of a day)."""
    return _signal_columns(prices, W.partitionBy(*PAIR, "trading_day").orderBy("ts"), leader_edge, follower_edge, n)


def _seconds(clock: str) -> int:
    hours, minutes = clock.split(":")
    return int(hours) * 3600 + int(minutes) * 60


def match_trades(
    signals: DataFrame, notional: float = NOTIONAL, cost: float = COST, min_price: float = MIN_PRICE, start: str = "09:30", end: str = "15:55"
) -> DataFrame:
    """At most one trade per pair and day.

    Entry: first usable bar with a signal. Exit: first later usable bar where the
    leader is back across its mean, or the end of the session. A day without an
    exit bar gives no trade. Both ends of the session belong to it, to the second: 15:55:30 is outside.
    """
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts"))
    usable = clock.between(_seconds(start), _seconds(end)) & ~F.coalesce(F.col("follower_price") <= min_price, F.lit(False))
    day = W.partitionBy(*PAIR, "trading_day")
    side = F.when(F.col("long_signal"), "long").when(F.col("short_signal"), "short")
    entry = F.min_by(F.struct(F.col("ts").alias("ts"), side.alias("side"), F.col("follower_price").alias("price")), F.when(usable & side.isNotNull(), F.col("ts")))
    rows = signals.withColumn("_in", entry.over(day)).filter(F.col("_in").isNotNull())
    back = F.when(F.col("_in.side") == "long", F.col("leader_price") < F.col("leader_sma")).otherwise(F.col("leader_price") > F.col("leader_sma"))
    forced = clock >= _seconds(end)
    exits = usable & (F.col("ts") > F.col("_in.ts")) & (F.coalesce(back, F.lit(False)) | forced)
    rows = rows.withColumn("_out", F.min(F.when(exits, F.col("ts"))).over(day)).filter(F.col("ts") == F.col("_out"))
    shares = F.lit(notional) / F.col("_in.price")
    move = F.col("follower_price") - F.col("_in.price")
    gross = shares * F.when(F.col("_in.side") == "long", move).otherwise(-move)
    fee = 2 * shares * cost
    # fixed values: the labels of the exit reasons
    reason = F.when(forced, "forced_eod_exit").when(F.col("_in.side") == "long", "leader_below_base_sma").otherwise("leader_above_base_sma")
    return rows.select(
        "trading_day", *PAIR,
        F.col("_in.side").alias("side"), F.col("_in.ts").alias("entry_time"), F.col("ts").alias("exit_time"),
        F.col("_in.price").alias("entry_price"), F.col("follower_price").alias("exit_price"),
        shares.alias("shares"), gross.alias("gross_pnl"), fee.alias("transaction_cost"), (gross - fee).alias("net_pnl"), reason.alias("exit_reason"),
    )


def backtest(bars: DataFrame, universe: DataFrame, leader_edge: float = LEADER_EDGE, follower_edge: float = FOLLOWER_EDGE, n: int = SMA, **params) -> DataFrame:
    """All pairs on all days of the universe in one lineage."""
    return match_trades(pair_signals(pair_bars(bars, universe), leader_edge, follower_edge, n), **params)


# --- equity and performance (day-level tables) --------------------------------------------


def _with_returns(df: DataFrame, equity: str, ret: str, day: str, keys: Sequence[str] = ()) -> DataFrame:
    prev = F.lag(equity).over(W.partitionBy(*keys).orderBy(day))
    return df.withColumn(ret, F.coalesce(ratio(equity, prev) - 1, F.lit(0.0)))


def daily_equity(trades: DataFrame, capital: float = NOTIONAL) -> DataFrame:
    """Daily PnL, equity (already includes the first day's PnL) and return (first = 0)."""
    pnl = trades.groupBy("trading_day").agg(F.sum("net_pnl").alias("daily_pnl"))
    cum = running(pnl, [], ["trading_day"], {"_cum": ("sum", "daily_pnl")}, bounded=True)
    equity = cum.withColumn("strategy_equity", F.lit(float(capital)) + F.col("_cum")).drop("_cum")
    return _with_returns(equity, "strategy_equity", "strategy_return", "trading_day")


def buy_and_hold(bars: DataFrame, start: str, end: str, capital: float = NOTIONAL, keys: Sequence[str] = ()) -> DataFrame:
    """Benchmark from minute bars: last session close per day, shares bought at the first one; a series per value of `keys`."""
    from tickweave.operators.select import session_filter

    inside = session_filter(bars.filter(F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), "09:30", "16:00")
    close = inside.groupBy(*keys, F.to_date("ts").alias("trading_day")).agg(F.max_by("close", "ts").alias("benchmark_close"))
    first = F.first("benchmark_close").over(W.partitionBy(*keys).orderBy("trading_day"))
    equity = close.withColumn("benchmark_equity", F.lit(float(capital)) / first * F.col("benchmark_close"))
    return _with_returns(equity, "benchmark_equity", "benchmark_return", "trading_day", keys)


def performance(df: DataFrame, equity: str = "strategy_equity", ret: str = "strategy_return", day: str = "trading_day", periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    """One row, or one per value of `keys`: total return, CAGR, volatility, Sharpe, Sortino, drawdown, Calmar. Zero divisors give NULL."""
    falls = running(df, keys, [day], {"_peak": ("max", equity)}, bounded=True)
    r, year = F.col(ret), F.lit(float(periods))
    base = falls.groupBy(*keys).agg(
        F.min_by(equity, day).alias("_first"), F.max_by(equity, day).alias("_last"), F.count(equity).alias("n_periods"),
        F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.stddev_samp(F.when(r < 0, r)).alias("_neg"),
        F.min(ratio(equity, "_peak") - 1).alias("max_drawdown"),
    )
    grown = ratio("_last", "_first")
    base = base.withColumns(
        {
            "total_return": grown - 1,
            "cagr": F.pow(grown, year / F.col("n_periods")) - 1,
            "ann_vol": F.col("_std") * F.sqrt(year),
            "sharpe": ratio("_mean", "_std") * F.sqrt(year),
            "sortino": ratio("_mean", "_neg") * F.sqrt(year),
        }
    ).withColumn("calmar", ratio("cagr", F.abs("max_drawdown")))
    return base.drop("_first", "_last", "_mean", "_std", "_neg")


def trade_summary(trades: DataFrame) -> DataFrame:
    """One row of counts, PnL by side and win rates."""
    per_day = trades.groupBy("trading_day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("net_pnl").alias("pnl"),
        F.sum(F.when(F.col("net_pnl") > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("side") == "long", F.col("net_pnl")).otherwise(0.0)).alias("long_pnl"),
        F.sum(F.when(F.col("side") == "short", F.col("net_pnl")).otherwise(0.0)).alias("short_pnl"),
        F.count(F.when(F.col("side") == "long", 1)).alias("n_long"),
        F.count(F.when((F.col("side") == "long") & (F.col("net_pnl") > 0), 1)).alias("long_wins"),
    )
    return per_day.agg(
        F.sum("n").alias("total_trades"), F.avg("n").alias("avg_per_day"), F.max("n").alias("max_per_day"),
        F.sum("pnl").alias("total_net_pnl"), ratio(F.sum("pnl"), F.sum("n")).alias("avg_net_pnl"), ratio(F.sum("wins"), F.sum("n")).alias("win_rate"),
        F.sum("long_pnl").alias("long_net_pnl"), F.sum("short_pnl").alias("short_net_pnl"), ratio(F.sum("long_wins"), F.sum("n_long")).alias("long_win_rate"),
    )


# --- signal frequency and event study --------------------------------------------------------


def signal_starts(prices: DataFrame, horizons: Sequence[int] = (), leader_edge=LEADER_EDGE, follower_edge=FOLLOWER_EDGE, n: int = SMA, bounded: bool = False) -> DataFrame:
    """Signals over the whole pair series, their starts within a day, forward follower returns."""

    def build(d, w):
        d = _signal_columns(d, w, leader_edge, follower_edge, n)
        same_day = F.lag("trading_day").over(w) == F.col("trading_day")
        for s in ("long", "short"):
            before = F.coalesce(F.lag(f"{s}_signal").over(w) & same_day, F.lit(False))
            d = d.withColumn(f"{s}_start", F.col(f"{s}_signal") & ~before)
        return d.withColumns({f"fwd_{h}": ratio(F.lead("follower_price", h).over(w), "follower_price") - 1 for h in horizons})

    return over_series(prices, PAIR, ["ts"], build, before=n, after=max([*horizons, 0]), bounded=bounded)


def signal_frequency(starts: DataFrame) -> DataFrame:
    n_days = F.countDistinct("trading_day")
    out = {}
    for s in ("long", "short"):
        out[f"{s}_minutes"] = F.sum(F.col(f"{s}_signal").cast("bigint"))
        out[f"{s}_starts"] = F.sum(F.col(f"{s}_start").cast("bigint"))
    rows = starts.groupBy(*PAIR).agg(n_days.alias("n_days"), *[e.alias(k) for k, e in out.items()])
    return rows.withColumns({f"{s}_starts_per_day": ratio(f"{s}_starts", "n_days") for s in ("long", "short")})


def event_study(starts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return starts.filter("long_start").select(*PAIR, "ts", "trading_day", "follower_price", *[f"fwd_{h}" for h in horizons])


def matched_baseline(starts: DataFrame, horizons: Sequence[int], seed: int = 42) -> DataFrame:
    """As many random non-start rows per pair as the pair has starts (all horizons known).

    Rows are ordered by a hash of pair and time and the first n are taken; the
    hash also chunks the numbering, so no pair sits in one task.
    """
    cols = [f"fwd_{h}" for h in horizons]
    known = ~F.col("long_start")
    for c in cols:
        known = known & F.col(c).isNotNull()
    draw = hash_draw(F.col("leader"), F.col("follower"), F.unix_seconds(F.col("ts").cast("timestamp")), seed=seed)
    eligible = starts.filter(known).withColumn("_draw", draw)
    ranked = index_rows(eligible, PAIR, ["_draw", "ts"])
    wanted = starts.groupBy(*PAIR).agg(F.sum(F.col("long_start").cast("bigint")).alias("_n"))
    return salted_join(ranked, wanted, list(PAIR), ["ts"]).filter(F.col("_pos") < F.col("_n")).select(*PAIR, "ts", "trading_day", "follower_price", *cols)


def excess_returns(events: DataFrame, baseline: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean forward return at starts and at random rows, and the difference, per horizon."""
    cols = [f"fwd_{h}" for h in horizons]
    both = events.select(*cols, F.lit(1).alias("_e")).unionByName(baseline.select(*cols, F.lit(0).alias("_e")))
    cells = [
        F.struct(F.lit(h).alias("horizon"), F.avg(F.when(F.col("_e") == 1, F.col(f"fwd_{h}"))).alias("signal"), F.avg(F.when(F.col("_e") == 0, F.col(f"fwd_{h}"))).alias("random"))
        for h in horizons
    ]
    return both.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).withColumn("excess_return", F.col("signal") - F.col("random"))


# --- threshold and regime rules --------------------------------------------------------------


def threshold_signal(df: DataFrame, tau: float = 0.05, column: str = "mispricing", out: str = "signal") -> DataFrame:
    m = F.col(column)
    return df.withColumn(out, F.when(m > tau, "BUY").when(m < -tau, "SELL").otherwise("NO TRADE"))


def threshold_sweep(df: DataFrame, taus: Sequence[float], column: str = "mispricing", outcome: str = "outcome") -> DataFrame:
    """Counts and accuracies per threshold in one pass, without repeating rows."""
    m, y = F.col(column), F.col(outcome)

    def cell(t):
        buy, sell = m > t, m < -t
        right = (buy & (y == 1)) | (sell & (y == 0))
        n = F.count(F.when(buy | sell, 1))
        return F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count(F.when(buy, 1)).alias("buy_signals"),
            F.count(F.when(sell, 1)).alias("sell_signals"),
            n.alias("total_trades"),
            ratio(F.count(F.when(right, 1)), n).alias("accuracy"),
            ratio(F.count(F.when(buy & (y == 1), 1)), F.count(F.when(buy, 1))).alias("buy_accuracy"),
            ratio(F.count(F.when(sell & (y == 0), 1)), F.count(F.when(sell, 1))).alias("sell_accuracy"),
        )

    return df.agg(F.array(*[cell(t) for t in taus]).alias("_c")).select(F.inline("_c"))


# fixed values: names of the two market regimes
PROCESSING, ANCHORED = "Information Processing", "Anchored / Noisy"


def regime_signal(df: DataFrame, regime: str = "market_regime", column: str = "mispricing") -> DataFrame:
    """Original, contrarian and regime-aware predictions (contrarian while information is processed)."""
    up = (F.col(column) > 0).cast("int")
    aware = F.when(F.col(regime) == PROCESSING, 1 - up).otherwise(up)
    return df.withColumns({"pred_original": up, "pred_contrarian": 1 - up, "pred_regime_aware": aware})


def regime_accuracy(df: DataFrame, taus: Sequence[float], regime: str = "market_regime", column: str = "mispricing", outcome: str = "outcome") -> DataFrame:
    """Normal and inverted accuracy by regime and minimum size of the mispricing."""
    size, up = F.abs(F.col(column)), (F.col(column) > 0).cast("int")
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count(F.when(size >= t, 1)).alias("trades"),
            F.avg(F.when(size >= t, (up == F.col(outcome)).cast("double"))).alias("normal_accuracy"),
            F.avg(F.when(size >= t, (1 - up == F.col(outcome)).cast("double"))).alias("inverted_accuracy"),
        )
        for t in taus
    ]
    rows = df.groupBy(regime).agg(F.array(*cells).alias("_c")).select(regime, F.inline("_c"))
    return rows.filter(F.col("trades") > 0)


def binary_pnl(df: DataFrame, preds: Sequence[str], p: str = "final_probability", outcome: str = "outcome") -> DataFrame:
    """Contract PnL per prediction column: long outcome - p, short p - outcome."""
    gain = F.col(outcome) - F.col(p)
    return df.withColumns({f"pnl_{c}": F.when(F.col(c) == 1, gain).otherwise(-gain) for c in preds})


def pnl_summary(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("strategy"), F.sum(f"pnl_{c}").alias("total_pnl"), F.avg(f"pnl_{c}").alias("avg_trade"),
            F.avg((F.col(f"pnl_{c}") > 0).cast("double")).alias("win_rate"), F.count(f"pnl_{c}").alias("n_trades"),
        )
        for c in preds
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


# --- indicator rules ------------------------------------------------------------------------


def ichimoku_signal(df: DataFrame, confirm: Sequence[str] = ()) -> DataFrame:
    """1 / -1 / 0 by the cloud rule, optionally confirmed by "macd" and "sar" columns."""
    close = F.col("close")
    up = (close > F.col("span_a")) & (close > F.col("span_b")) & (F.col("tenkan") > F.col("kijun")) & (F.col("chikou") > close)
    down = (close < F.col("span_a")) & (close < F.col("span_b")) & (F.col("tenkan") < F.col("kijun")) & (F.col("chikou") < close)
    if "macd" in confirm:
        up, down = up & (F.col("macd") > F.col("macd_signal")), down & (F.col("macd") < F.col("macd_signal"))
    if "sar" in confirm:
        up, down = up & (close > F.col("sar")), down & (close < F.col("sar"))
    return df.withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0))


def extremes_tree(numbered: DataFrame, block: int) -> list[DataFrame]:
    """Levels of a tree over each symbol's bars: (symbol, _node, _kids), ``block`` kids a node at most.

    Kids of the first level are bars, of the next ones the lowest low and highest high of a node below. Positions are dense, so kid i of
    node n is number n * block + i of the level below. The first level is kept, as all others are made from it.
    """

    def grouped(rows, number, *fields):
        kid = F.struct(F.col(number).alias("number"), *fields)
        return rows.groupBy("symbol", F.floor(F.col(number) / block).cast("bigint").alias("_node")).agg(F.sort_array(F.collect_list(kid)).alias("_kids"))

    levels = [cut(grouped(numbered, "_pos", "low", "high", "ts"))]
    last = levels[0].agg(F.max("_node")).first()[0] or 0
    while last > 0:
        ends = levels[-1].select("symbol", "_node", F.array_min(F.transform("_kids", lambda x: x["low"])).alias("low"), F.array_max(F.transform("_kids", lambda x: x["high"])).alias("high"))
        levels.append(grouped(ends, "_node", "low", "high"))
        last //= block
    return levels


def bracket_exit(entries: DataFrame, bars: DataFrame, stops: Sequence[float], targets: Sequence[float], block: int = 128, bounded: bool = False) -> DataFrame:
    """First later bar that touches the stop (entry - k·ATR) or the target (entry + m·ATR), per grid point.

    ``entries``: symbol, ts, close, atr. An order climbs a tree of extremes from its own bar: at each level it looks at the kids
    to the right of where it comes from, and the first one that holds a touch ends the climb. From there it descends, always into the
    first kid with a touch, to a bar. That is ``block`` kids a level whatever the number of bars, also for orders that nothing ever
    touches. Stop wins when one bar touches both.
    """
    numbered = index_rows(bars.select("symbol", "ts", "low", "high", "close"), ["symbol"], ["ts"], bounded=bounded)
    levels = extremes_tree(numbered, block)
    places = levels[0].select("symbol", F.explode("_kids").alias("_kid")).select("symbol", F.col("_kid.ts").alias("entry_ts"), F.col("_kid.number").alias("_from"))
    grid = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(m)).alias("m")) for k in stops for m in targets])
    key = ["symbol", "entry_ts", "k", "m"]
    orders = (
        entries.select("symbol", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price"), "atr", F.explode(grid).alias("_g"))
        .select("symbol", "entry_ts", "entry_price", "_g.k", "_g.m", (F.col("entry_price") - F.col("_g.k") * F.col("atr")).alias("stop"), (F.col("entry_price") + F.col("_g.m") * F.col("atr")).alias("target"))
        .join(places, ["symbol", "entry_ts"])
        .withColumns({"_level": F.lit(None).cast("int"), "_place": F.lit(None).cast("bigint"), "_exit": F.lit(None).cast(f"struct<ts:{bars.schema['ts'].dataType.simpleString()},reason:string>")})
    )
    # orders that have no business at a level ask for nodes that do not exist, each for another one
    nowhere = -1 - F.pmod(F.xxhash64(*key), F.lit(1 << 40))

    def look(state: DataFrame, level: int, asks: Column, node: Column, after: Column) -> DataFrame:
        """``_first``: number of the first kid behind place ``after`` of the node that holds a touch; at bars, the exit."""
        asked = state.withColumn("_node", F.when(asks, node).otherwise(nowhere))
        nodes = levels[level - 1]
        # few nodes, many orders: those of the upper levels are repeated, bars are not
        met = asked.join(nodes, ["symbol", "_node"], "left") if level == 1 else salted_join(asked, nodes, ["symbol", "_node"], key, "left")
        touched = lambda x: (x["low"] <= F.col("stop")) | (x["high"] >= F.col("target"))
        at = F.array_min(F.transform("_kids", lambda x, i: F.when((i > after) & touched(x), i)))
        met = met.withColumn("_at", at)
        kid = F.get("_kids", F.col("_at"))
        if level == 1:
            reason = F.when(kid["low"] <= F.col("stop"), "stop").otherwise("target")
            met = met.withColumn("_exit", F.when(F.col("_at").isNotNull(), F.struct(kid["ts"].alias("ts"), reason.alias("reason"))).otherwise(F.col("_exit")))
        return met.withColumn("_first", kid["number"]).drop("_kids", "_at", "_node")

    state = orders
    for level in range(1, len(levels) + 1):
        open_yet = F.col("_level").isNull()
        state = look(state, level, open_yet, F.floor(F.col("_from") / block).cast("bigint"), (F.col("_from") % block).cast("int"))
        found = F.col("_first").isNotNull()
        state = state.withColumns({"_place": F.when(found, F.col("_first")).otherwise(F.col("_place")), "_level": F.when(found, F.lit(level)).otherwise(F.col("_level")), "_from": F.floor(F.col("_from") / block).cast("bigint")}).drop("_first")
    for level in range(len(levels) - 1, 0, -1):
        state = look(state, level, F.col("_level") > level, F.col("_place"), F.lit(-1))
        state = state.withColumn("_place", F.coalesce("_first", "_place")).drop("_first")
    price = F.when(F.col("_exit.reason") == "stop", F.col("stop")).when(F.col("_exit.reason") == "target", F.col("target"))
    return state.select(*key, "entry_price", F.col("_exit.ts").alias("exit_ts"), F.col("_exit.reason").alias("exit_reason"), (price - F.col("entry_price")).alias("pnl"))


def grid_score(exits: DataFrame) -> DataFrame:
    """Each grid point scored per symbol."""
    return exits.groupBy("symbol", "k", "m").agg(
        F.count("pnl").alias("n_closed"), F.count(F.lit(1)).alias("n_entries"), F.sum("pnl").alias("total_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate")
    )


# fixed values: decision labels
BUY_LABEL, SHORT_LABEL, STAY_LABEL = "Comprar", "Vender en Corto", "No operar"


def ensemble_decision(df: DataFrame, max_dispersion: float = 200.0, max_vol: float = 0.1, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), bounded: bool = False) -> DataFrame:
    """Prediction, median trend, dispersion and volatility → decision and next-bar gain; the last bar drops out."""

    def build(d, w):
        return d.withColumn("next_price", F.lead("price").over(w))

    ahead = over_series(df, keys, order, build, after=1, bounded=bounded).filter(F.col("next_price").isNotNull())
    calm = ~(F.col("dispersion") > max_dispersion) & ~(F.col("volatility") > max_vol)
    price = F.col("price")
    up = (F.col("prediction") > price) & (F.col("median") > price) & calm
    down = (F.col("prediction") < price) & (F.col("median") < price) & calm
    move = F.col("next_price") - price
    return ahead.withColumns(
        {"decision": F.when(up, BUY_LABEL).when(down, SHORT_LABEL).otherwise(STAY_LABEL), "gain": F.when(up, move).when(down, -move).otherwise(0.0)}
    )


def ensemble_summary(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.sum("gain").alias("total_gain"), F.count(F.when(F.col("gain") > 0, 1)).alias("n_won"), F.count(F.when(F.col("gain") <= 0, 1)).alias("n_lost"),
        F.avg((F.col("gain") > 0).cast("double")).alias("win_rate"),
    )


def correct_share(df: DataFrame, pred: str, outcome: str = "outcome") -> Column:
    return F.avg((F.col(pred) == F.col(outcome)).cast("double"))
