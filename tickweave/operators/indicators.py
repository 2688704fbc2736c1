"""Technical indicators per symbol, built on one blocked window pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions.scalars import ratio
from tickweave.operators.series import ewm, rolled
from tickweave.plans.series import BLOCK, affine_scan, index_rows, into_blocks, join_same, measure, over_series
from tickweave.session import cut

KEYS, ORDER = ("symbol",), ("ts",)
_ALL = ("sma", "atr", "rsi", "bollinger", "stochastic", "momentum", "cci", "volume")


def indicators(bars: DataFrame, which: Sequence[str] = _ALL, keys=KEYS, order=ORDER) -> DataFrame:
    """Windowed indicators in one shuffle.

    Formulas keep the source's own forms: "true range" is high - low, RSI uses
    plain means, CCI divides by the standard deviation.
    """

    def build(d, w):
        close = F.col("close")
        if "sma" in which:
            d = d.withColumn("sma10", rolled("mean", "close", 10, w))
        if "atr" in which:
            d = d.withColumn("tr", F.col("high") - F.col("low"))
            d = d.withColumn("atr14", rolled("mean", "tr", 14, w))
        if "rsi" in which:
            d = d.withColumn("_d", close - F.lag("close").over(w))
            # the first difference is missing and counts as no gain and no loss
            up, down = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
            d = d.withColumns({"_up": up, "_down": down})
            d = d.withColumns({"_gain": rolled("mean", "_up", 14, w), "_loss": rolled("mean", "_down", 14, w)})
            d = d.withColumn(
                "rsi14",
                F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), F.lit(100.0)).otherwise(
                    100 - F.try_divide(F.lit(100.0), 1 + ratio("_gain", "_loss"))
                ),
            ).drop("_d", "_up", "_down", "_gain", "_loss")
        if "bollinger" in which:
            d = d.withColumns({"bb_mid": rolled("mean", "close", 20, w), "_s": rolled("std", "close", 20, w)})
            d = d.withColumns({"bb_up": F.col("bb_mid") + 2 * F.col("_s"), "bb_low": F.col("bb_mid") - 2 * F.col("_s")}).drop("_s")
        if "stochastic" in which:
            d = d.withColumns({"_lo": rolled("min", "low", 14, w), "_hi": rolled("max", "high", 14, w)})
            d = d.withColumn("stoch_k", 100 * ratio(close - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
        if "momentum" in which:
            d = d.withColumn("momentum5", ratio("close", F.lag("close", 5).over(w)) - 1)
        if "cci" in which:
            d = d.withColumn("typical", (F.col("high") + F.col("low") + close) / 3)
            d = d.withColumns({"_m": rolled("mean", "typical", 20, w), "_s": rolled("std", "typical", 20, w)})
            d = d.withColumn("cci20", ratio(F.col("typical") - F.col("_m"), 0.015 * F.col("_s"))).drop("_m", "_s")
        if "volume" in which:
            d = d.withColumn("volume_sma14", rolled("mean", "volume", 14, w))
        return d

    return over_series(bars, keys, order, build, before=22)


def fill_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Warm-up rows to 0, as the source table does."""
    return df.fillna(0, subset=list(cols))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys=KEYS, order=ORDER, bounded: bool = False, block: int = BLOCK) -> DataFrame:
    """EMA(fast) - EMA(slow) and its EMA(signal)."""
    cells = None if bounded else measure(bars, keys, order, block)
    lines = ewm(bars, {"ema_fast": ("close", fast), "ema_slow": ("close", slow)}, keys, order, bounded, block, cells)
    return ewm(lines.withColumn("macd", F.col("ema_fast") - F.col("ema_slow")), {"macd_signal": ("macd", signal)}, keys, order, bounded, block, cells)


def sma_vs_ema(bars: DataFrame, n: int = 10, keys=KEYS, order=ORDER, bounded: bool = False, block: int = BLOCK) -> DataFrame:
    """SMA(n), EMA(n) and their difference."""

    def build(d, w):
        return d.withColumn("sma", rolled("mean", "close", n, w))

    cells = None if bounded else measure(bars, keys, order, block)
    means = over_series(bars, keys, order, build, before=n - 1, bounded=bounded, block=block, cells=cells)
    return ewm(means, {"ema": ("close", n)}, keys, order, bounded, block, cells).withColumn("sma_vs_ema", F.col("sma") - F.col("ema"))


def ichimoku(bars: DataFrame, short: int = 9, mid: int = 26, long: int = 52, shift: int = 26, lookahead: bool = True, keys=KEYS, order=ORDER) -> DataFrame:
    """Five cloud lines. The lagging line reads the future; ``lookahead=False`` leaves it out."""

    def middle(n, w):
        return (rolled("max", "high", n, w) + rolled("min", "low", n, w)) / 2

    def build(d, w):
        d = d.withColumns({"tenkan": middle(short, w), "kijun": middle(mid, w), "_b": middle(long, w)})
        d = d.withColumn("_a", (F.col("tenkan") + F.col("kijun")) / 2)
        d = d.withColumns({"span_a": F.lag("_a", shift).over(w), "span_b": F.lag("_b", shift).over(w)})
        if lookahead:
            d = d.withColumn("chikou", F.lead("close", shift).over(w))
        return d.drop("_a", "_b")

    return over_series(bars, keys, order, build, before=long + shift, after=shift if lookahead else 0)


def wilder_atr(bars: DataFrame, n: int = 14, keys=KEYS, order=ORDER, bounded: bool = False, block: int = BLOCK) -> DataFrame:
    """Average true range with Wilder's smoothing, seeded by the mean of the first n ranges.

    A range with a missing price is left out of the seed and does not change the average.
    """

    def build(d, w):
        prev = F.lag("close").over(w)
        # greatest() skips missing distances, as on the first row
        return d.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))).withColumns(
            {"_seed": F.avg("_tr").over(w.rowsBetween(-(n - 1), 0)), "_at": F.col("_pos")}
        )

    cells = None if bounded else measure(bars, keys, order, block)
    rows = over_series(bars, keys, order, build, before=n, bounded=bounded, block=block, cells=cells)
    begun, first = F.col("_at") >= n - 1, F.col("_at") == n - 1
    a = F.when(first | ~begun, 0.0).when(F.col("_tr").isNull(), 1.0).otherwise(1 - 1 / n)
    b = F.when(first, F.coalesce("_seed", F.lit(0.0))).when(begun & F.col("_tr").isNotNull(), F.col("_tr") / n).otherwise(0.0)
    out = affine_scan(rows, keys, order, {"atr": (a, b)}, bounded, block, cells)
    return out.withColumn("atr", F.when(begun, F.col("atr"))).select(*bars.columns, "atr")


def _sar_rows(pdf: pd.DataFrame, step: float, cap: float) -> pd.DataFrame:
    """Stop-and-reverse over ordered rows, resuming from the last row with a known state."""
    high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
    known = np.flatnonzero(pdf["_known_sar"].notna().to_numpy())
    n, first = len(pdf), int(known[-1]) if len(known) else 0
    sar, ep, af, up = (np.full(n, np.nan) for _ in range(4))
    if len(known):
        row = pdf.iloc[first]
        sar[first], ep[first], af[first], up[first] = row["_known_sar"], row["_known_ep"], row["_known_af"], row["_known_up"]
    else:
        sar[0], ep[0], af[0], up[0] = low[0], high[0], step, 1.0
    for i in range(first + 1, n):
        rising = up[i - 1] > 0
        s = sar[i - 1] + af[i - 1] * (ep[i - 1] - sar[i - 1])
        back = max(i - 2, 0)
        s = min(s, low[i - 1], low[back]) if rising else max(s, high[i - 1], high[back])
        if (low[i] < s) if rising else (high[i] > s):
            sar[i], ep[i], af[i], up[i] = ep[i - 1], (low[i] if rising else high[i]), step, -up[i - 1]
            continue
        extreme = max(ep[i - 1], high[i]) if rising else min(ep[i - 1], low[i])
        af[i] = min(af[i - 1] + step, cap) if extreme != ep[i - 1] else af[i - 1]
        sar[i], ep[i], up[i] = s, extreme, up[i - 1]
    return pdf.assign(sar=sar, ep=ep, af=af, up=up)


def parabolic_sar(bars: DataFrame, step: float = 0.02, cap: float = 0.2, keys=KEYS, order=ORDER, block: int = 32_768, memory: int = 2000) -> DataFrame:
    """Parabolic stop-and-reverse, exact for series of any length.

    Blocks run side by side, each warmed up on the rows before it. A block that began from another state
    than the block before it ended with runs again from the right state, and only such blocks, until all borders agree.
    """
    state = ("sar", "ep", "af", "up")
    known = [f"_known_{s}" for s in state]
    indexed = cut(index_rows(bars, keys, order))
    spread = into_blocks(indexed, "_pos", memory, 0, max(block, memory))
    size = max(block, memory)
    schema = T.StructType(
        [*indexed.schema.fields, T.StructField("_block", T.LongType()), T.StructField("_own", T.BooleanType())]
        + [T.StructField(s, T.DoubleType()) for s in state]
    )
    names = schema.fieldNames()

    def run(rows):
        def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
            return _sar_rows(pdf.sort_values("_pos", ignore_index=True), step, cap)[names]

        return cut(rows.groupBy(*keys, "_block").applyInPandas(per_block, schema))

    out = run(spread.withColumns({k: F.lit(None).cast("double") for k in known}))
    while True:
        border = out.filter(F.col("_pos") % size == size - 1)
        ends = border.filter("_own").select(*keys, "_pos", *[F.col(s).alias(k) for s, k in zip(state, known)])
        begins = border.filter("NOT _own").select(*keys, "_pos", "_block", *state)
        agree = [F.col(s).eqNullSafe(F.col(k)) for s, k in zip(state, known)]
        wrong = join_same(begins, ends, [*keys, "_pos"], "inner").filter(~(agree[0] & agree[1] & agree[2] & agree[3]))
        wrong = cut(wrong.select(*keys, "_pos", "_block", *known))
        if wrong.isEmpty():
            break
        # one border a block, so one row a block that began wrong
        again = join_same(spread, wrong.select(*keys, "_block"), [*keys, "_block"], "left_semi")
        redone = run(join_same(again, wrong, [*keys, "_pos", "_block"]))
        out = cut(join_same(out, wrong.select(*keys, "_block"), [*keys, "_block"], "left_anti").unionByName(redone))
    return out.filter("_own").select(*bars.columns, *state)
