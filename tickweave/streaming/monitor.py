"""Sinks: append-only logs and the periodic monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickweave.operators.select import tradable
from tickweave.session import cut, remove_folder
from tickweave.streaming.book import latest, pressure_signal

# fixed values: columns of the two logs
SNAPSHOT_LOG = ("timestamp_ms", "asset_id", "best_bid", "best_ask", "mid_price", "microprice", "edge", "spread", "imbalance", "depth")
SIGNAL_LOG = ("timestamp_ms", "asset_id", "signal", "run_count", "age_seconds", "mid_price", "microprice", "edge", "imbalance", "spread", "depth")


def log_sink(df: DataFrame, path: str, checkpoint: str, columns=SNAPSHOT_LOG, fmt: str = "csv", interval: str | None = None) -> StreamingQuery:
    """Append the chosen columns to files; without an interval all waiting input is processed and the query ends."""
    writer = df.select(*columns).writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def _tick(newest: DataFrame, previous: DataFrame | None, limits: dict) -> DataFrame:
    """State after one tick: newest features of every asset seen so far and the tracker of its signal.

    A row of ``newest`` without an asset is a beat and only moves the clock. Only tradable assets are tracked at a tick. A tracker begins NEUTRAL with
    count 0 and no start, so a first NEUTRAL counts 1 without a start time.
    """
    known = newest.columns
    clock = newest.select(F.col("timestamp_ms").alias("t"))
    seen = newest.filter(F.col("asset_id").isNotNull())
    if previous is not None:
        clock = clock.unionByName(previous.select(F.col("tick_ms").alias("t")))
        seen = seen.unionByName(previous.select(*known))
    merged = latest(seen)
    tick = clock.agg(F.max("t").alias("t")).scalar()
    live = pressure_signal(tradable(merged, **limits)).select("asset_id", F.col("signal").alias("_now"))
    state = merged.join(live, "asset_id", "left")
    if previous is None:
        blank = {"signal": F.lit("NEUTRAL"), "run_count": F.lit(0).cast("bigint"), "first_seen_ms": F.lit(None).cast("bigint")}
        state = state.withColumns(blank)
    else:
        state = state.join(previous.select("asset_id", "signal", "run_count", "first_seen_ms"), "asset_id", "left")
        state = state.withColumns({"signal": F.coalesce("signal", F.lit("NEUTRAL")), "run_count": F.coalesce("run_count", F.lit(0).cast("bigint"))})
    tracked, same = F.col("_now").isNotNull(), F.col("_now") == F.col("signal")
    state = state.withColumn("tick_ms", tick)
    return state.select(
        *known, "tick_ms", tracked.alias("tradable"),
        F.when(tracked, F.col("_now")).otherwise(F.col("signal")).alias("signal"),
        F.when(tracked & same, F.col("run_count") + 1).when(tracked, F.lit(1).cast("bigint")).otherwise(F.col("run_count")).alias("run_count"),
        F.when(tracked & ~same, F.col("tick_ms")).otherwise(F.col("first_seen_ms")).alias("first_seen_ms"),
    )


def _with_beats(features: DataFrame, beats: DataFrame) -> DataFrame:
    """Features and rows without an asset that carry the time of a beat."""
    ms = F.unix_millis(F.col("timestamp").cast("timestamp"))
    # the newest beat of a tick has the highest order
    rows = beats.select(ms.alias("timestamp_ms"), ms.alias("seq"), F.lit(0).alias("msg_no"), F.lit(0).alias("item"))
    return features.unionByName(rows, allowMissingColumns=True)


def start_monitor(
    features: DataFrame, folder: str, checkpoint: str, interval: str | None = "5 seconds", limit: int | None = None, min_count: int = 2, beats: DataFrame | None = None, **limits
) -> StreamingQuery:
    """Every interval: all tradable assets → ``folder``/snapshots, persistent signals (all, or the first ``limit``) → ``folder``/signals.

    ``beats``, a stream with a ``timestamp``, ticks when no message comes: counts and ages go on. With an interval and no
    stream of beats, a beat a second is made. The newest features and the trackers of all assets are a table per tick
    under ``folder``/state (one row per asset), read by the next tick; the tables of the last two ticks are kept. All
    output of a tick sits under its number, so a tick repeated after a failure
    replaces itself.
    """
    if beats is None and interval:
        beats = features.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        previous = spark.read.parquet(f"{folder}/state/tick={epoch - 1}") if epoch else None
        # read for its rows and for its clock
        newest = cut(latest(batch))
        _tick(newest, previous, limits).write.mode("overwrite").parquet(f"{folder}/state/tick={epoch}")
        state = spark.read.parquet(f"{folder}/state/tick={epoch}")
        state.filter("tradable").select(*SNAPSHOT_LOG).write.mode("overwrite").parquet(f"{folder}/snapshots/tick={epoch}")
        age = F.coalesce((F.col("tick_ms") - F.col("first_seen_ms")) / 1000.0, F.lit(0.0))
        lasting = state.filter((F.col("signal") != "NEUTRAL") & (F.col("run_count") >= min_count))
        top = lasting.withColumn("age_seconds", age).orderBy("asset_id")
        top = top if limit is None else top.limit(limit)
        top.select(*SIGNAL_LOG).write.mode("overwrite").parquet(f"{folder}/signals/tick={epoch}")
        if epoch > 1:
            remove_folder(spark, f"{folder}/state/tick={epoch - 2}")

    rows = features if beats is None else _with_beats(features, beats)
    writer = rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
