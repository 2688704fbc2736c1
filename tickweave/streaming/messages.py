"""Order-book messages: JSON text to typed updates, for streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE = "decimal(18,6)"
_LEVEL = "struct<price:string,size:string>"
_CHANGE = "struct<asset_id:string,side:string,price:string,size:string>"
_MESSAGE = (
    f"struct<event_type:string,asset_id:string,market:string,hash:string,timestamp:string,bids:array<{_LEVEL}>,"
    f"asks:array<{_LEVEL}>,price_changes:array<{_CHANGE}>>"
)


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Text files with one JSON message per line as a stream; the rate limit takes the place of a bounded queue."""
    return spark.readStream.schema("seq bigint, value string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """One row per message: text holds an object or a list of objects; invalid JSON is dropped."""
    text = F.trim(F.col(value))
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.from_json(as_list, f"array<{_MESSAGE}>")
    rest = [c for c in raw.columns if c != value]
    rows = raw.select(*rest, F.posexplode(parsed).alias("msg_no", "m"))
    return rows.filter(F.col("m").isNotNull()).select(*rest, "msg_no", "m.*")


def route(messages: DataFrame, seq: str = "seq") -> DataFrame:
    """Book updates in arrival order (asset_id, seq, item, kind, side, price, size, timestamp_ms).

    A "book" message becomes a "reset" row and its levels; a "price_change"
    becomes "level" rows. Other types and rows without an asset are left out. A
    side other than BUY or SELL stops the job.
    """
    num = lambda c: c.cast(PRICE)
    stamp = F.col("timestamp").cast("bigint")

    def snapshot(levels, side):
        return F.transform(
            F.coalesce(levels, F.array().cast(f"array<{_LEVEL}>")),
            lambda x: F.struct(F.lit("snapshot").alias("kind"), F.lit(side).alias("side"), num(x["price"]).alias("price"), num(x["size"]).alias("size")),
        )

    reset = F.array(F.struct(F.lit("reset").alias("kind"), F.lit(None).cast("string").alias("side"), F.lit(None).cast(PRICE).alias("price"), F.lit(None).cast(PRICE).alias("size")))
    book = messages.filter((F.col("event_type") == "book") & F.col("asset_id").isNotNull()).select(
        "asset_id", seq, "msg_no", stamp.alias("timestamp_ms"), F.posexplode(F.concat(reset, snapshot(F.col("bids"), "BUY"), snapshot(F.col("asks"), "SELL"))).alias("item", "u")
    ).select("asset_id", seq, "msg_no", "item", "timestamp_ms", "u.*")
    side = F.upper("c.side")
    checked = F.when(side.isin("BUY", "SELL"), side).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(side, F.lit("none")))))
    change = (
        messages.filter(F.col("event_type") == "price_change")
        .select(seq, "msg_no", stamp.alias("timestamp_ms"), F.posexplode("price_changes").alias("item", "c"))
        .filter(F.col("c.asset_id").isNotNull())
        .select(
            F.col("c.asset_id").alias("asset_id"), seq, "msg_no", "item", "timestamp_ms", F.lit("level").alias("kind"), checked.alias("side"), num(F.col("c.price")).alias("price"), num(F.col("c.size")).alias("size")
        )
    )
    return book.unionByName(change)


def with_event_time(updates: DataFrame, delay: str = "1 minute", keys: tuple[str, ...] = ("asset_id", "seq", "msg_no", "item")) -> DataFrame:
    """Event time from the message stamp, a watermark and repeated deliveries dropped inside it."""
    timed = updates.withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))
