"""Streams: incremental candles, signals by micro-batch, windows and joins.

Batch and stream share their operators; a stream of candles is the batch aggregation over a
streaming source. Late ticks are bounded by a watermark, which the tick's time needs to be a
timestamp for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.candles import HOUR_MS, candles
from tidemark.operators.features import signal, wilder_rsi_latest
from tidemark.operators.quality import artefacts

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def tick_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Ticks out of event files as they come into a folder."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        "event_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"), (k + 1).cast("double").alias("quantity"),
        F.col("ts").cast("timestamp").alias("time"), "user_id",
    )


def deduplicated(ticks: DataFrame, late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Each tick once within the watermark, for sources that deliver at least once."""
    return ticks.withWatermark("time", late).dropDuplicatesWithinWatermark([key])


def candle_stream(ticks: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Candles for complete or update mode: the state is a row per candle."""
    return candles(ticks, width_ms)


def closed_candles(ticks: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Candles for append mode: each is emitted once, when the watermark has passed its end.

    With `late` None the ticks have their watermark already.
    """
    ticks = ticks if late is None else ticks.withWatermark("time", late)
    at = F.struct("time", "event_id")
    w = F.window("time", width)
    g = ticks.groupBy(w, "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"), F.count("*").alias("trade_count"),
    )
    return g.select("symbol", F.unix_millis("window.start").alias("open_time"), "open", "high", "low", "close", "volume", "trade_count")


def signal_batches(sink: Callable[[DataFrame, int], None], period: int = 14):
    """A foreachBatch function for complete-mode candles: each symbol's latest RSI and signal."""

    def run(batch: DataFrame, batch_id: int) -> None:
        latest = wilder_rsi_latest(batch, period)
        sink(latest.withColumn("signal", signal(F.col("rsi"))), batch_id)

    return run


def sliding_volumes(ticks: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Volume and trades of overlapping windows; each tick counts in each window that holds it."""
    g = ticks.groupBy(F.window("time", width, slide), "symbol").agg(F.sum("quantity").alias("volume"), F.count("*").alias("trade_count"))
    return g.select("symbol", F.unix_millis("window.start").alias("open_time"), "volume", "trade_count")


def sessions(ticks: DataFrame, gap: str = "2 hours", key: str = "user_id") -> DataFrame:
    """Each key's runs of ticks less than `gap` apart: first and last time, ticks and volume."""
    g = ticks.groupBy(F.session_window("time", gap), key).agg(
        F.count("*").alias("n_ticks"), F.sum("quantity").alias("volume"), F.max("time").alias("last"), F.min("time").alias("first")
    )
    return g.select(key, F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "n_ticks", "volume")


def followed(left: DataFrame, right: DataFrame, key: str = "user_id", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs of a left tick and a right tick of its key not later than `within` after it; both may be streams.

    Watermarks on both sides and the bound on times let the state of old ticks go.
    """
    a = left.withWatermark("time", late).select(F.col(key), F.col("event_id").alias("first_id"), F.col("time").alias("first_time"))
    b = right.withWatermark("time", late).select(F.col(key).alias("key_"), F.col("event_id").alias("next_id"), F.col("time").alias("next_time"))
    near = (F.col("next_time") >= F.col("first_time")) & (F.col("next_time") <= F.col("first_time") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("key_")) & near).drop("key_")


def run_to_table(df: DataFrame, mode: str, folder: str, state_store: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows, which stay in Parquet files below `folder`.

    A batch is written to its own subfolder, again if it is tried again; in complete mode the last
    one holds all. `state_store` is the class that keeps the state, if not the session's.
    """
    spark = df.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)

    def write(batch: DataFrame, batch_id: int) -> None:
        part = "all" if mode == "complete" else str(batch_id)
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={part}")

    spark.conf.set(key, state_store or before)
    try:  # a stream keeps the settings that it starts with
        q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    if not any(r["present"] for r in artefacts(spark, [f"{folder}/rows"]).collect()):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows").select(*df.columns)
