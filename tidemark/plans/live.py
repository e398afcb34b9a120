"""Queries that run as streams over the events file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.candles import candles
from tidemark.plans import trading  # noqa: F401  its SQL is registered first
from tidemark.plans.base import ORACLES, TICKS, candles_cte, query
from tidemark.sources import scratch
from tidemark.sources.tables import ticks
from tidemark.streaming import live, positions


@query(f"WITH {TICKS}, {candles_cte()} SELECT symbol, open_time, open, high, low, close, volume, trade_count FROM candles")
def stream_candles_complete(spark: SparkSession, d: str) -> DataFrame:
    """The candles of a stream in complete mode, which equal the batch's."""
    return live.run_to_table(live.candle_stream(live.tick_stream(spark, d)), "complete", scratch.path(spark, "stream"))


@query(
    f"""WITH {TICKS}, {candles_cte()} SELECT symbol, open_time, open, high, low, close, volume, trade_count FROM candles
WHERE open_time + 3600000 <= (SELECT max(t) FROM ticks) - 600000"""
)
def stream_candles_closed(spark: SparkSession, d: str) -> DataFrame:
    """Candles in append mode: those whose end the watermark, ten minutes behind the latest tick, has passed."""
    c = live.closed_candles(live.deduplicated(live.tick_stream(spark, d)), late=None)
    return live.run_to_table(c, "append", scratch.path(spark, "stream"))


@query(
    f"""WITH {TICKS}, s AS (SELECT symbol, quantity, unnest([t // 1800000 * 1800000, t // 1800000 * 1800000 - 1800000]) AS open_time FROM ticks)
SELECT symbol, open_time, sum(quantity) AS volume, count(*) AS trade_count FROM s GROUP BY ALL"""
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Hours that begin every half hour, as a stream."""
    return live.run_to_table(live.sliding_volumes(live.tick_stream(spark, d)), "complete", scratch.path(spark, "stream"))


@query(
    f"""WITH {TICKS}, n AS (SELECT user_id, ts, t, quantity, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS, true) AS INTEGER) AS new FROM ticks),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(t) AS first_ms, max(t) AS last_ms, count(*) AS n_ticks, sum(quantity) AS volume FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, two hours apart at least, as a stream."""
    return live.run_to_table(live.sessions(live.tick_stream(spark, d)), "complete", scratch.path(spark, "stream"))


@query(
    f"""WITH {TICKS} SELECT a.user_id, a.event_id AS first_id, a.t AS first_ms, b.event_id AS next_id, b.t AS next_ms FROM ticks a
JOIN ticks b ON b.user_id = a.user_id AND b.symbol = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.symbol = 'click'"""
)
def stream_followed(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within an hour after a click of the same user, as a join of two streams."""
    t = live.tick_stream(spark, d)
    j = live.run_to_table(live.followed(t.filter("symbol = 'click'"), t.filter("symbol = 'purchase'")), "append", scratch.path(spark, "stream"))
    return j.select("user_id", "first_id", F.unix_millis("first_time").alias("first_ms"), "next_id", F.unix_millis("next_time").alias("next_ms"))


@query(ORACLES["risk_fold"])
def stream_risk(spark: SparkSession, d: str) -> DataFrame:
    """The risk rules over a stream of candles in eight batches: position, daily counter and means of RSI as timed state."""
    folder = scratch.path(spark, "stream")
    c = candles(ticks(spark, d)).select("symbol", "open_time", "close")
    first, last = c.agg(F.min("open_time"), F.max("open_time")).first()
    part = F.floor((F.col("open_time") - F.lit(first)) * 8 / F.lit((last or 0) - (first or 0) + 1))
    c.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    for k in range(8):  # files come in order of time, one a batch
        parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/candles")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/candles")
    log = live.run_to_table(positions.risk_log(stream, 45, 55), "append", folder, positions.ROCKS)
    return log.withColumn("pnl", F.round("pnl", 3) + 0.0)
