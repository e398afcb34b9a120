"""The driver's tables, and their projections onto the market-data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out to all cores if its files give fewer tasks than that, for costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: (event_id, symbol, price, quantity, time, user_id)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        (k + 1).cast("double").alias("quantity"),
        F.col("ts").cast("timestamp").alias("time"),
        "user_id",
    )


def agg_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as aggregated trades: (symbol, price, quantity, is_buyer_maker, time_ms)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("is_buyer_maker"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("time_ms"),
    )


def between(df: DataFrame, first, last, time: str = "open_time") -> DataFrame:
    """Rows of a time slice, both ends included; the bounds reach the scan."""
    return df.filter(F.col(time).between(first, last))
