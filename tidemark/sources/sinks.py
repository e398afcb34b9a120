"""Sinks: insert-or-ignore, replace, upsert, incremental skip, resume, exports, dual writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in `order`, which should be total."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("row_", r).filter("row_ = 1").drop("row_")


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The incoming rows an insert-or-ignore adds: the first write of a key wins."""
    return first_of_each(incoming, key, order).join(existing.select(*key), key, "left_anti")


def insert_or_ignore(incoming: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    """Appends to a Parquet table the rows with keys it doesn't have."""
    spark = incoming.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        first_of_each(incoming, key, order).write.parquet(path)
        return
    new_rows(incoming, existing, key, order).write.mode("append").parquet(path)


def upserted(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """`existing` with `incoming` rows in place of those with their keys: the last write wins."""
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def has_month(df: DataFrame, month_start_ms: int, next_month_ms: int, time: str = "open_time") -> bool:
    """Whether a month has been ingested: any row in [start, next)."""
    return not df.filter((F.col(time) >= month_start_ms) & (F.col(time) < next_month_ms)).limit(1).isEmpty()


def resume_from(df: DataFrame, step_ms: int = 3_600_000, time: str = "open_time") -> int | None:
    """The next time to load: the latest one and a step, None for an empty table."""
    latest = df.agg(F.max(time)).first()[0]
    return None if latest is None else latest + step_ms


def without_bad_times(df: DataFrame, time: str = "funding_time", least: int = 10**12) -> DataFrame:
    """Rows whose time isn't too small to be in milliseconds."""
    return df.filter(F.col(time) >= least)


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_ticks(df: DataFrame, path: str, time: str = "time") -> None:
    """A tick table laid out by day and sorted by symbol and time, so that scans prune days and row groups.

    A day's ticks of a symbol are dealt out by the hour, so that the busiest symbol's day isn't one task.
    """
    out = df.withColumn("day", F.to_date(time))
    out.repartition("day", "symbol", F.hour(time)).sortWithinPartitions("symbol", time).write.mode("append").partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(value: dict, spark: SparkSession, path: str) -> None:
    """A small document as one JSON file, in any store Spark writes."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(papers: DataFrame) -> DataFrame:
    """A line per paper with a flag that tells whether its text is there."""
    return papers.select("arxiv_id", "title", "published", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"))


def append_manifest(papers: DataFrame, path: str) -> None:
    """Adds the papers' lines to a manifest of JSON lines."""
    manifest(papers).write.mode("append").json(path)


def stream_to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "symbol"):
    """Starts sending a stream's rows as JSON; offsets are kept in `checkpoint`, so each row is sent at least once."""
    out = to_messages(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("checkpointLocation", checkpoint).start()


def store_index(table: DataFrame, path: str) -> DataFrame:
    """Writes the token table of a corpus, from which sparse searches are answered, and reads it again."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


def dual_write(paths: list[str], failures: list[tuple[int, str, str]]):
    """A foreachBatch function that writes a batch to each path; one that fails doesn't stop the others.

    A batch goes to its own subfolder, overwritten when it is tried again, so each is stored once.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df.persist()
        failed = 0
        try:
            for path in paths:
                try:
                    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
                except Exception as e:
                    failures.append((batch_id, path, str(e)))
                    failed += 1
            if failed == len(paths):
                raise RuntimeError(f"no store took batch {batch_id}")
        finally:
            df.unpersist()

    return write


def to_messages(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows as Kafka messages: the key as text, the row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, key: str = "symbol", retries: int = 10) -> None:
    """Sends rows as JSON; the client goes on trying until the broker is there."""
    out = to_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    out.option("kafka.retries", str(retries)).option("kafka.reconnect.backoff.ms", "2000").save()
