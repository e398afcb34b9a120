"""A paged source walked backwards in time, as a Python data source: a task for each slice of time, pages of a fixed size.

`fetch(end_ms, limit)` returns up to `limit` rows (open_time, sum_open_interest, sum_oi_value) that
end at `end_ms`, in order of time. The walk ends at `start_ms` or with a short page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "open_time long, sum_open_interest double, sum_oi_value double"
Fetch = Callable[[int, int], list[tuple[int, float, float]]]


def walk_back(fetch: Fetch, start_ms: int, end_ms: int, limit: int = 500) -> Iterator[tuple[int, float, float]]:
    while end_ms >= start_ms:
        page = fetch(end_ms, limit)
        yield from (row for row in page if row[0] >= start_ms)
        if len(page) < limit:
            return
        end_ms = page[0][0] - 1


class Slice(InputPartition):
    def __init__(self, start_ms: int, end_ms: int):
        self.start_ms, self.end_ms = start_ms, end_ms


def slices(start_ms: int, end_ms: int, slice_ms: int | None) -> list[Slice]:
    """[start, end] cut at multiples of `slice_ms`, or whole."""
    if slice_ms is None or end_ms < start_ms:
        return [Slice(start_ms, end_ms)]
    firsts = [start_ms, *range((start_ms // slice_ms + 1) * slice_ms, end_ms + 1, slice_ms)]
    return [Slice(a, b - 1) for a, b in zip(firsts, [*firsts[1:], end_ms + 1])]


def paged_source(fetch: Fetch, start_ms: int, end_ms: int, limit: int = 500, slice_ms: int | None = None) -> type[DataSource]:
    """A data source class to register with `spark.dataSource.register`."""

    class Reader(DataSourceReader):
        def partitions(self):
            return slices(start_ms, end_ms, slice_ms)

        def read(self, partition):
            return walk_back(fetch, partition.start_ms, partition.end_ms, limit)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "paged_open_interest"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

    return Source


def read_open_interest(spark: SparkSession, fetch: Fetch, start_ms: int, end_ms: int, limit: int = 500, slice_ms: int | None = None) -> DataFrame:
    """Open interest with its change from the row before (null for the first).

    With `slice_ms`, each such slice of time is walked by a task of its own, and the row before is looked for within
    the slice, and for its first row in the slice before (as long as that isn't empty, else the last one that isn't).
    """
    spark.dataSource.register(paged_source(fetch, start_ms, end_ms, limit, slice_ms))
    rows = spark.read.format("paged_open_interest").load()
    if slice_ms is None:
        order = Window.orderBy("open_time")
        return rows.withColumn("oi_delta", F.col("sum_open_interest") - F.lag("sum_open_interest").over(order))
    part = F.floor(F.col("open_time") / slice_ms)
    inside = rows.withColumn("slice_", part)
    order = Window.partitionBy("slice_").orderBy("open_time")
    last = inside.groupBy("slice_").agg(F.max_by("sum_open_interest", "open_time").alias("last_"))  # a row a slice
    before = last.select("slice_", F.lag("last_").over(Window.orderBy("slice_")).alias("before_"))
    j = inside.withColumn("own_", F.lag("sum_open_interest").over(order)).withColumn("n_", F.row_number().over(order)).join(F.broadcast(before), "slice_")
    earlier = F.when(F.col("n_") == 1, F.col("before_")).otherwise(F.col("own_"))
    return j.select(*rows.columns, (F.col("sum_open_interest") - earlier).alias("oi_delta"))
