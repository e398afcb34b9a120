"""Joins of time series: as-of, forward-filled, at a fixed offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], tie: str | None = None,
    block: int | None = None,
) -> DataFrame:
    """Each left row with the `values` of the latest right row of its keys not after it, nulls if none.

    Both sides are stacked and sorted once by key and time, and a window carries the last right row
    forward, so it costs one shuffle whatever the number of matches. Right rows of equal time go
    by `tie`. Left rows are never merged or dropped. With `block` (in units of the times, microseconds
    for timestamps) a key's rows are cut into blocks of time, so that a key with most rows is many
    tasks; the last right row of each block is carried to those after it.
    """
    carry = F.struct(F.col(right_time).alias("t"), *(F.col(v).alias(v) for v in values))
    a = left.select(
        *on, F.col(left_time).alias("time_"), F.lit(1).alias("side_"), F.lit(None).cast("string").alias("tie_"),
        F.struct(*left.columns).alias("row_"), F.lit(None).cast(right.select(carry.alias("c")).schema["c"].dataType).alias("carry_"),
    )
    b = right.select(
        *on, F.col(right_time).alias("time_"), F.lit(0).alias("side_"),
        (F.format_string("%020d", F.col(tie).cast("long")) if tie else F.lit(None).cast("string")).alias("tie_"),
        F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), carry.alias("carry_"),
    )
    both = a.unionByName(b)
    order, upto = ("time_", "side_", "tie_"), (Window.unboundedPreceding, Window.currentRow)
    if block is None:
        both = both.withColumn("carry_", F.last("carry_", ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(*upto)))
    else:
        number = F.unix_micros("time_") if isinstance(both.schema["time_"].dataType, T.TimestampType) else F.col("time_")
        both = both.withColumn("block_", F.floor(number / block))
        every = both.groupBy(*on, "block_").agg(F.max_by("carry_", F.when(F.col("side_") == 0, F.struct("time_", F.coalesce("tie_", F.lit(""))))).alias("last_"))
        past = Window.partitionBy(*on).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        names = [f"on{i}_" for i in range(len(on))]
        before = F.last("last_", ignorenulls=True).over(past).alias("before_")
        every = every.select(*(F.col(c).alias(n) for c, n in zip(on, names)), F.col("block_").alias("at_"), before)
        inside = Window.partitionBy(*on, "block_").orderBy(*order).rowsBetween(*upto)
        both = both.withColumn("carry_", F.last("carry_", ignorenulls=True).over(inside))
        same = F.col("block_").eqNullSafe(F.col("at_"))
        for c, n in zip(on, names):
            same = same & F.col(c).eqNullSafe(F.col(n))
        both = both.join(every, same)
        both = both.withColumn("carry_", F.coalesce("carry_", "before_"))
    matched = both.filter("side_ = 1")
    return matched.select("row_.*", F.col("carry_.t").alias(f"asof_{right_time}"), *(F.col(f"carry_.{v}").alias(v) for v in values))


def equi_ffill(left: DataFrame, right: DataFrame, on: list[str], keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Equal-key left join, then the last known values carried forward along each series."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = left.join(right.select(*on, *values), on, "left")
    return joined.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def at_offset(df: DataFrame, keys: list[str], time: str, value: str, offset: int, out: str) -> DataFrame:
    """Each row with `value` of its series exactly `offset` later, by key and not by position."""
    later = df.select(*keys, (F.col(time) - offset).alias(time), F.col(value).alias(out))
    return df.join(later, [*keys, time], "left")
