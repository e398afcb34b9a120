"""Candles from ticks, complete grids, sanity, order flow and volume profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import running, series

HOUR_MS, DAY_MS, MINUTE_MS = 3_600_000, 86_400_000, 60_000
LARGE_TRADE, TICK, VALUE_AREA = 1.0, 0.1, 0.70
OHLCV = ("open", "high", "low", "close", "volume")


def floor_ms(t: Column, width: int) -> Column:
    return t - F.pmod(t, F.lit(width))


def candles(ticks: DataFrame, width_ms: int = HOUR_MS, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Open, high, low, close, volume and trades of each bucket of `width_ms`; equal times go by event_id."""
    at = F.struct("time", "event_id")
    bucket = floor_ms(F.unix_millis("time"), width_ms).alias("open_time")
    return ticks.groupBy(*keys, bucket).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"),
        F.count("*").alias("trade_count"),
    )


def on_grid(df: DataFrame, step_ms: int = HOUR_MS, key: str = "symbol", time: str = "open_time") -> DataFrame:
    """Every step from a key's first row to its last; rows that had to be added have is_real false."""
    bounds = df.groupBy(key).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    steps = bounds.select(key, F.explode(F.sequence("lo", "hi", F.lit(step_ms).cast("long"))).alias(time))
    return steps.join(df.withColumn("is_real", F.lit(True)), [key, time], "left").withColumn(
        "is_real", F.coalesce("is_real", F.lit(False))
    )


def violations() -> dict[str, Column]:
    """What a sane candle never shows, by name."""
    o, h, l, c, v = (F.col(x) for x in OHLCV)
    return {
        "bad_high": h < F.greatest(o, c, l),
        "bad_low": l > F.least(o, c, h),
        "nonpositive_price": F.least(o, h, l, c) <= 0,
        "negative_volume": v < 0,
    }


def quarantined(df: DataFrame) -> DataFrame:
    """Rows with a violation keep their time but lose their values, and so become gaps."""
    bad = F.lit(False)
    for v in violations().values():
        bad = bad | F.coalesce(v, F.lit(False))
    return df.withColumn("bad_", bad).select(
        *(F.when(~F.col("bad_"), F.col(c)).alias(c) if c in OHLCV else c for c in df.columns), F.col("bad_").alias("is_bad")
    )


def sanity_report(df: DataFrame) -> DataFrame:
    v = violations()
    any_bad = F.lit(False)
    for c in v.values():
        any_bad = any_bad | F.coalesce(c, F.lit(False))
    return df.agg(*(F.count_if(c).alias(n) for n, c in v.items()), F.count_if(any_bad).alias("rows_quarantined"))


def gap_report(df: DataFrame, step_ms: int = HOUR_MS, key: str = "symbol", time: str = "open_time") -> DataFrame:
    """Rows, gaps, missing steps and the largest distance of each key."""
    step = F.col(time) - F.lag(time).over(series(key, order=time))
    d = df.select(key, step.alias("step"))
    return d.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("step") != step_ms).alias("n_gaps"),
        F.coalesce(F.sum(F.floor(F.col("step") / step_ms) - 1), F.lit(0)).alias("missing_steps"),
        F.max("step").alias("largest_step_ms"),
    )


def order_flow(trades: DataFrame, width_ms: int = DAY_MS, large: float = LARGE_TRADE, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Buy and sell volumes and counts of each bucket; a buyer that is the maker makes the trade a sale."""
    sale, q = F.col("is_buyer_maker"), F.col("quantity")
    buy_vol, sell_vol = F.sum(F.when(~sale, q).otherwise(0.0)), F.sum(F.when(sale, q).otherwise(0.0))
    return trades.groupBy(*keys, floor_ms(F.col("time_ms"), width_ms).alias("open_time")).agg(
        buy_vol.alias("buy_vol"),
        sell_vol.alias("sell_vol"),
        F.sum(q).alias("total_vol"),
        (buy_vol - sell_vol).alias("delta"),
        F.count_if(~sale).alias("buy_trade_count"),
        F.count_if(sale).alias("sell_trade_count"),
        F.count_if(q >= large).alias("large_trade_count"),
        F.sum(F.when(q >= large, q).otherwise(0.0)).alias("large_trade_vol"),
    )


def volume_profile(trades: DataFrame, width_ms: int = DAY_MS, tick: float = TICK, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Volume, bought and sold, of each bucket and price level (rounded half to even on the tick)."""
    level = F.round(F.bround(F.col("price") / tick) * tick, 2)
    sale, q = F.col("is_buyer_maker"), F.col("quantity")
    return trades.groupBy(*keys, floor_ms(F.col("time_ms"), width_ms).alias("open_time"), level.alias("level")).agg(
        F.sum(q).alias("vol"), F.sum(F.when(~sale, q).otherwise(0.0)).alias("buy"), F.sum(F.when(sale, q).otherwise(0.0)).alias("sell")
    )


def point_of_control(profile: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The level with the most volume, of equal ones the lowest."""
    best = F.max_by("level", F.struct(F.col("vol"), (-F.col("level")).alias("low")))
    return profile.groupBy(*keys, "open_time").agg(best.alias("poc_price"), F.max("vol").alias("poc_vol"))


def max_imbalance(profile: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The largest |buy - sell| / (buy + sell) of a bucket's levels, 0 without volume."""
    share = F.abs(F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0.0))
    return profile.groupBy(*keys, "open_time").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("max_imbalance"))


def value_area(profile: DataFrame, share: float = VALUE_AREA, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Point of control, and the highest and lowest level of the area around it that holds `share` of the volume.

    The area grows by the neighbouring level with more volume, upward if they are equal, and by
    the only one left at an edge. It is a fold over a bucket's levels, sorted in one array.
    """
    ladder = profile.groupBy(*keys, "open_time").agg(
        F.array_sort(F.collect_list(F.struct("level", "vol"))).alias("s"), F.sum("vol").alias("all_vol"),
        F.max_by("level", F.struct(F.col("vol"), (-F.col("level")).alias("low"))).alias("poc_price"),
    )
    at = F.array_position(F.transform("s", lambda x: x.level), F.col("poc_price")).cast("int")
    d = ladder.withColumn("at", at)
    vol = lambda i: F.coalesce(F.get("s", i - 1).vol, F.lit(-1.0))  # noqa: E731  positions from 1; none there: -1
    start = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), vol(F.col("at")).alias("sum"))

    def grow(a: Column, _: Column) -> Column:
        up, down = vol(a.hi + 1), F.when(a.lo > 1, vol(a.lo - 1)).otherwise(-1.0)
        more = (a["sum"] < F.col("all_vol") * share) & (F.greatest(up, down) >= 0)
        rises = up >= down
        return F.struct(
            F.when(more & ~rises, a.lo - 1).otherwise(a.lo).alias("lo"),
            F.when(more & rises, a.hi + 1).otherwise(a.hi).alias("hi"),
            F.when(more, a["sum"] + F.greatest(up, down)).otherwise(a["sum"]).alias("sum"),
        )

    area = F.aggregate("s", start, grow)
    return d.withColumn("a", area).select(
        *keys, "open_time", "poc_price", F.get("s", F.col("a.hi") - 1).level.alias("vah"), F.get("s", F.col("a.lo") - 1).level.alias("val")
    )


def daily_cvd(flow: DataFrame, key: str = "symbol") -> DataFrame:
    """Cumulative delta that starts anew each UTC day."""
    d = flow.withColumn("day_", floor_ms(F.col("open_time"), DAY_MS))
    return d.withColumn("cvd", running(F.sum, "delta", series(key, "day_"))).drop("day_")


def liquidation_buckets(events: DataFrame, width_ms: int = HOUR_MS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bought, sold and net liquidated volume and the count of each bucket; what isn't BUY is a sale."""
    bought = F.upper("side") == "BUY"
    buy, sell = F.sum(F.when(bought, F.col("quantity")).otherwise(0.0)), F.sum(F.when(bought, 0.0).otherwise(F.col("quantity")))
    return events.groupBy(*keys, floor_ms(F.col("time_ms"), width_ms).alias("open_time")).agg(
        buy.alias("liq_buy_vol"), sell.alias("liq_sell_vol"), (buy - sell).alias("liq_net_vol"), F.count("*").alias("liq_count")
    )
