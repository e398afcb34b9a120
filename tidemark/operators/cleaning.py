"""Cleaning with statistics fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import exact_quantiles, wide_stats

CLIP, LEAST = 0.01, 50
#: What is never trained on, what is never clipped, and how missing entries of named columns are filled.
NOT_TRAINED = ("open_time", "open", "high", "low", "close", "sum_open_interest", "oi_zscore", "oi_delta_norm")
NOT_CLIPPED = (
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "cascade_flag", "cascade_4h", "cascade_24h", "funding_extreme_long", "funding_extreme_short",
    "is_bullish", "is_us_session", "is_asian_session", "is_european_session", "liq_long_proxy", "liq_short_proxy", *NOT_TRAINED,
)
ORDER_FLOW = ("delta_norm", "cvd_norm", "poc_distance", "va_range", "large_trade_ratio", "large_trade_vol", "buy_vol_pct")
CARRIED = ("funding_rate", "funding_8h_change")
ZERO_WORDS = ("log_return", "return_", "vol_zscore", "vol_ratio", "candle_body", "wick")


def fit(train: DataFrame, columns: list[str], clip: float = CLIP, time: str = "open_time") -> DataFrame:
    """(feature, train_median, clip_lo, clip_hi), a row per column, out of training rows.

    Bounds need `LEAST` values and differ; a column without them, or one of `NOT_CLIPPED`, isn't clipped.
    """
    shares = (clip, 0.5, 1 - clip)
    s = wide_stats(train, columns, shares)
    q, _ = exact_quantiles(train, columns, shares, s)
    rows = []
    for c in columns:
        if s[c]["n"]:
            lo, median, hi = q[c]
            usable = s[c]["n"] >= LEAST and hi > lo and c not in NOT_CLIPPED
            rows.append((c, median, lo if usable else None, hi if usable else None))
    return train.sparkSession.createDataFrame(rows, "feature string, train_median double, clip_lo double, clip_hi double")


def fitted(stats: DataFrame) -> dict[str, dict[str, float | None]]:
    """The fitted statistics by column, to write into plans as literals: a row per column."""
    return {r["feature"]: r.asDict() for r in stats.collect()}


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def clipped(x: Column, lo: float | None, hi: float | None) -> Column:
    return x if lo is None or hi is None else F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def fill_of(name: str, median: float | None) -> float:
    """The value of a missing entry: 0 for order flow and changes, neutral values for indicators, else the training median."""
    if name in ORDER_FLOW or "macd" in name or any(w in name for w in ZERO_WORDS):
        return 0.0
    if name in ("rsi_7", "rsi_14"):
        return 50.0
    if "bb_pct_b" in name:
        return 0.5
    return median if median is not None else 0.0


def once(df: DataFrame, key: str = "symbol", time: str = "open_time") -> DataFrame:
    """One row of each key and time; of several, the one with the least hash of all columns."""
    w = Window.partitionBy(key, time).orderBy(F.xxhash64(*df.columns))
    return df.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def apply(
    df: DataFrame, stats: dict[str, dict], columns: list[str], key: str = "symbol", time: str = "open_time",
    carried: tuple[str, ...] = CARRIED, fill: Callable[[str, float | None], float] = fill_of, drop: tuple[str, ...] = (),
) -> DataFrame:
    """Infinities to null, clipping, imputation and dropped columns, in that order, in one projection.

    Columns in `carried` take the last known value of the series, before the first one the fill.
    """
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for c in df.columns:
        if c in drop:
            continue
        if c not in columns:
            out.append(F.col(c))
            continue
        s = stats.get(c, {})
        x = clipped(finite(F.col(c)), s.get("clip_lo"), s.get("clip_hi"))
        if c in carried:
            x = F.last(x, ignorenulls=True).over(w)
        out.append(F.coalesce(x, F.lit(float(fill(c, s.get("train_median"))))).alias(c))
    return df.select(*out)


def cleaned(df: DataFrame, stats: dict[str, dict], columns: list[str], correlated: tuple[str, ...] = (), key: str = "symbol", time: str = "open_time") -> DataFrame:
    """The whole cleaning in its order: repeated times, infinities, clipping, fills, correlated and untrained columns."""
    drop = tuple(correlated) + tuple(c for c in NOT_TRAINED if c != time)
    return apply(once(df, key, time), stats, columns, key, time, drop=drop)


def within_bounds(clean: DataFrame, stats: dict[str, dict], tolerance: float = 1e-9) -> DataFrame:
    """(feature, n_outside, n_null) of each clipped column that is left: a clean table has none of either."""
    have = [c for c in stats if c in clean.columns and stats[c].get("clip_lo") is not None]
    sums = []
    for c in have:
        x, lo, hi = F.col(c), stats[c]["clip_lo"], stats[c]["clip_hi"]
        # a fill may lie outside
        f = fill_of(c, stats[c].get("train_median"))
        sums += [F.count_if(((x < lo - tolerance) | (x > hi + tolerance)) & (x != f)).alias(f"{c}__o"), F.count_if(x.isNull()).alias(f"{c}__n")]
    cells = (F.struct(F.lit(c).alias("feature"), F.col(f"{c}__o").alias("n_outside"), F.col(f"{c}__n").alias("n_null")) for c in have)
    return clean.agg(*sums).select(F.inline(F.array(*cells)))


def effects(df: DataFrame, stats: dict[str, dict], columns: list[str]) -> DataFrame:
    """How many values of each column cleaning clips, fills, or replaces as infinite, in one pass."""
    sums = []
    for c in columns:
        s, x = stats.get(c, {}), finite(F.col(c))
        lo, hi = s.get("clip_lo"), s.get("clip_hi")
        cut = F.lit(False) if lo is None else (x < lo) | (x > hi)
        sums += [F.count_if(cut).alias(f"{c}__clipped"), F.count_if(x.isNull()).alias(f"{c}__filled"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"{c}__inf")]
    one = df.agg(*sums)
    cells = (F.struct(F.lit(c).alias("feature"), F.col(f"{c}__clipped").alias("n_clipped"), F.col(f"{c}__filled").alias("n_filled"), F.col(f"{c}__inf").alias("n_infinite")) for c in columns)
    return one.select(F.inline(F.array(*cells)))
