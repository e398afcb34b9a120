"""The feature table: returns, volatility, momentum, order flow, funding, open interest, targets."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators.candles import on_grid, quarantined

SPANS = (8, 21, 50, 200)
#: Session hours in UTC (from, to), funding limits.
SESSIONS = {"is_asian_session": (0, 8), "is_european_session": (7, 16), "is_us_session": (13, 22), "is_eu_us_overlap": (13, 16)}
EXTREME_LONG, EXTREME_SHORT = 0.0008, -0.0002
HORIZON = 4


def with_time(df: DataFrame) -> DataFrame:
    """Hour, day of week (Monday 0), cyclic encodings and session flags of open_time in UTC."""
    at = F.timestamp_millis("open_time")
    d = df.withColumn("hour_of_day", F.hour(at)).withColumn("day_of_week", F.weekday(at))
    angle = lambda c, n: F.col(c) * (2 * pi) / n
    new = {"is_weekend": W.flag(F.col("day_of_week") >= 5)}
    for name, c, n in (("hour", "hour_of_day", 24.0), ("dow", "day_of_week", 7.0)):
        new |= {f"{name}_sin": F.sin(angle(c, n)), f"{name}_cos": F.cos(angle(c, n))}
    h = F.col("hour_of_day")
    return d.withColumns(new | {k: W.flag((h >= a) & (h < b)) for k, (a, b) in SESSIONS.items()})


def with_returns(df: DataFrame, key: str = "symbol") -> DataFrame:
    w = W.series(key)
    new = {f"log_return_{n}h": W.log_change("close", w, n) for n in (1, 4, 24)}
    return df.withColumns(new | {f"return_{n}h": W.change("close", w, n) for n in (1, 4, 24)})


def with_candle_shape(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    both = o.isNotNull() & c.isNotNull()
    return df.withColumns(
        {
            "candle_body": W.ratio(F.abs(c - o), o),
            "upper_wick": F.when(both, W.ratio(h - F.greatest(o, c), o)),
            "lower_wick": F.when(both, W.ratio(F.least(o, c) - l, o)),
            "is_bullish": W.flag(c > o),
        }
    )


def with_volatility(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Needs log_return_1h."""
    w = W.series(key)
    d = df.withColumns({"volatility_24h": W.std("log_return_1h", w, 24), "volatility_7d": W.std("log_return_1h", w, 168)})
    return d.withColumn("vol_ratio", W.ratio("volatility_24h", "volatility_7d"))


def with_rsi(df: DataFrame, period: int, key: str = "symbol", out: str | None = None) -> DataFrame:
    """Relative strength over weighted means of gains and losses; null without losses."""
    d = df.withColumn("step_", W.diff("close", W.series(key)))
    up = F.when(F.col("step_").isNotNull(), F.greatest("step_", F.lit(0.0)))
    down = F.when(F.col("step_").isNotNull(), F.greatest(-F.col("step_"), F.lit(0.0)))
    d = d.withColumns({"up_": up, "down_": down})
    d = W.ewm(d, [key], "open_time", ["up_", "down_"], 1 / period, ["avg_up_", "avg_down_"], adjust=True, min_periods=period)
    rsi = 100 - 100 / (1 + W.ratio("avg_up_", "avg_down_"))
    return d.withColumn(out or f"rsi_{period}", rsi).drop("step_", "up_", "down_", "avg_up_", "avg_down_")


def with_ema(df: DataFrame, spans: tuple[int, ...] = SPANS, key: str = "symbol") -> DataFrame:
    for n in spans:
        df = W.ewm(df, [key], "open_time", "close", 2 / (n + 1), f"ema_{n}")
    return df


def with_ema_flags(df: DataFrame) -> DataFrame:
    new = {"ema_8_21_cross": W.flag(F.col("ema_8") > F.col("ema_21"))}
    return df.withColumns(new | {f"price_vs_ema_{n}": W.ratio(F.col("close") - F.col(f"ema_{n}"), f"ema_{n}") for n in (50, 200)})


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, key: str = "symbol") -> DataFrame:
    """MACD line, signal, histogram, and +1 / -1 where the line crosses its signal."""
    for n, out in ((fast, "fast_"), (slow, "slow_")):
        df = W.ewm(df, [key], "open_time", "close", 2 / (n + 1), out)
    d = df.withColumn("macd", F.col("fast_") - F.col("slow_")).drop("fast_", "slow_")
    d = W.ewm(d, [key], "open_time", "macd", 2 / (signal + 1), "macd_signal")
    w = W.series(key)
    above, below = F.col("macd") > F.col("macd_signal"), F.col("macd") < F.col("macd_signal")
    was = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    not_above = was(F.col("macd") <= F.col("macd_signal"))
    not_below = was(F.col("macd") >= F.col("macd_signal"))
    cross = F.when(above & not_above, 1).when(below & not_below, -1).otherwise(0)
    return d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).withColumn("macd_cross", cross)


def with_bollinger(df: DataFrame, n: int = 20, width: float = 2.0, key: str = "symbol") -> DataFrame:
    w = W.series(key)
    d = df.withColumns({"bb_mid": W.mean("close", w, n), "bb_std_": W.std("close", w, n)})
    d = d.withColumns({"bb_upper": F.col("bb_mid") + width * F.col("bb_std_"), "bb_lower": F.col("bb_mid") - width * F.col("bb_std_")})
    spread = F.col("bb_upper") - F.col("bb_lower")
    return d.withColumns({"bb_width": W.ratio(spread, "bb_mid"), "bb_pct_b": W.ratio(F.col("close") - F.col("bb_lower"), spread)}).drop("bb_std_")


def with_atr(df: DataFrame, n: int = 14, key: str = "symbol") -> DataFrame:
    """True range is the largest of three distances that are known; its weighted mean, and that over the close."""
    before = F.lag("close").over(W.series(key))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    d = W.ewm(df.withColumn("true_range", tr), [key], "open_time", "true_range", 1 / n, f"atr_{n}", adjust=True, min_periods=n)
    return d.withColumn("atr_ratio", W.ratio(f"atr_{n}", "close"))


def with_volume(df: DataFrame, n: int = 24, key: str = "symbol") -> DataFrame:
    w = W.series(key)
    d = df.withColumns({"vol_sma_24": W.mean("volume", w, n), "vol_zscore": W.zscore("volume", w, n)})
    return d.withColumn("vol_ratio_24h", W.ratio("volume", "vol_sma_24"))


def with_order_flow(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Needs delta, total_vol, poc_price, vah, val, large_trade_vol, trade counts, cvd and close."""
    w = W.series(key)
    buys, sells = F.col("buy_trade_count"), F.col("sell_trade_count")
    return df.withColumns(
        {
            "delta_norm": W.ratio("delta", "total_vol"),
            "poc_distance": W.ratio(F.col("close") - F.col("poc_price"), "close"),
            "va_range": W.ratio(F.col("vah") - F.col("val"), "close"),
            "large_trade_ratio": W.ratio("large_trade_vol", "total_vol"),
            "buy_sell_cnt_ratio": W.ratio(buys, buys + sells),
            "cvd_divergence": divergence("cvd", "close", w),
            "cvd_norm": W.ratio("cvd", W.total("total_vol", w, 24)),
        }
    )


def divergence(x: str, price: str, w, n: int = 4) -> Column:
    """1 where x and the price went different ways over n rows, and where that isn't known."""
    return W.differs(F.signum(W.diff(x, w, n)), F.signum(W.diff(price, w, n)))


def with_funding(df: DataFrame, key: str = "symbol") -> DataFrame:
    w = W.series(key)
    d = df.withColumn("funding_rate", F.coalesce("funding_rate", F.lit(0.0)))
    return d.withColumns(
        {
            "funding_extreme_long": W.flag(F.col("funding_rate") > EXTREME_LONG),
            "funding_extreme_short": W.flag(F.col("funding_rate") < EXTREME_SHORT),
            "funding_8h_change": W.diff("funding_rate", w, 8),
            "funding_24h_mean": W.mean("funding_rate", w, 24),
        }
    )


def with_open_interest(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Needs sum_open_interest, its change oi_delta, and close; an unknown change counts as none."""
    w = W.series(key)
    d = df.withColumn("oi_delta", F.coalesce(F.col("oi_delta").cast("double"), F.lit(0.0)))
    return d.withColumns(
        {
            "oi_zscore": W.zscore("sum_open_interest", w, 24),
            "oi_delta_norm": W.ratio("oi_delta", "sum_open_interest"),
            "oi_price_divergence": W.differs(F.signum(W.diff("close", w, 4)), F.signum(W.total("oi_delta", w, 4))),
        }
    )


def open_interest_changes(oi: DataFrame, key: str = "symbol") -> DataFrame:
    """Open interest (sum_open_interest) with oi_delta, the change from the row before; unknown on the first."""
    return oi.withColumn("oi_delta", W.diff("sum_open_interest", W.series(key)))


def with_liquidation_proxies(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Falls in open interest that come with large returns; needs oi_delta and log_return_1h."""
    w = W.series(key)
    d = df.withColumn("oi_z_", W.zscore("oi_delta", w, 24))
    z, r = F.col("oi_z_"), F.col("log_return_1h")
    d = d.withColumns(
        {
            "liq_long_proxy": W.flag((z < -1.5) & (r < -0.01)),
            "liq_short_proxy": W.flag((z < -1.5) & (r > 0.01)),
            "cascade_flag": W.flag((z < -2) & (F.abs(r) > 0.015)),
        }
    )
    return d.withColumns(
        {
            "liq_direction": F.col("liq_short_proxy") - F.col("liq_long_proxy"),
            "cascade_4h": W.total("cascade_flag", w, 4),
            "cascade_24h": W.total("cascade_flag", w, 24),
        }
    ).drop("oi_z_")


def with_liquidations(df: DataFrame, key: str = "symbol") -> DataFrame:
    """From liquidated volumes themselves: total, a spike above two deviations, the direction of the net."""
    w = W.series(key)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = df.withColumn("liq_total", zero("liq_buy_vol") + zero("liq_sell_vol"))
    return d.withColumns({"liq_spike": W.flag(W.zscore("liq_total", w, 24) > 2), "liq_net_sign": F.signum(zero("liq_net_vol")).cast("int")})


def with_target(df: DataFrame, n: int = HORIZON, key: str = "symbol") -> DataFrame:
    ahead = F.lead("close", n).over(W.series(key))
    d = df.withColumn(f"target_return_{n}h", W.ratio(ahead, "close") - 1)
    return d.withColumn(f"target_direction_{n}h", F.signum(f"target_return_{n}h").cast("int"))


def price_features(grid: DataFrame, key: str = "symbol") -> DataFrame:
    """All features that candles alone give, on a complete grid; an unknown share of taker buys counts as half."""
    d = with_candle_shape(with_returns(with_time(grid), key))
    d = with_bollinger(with_volume(with_volatility(d, key), key=key), key=key)
    d = with_rsi(with_rsi(d, 14, key), 7, key)
    d = with_atr(with_ema_flags(with_ema(with_macd(d, key=key), key=key)), key=key)
    if "taker_buy_ratio" in d.columns:
        d = d.withColumn("taker_buy_ratio", F.coalesce("taker_buy_ratio", F.lit(0.5)))
    return with_target(d, key=key)


def feature_table(
    klines: DataFrame, footprint: DataFrame | None = None, open_interest: DataFrame | None = None, liquidations: DataFrame | None = None,
    funding: DataFrame | None = None, key: str = "symbol", warm_up: int = 200,
) -> DataFrame:
    """The joined table of all families: sane candles on a complete grid, with what the other tables have for the hour.

    The funding rate of an hour is carried forward. Families whose table is missing are left out;
    real liquidations make features only where there is no open interest.
    """
    grid = on_grid(quarantined(klines).drop("is_bad"), key=key)
    # a quarantined candle is a gap like any other
    grid = grid.withColumn("is_real", F.col("is_real") & F.col("close").isNotNull())
    at = [key, "open_time"]
    d = joined(grid, [x for x in (footprint, open_interest, liquidations) if x is not None], at)
    if funding is not None:
        d = d.join(funding, at, "left").withColumn("funding_rate", W.ffill("funding_rate", W.series(key)))
    d = price_features(d, key).drop("bb_mid", "true_range")
    if footprint is not None:
        d = with_order_flow(d, key)
    if funding is not None:
        d = with_funding(d, key)
    if open_interest is not None:
        d = with_liquidation_proxies(with_open_interest(d, key), key)
    elif liquidations is not None:
        d = with_liquidations(d, key)
    return finished(d, warm_up, key)


def finished(features: DataFrame, warm_up: int = 200, key: str = "symbol") -> DataFrame:
    """Without a series' first rows, whose windows aren't full, and without rows the grid added."""
    d = features.withColumn("n_", F.row_number().over(W.series(key)))
    return d.filter((F.col("n_") > warm_up) & F.col("is_real")).drop("n_", "is_real")


def joined(klines: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Candles with what other tables have for the same keys."""
    for other in others:
        klines = klines.join(other, keys, "left")
    return klines


def wilder_rsi(candles: DataFrame, period: int = 14, key: str = "symbol") -> DataFrame:
    """(key, open_time, close, rsi) with Wilder's RSI: the first means are plain, 100 without losses, null with too few closes.

    From the first mean on it is y = y * (n - 1) / n + x / n, a recurrence that windows solve.
    """
    w = W.series(key)
    d = candles.select(key, "open_time", F.col("close"), F.row_number().over(w).alias("n_"), (F.col("close") - F.lag("close").over(w)).alias("step_"))
    d = d.withColumns({"up_": F.greatest("step_", F.lit(0.0)), "down_": F.greatest(-F.col("step_"), F.lit(0.0))})
    first = w.rowsBetween(-(period - 1), 0)
    n = F.col("n_")
    d = d.withColumns({f"first_{x}": F.avg(x).over(first) for x in ("up_", "down_")})
    gains = {
        f"avg{x}": F.when(n == period + 1, F.col(f"first_{x}")).when(n > period + 1, F.col(x) / period).otherwise(0.0) for x in ("up_", "down_")
    }
    d = W.scan(d, [key], "open_time", F.when(n > period + 1, 1 - 1 / period).otherwise(1.0), gains)
    rs = F.when(F.col("avgdown_") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("avgup_") / F.nullif("avgdown_", F.lit(0.0))))
    return d.select(key, "open_time", "close", F.when(n >= period + 1, F.bround(rs, 2)).alias("rsi"))


def wilder_rsi_latest(candles: DataFrame, period: int = 14, key: str = "symbol") -> DataFrame:
    """Each series' number of closes and latest RSI."""
    d = wilder_rsi(candles, period, key)
    return d.groupBy(key).agg(F.count("*").alias("n_closes"), F.max_by("rsi", "open_time").alias("rsi"))


def signal(rsi: Column, oversold: float = 30, overbought: float = 70) -> Column:
    return F.when(rsi.isNull(), "WAITING").when(rsi < oversold, "BUY").when(rsi > overbought, "SELL").otherwise("HOLD")
