"""Queries over ticks, candles, features and order flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import candles as C
from tidemark.operators import features as X
from tidemark.operators import joins as J
from tidemark.plans.base import HOURLY, TICKS, W, candles_cte, ewm_cte, full, lag, query, r, rounded, z
from tidemark.sources import files, scratch, sinks
from tidemark.sources.snapshots import SnapshotTable
from tidemark.sources.tables import agg_trades, table, ticks


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's hourly candles on its complete grid."""
    return C.on_grid(C.candles(ticks(spark, d)))


def tick_trades(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as aggregated trades: odd quantities were bought from a resting buyer."""
    return ticks(spark, d).select(
        "symbol", "price", "quantity", (F.col("quantity") % 2 == 1).alias("is_buyer_maker"), F.unix_millis("time").alias("time_ms")
    )


def funding(spark: SparkSession, d: str) -> DataFrame:
    """Funding is settled by the ticks of the smallest quantity."""
    t = ticks(spark, d).filter("quantity = 1")
    return t.select("symbol", "event_id", F.unix_millis("time").alias("funding_time"), ((F.col("price") - 10) / 10_000).alias("funding_rate"))


def liquidations(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("quantity") % 3 == 0, "buy").when(F.col("quantity") % 3 == 1, "SELL").otherwise("other")
    return ticks(spark, d).select("symbol", side.alias("side"), F.col("price").alias("quantity"), F.unix_millis("time").alias("time_ms"))


@query(f"WITH {TICKS} SELECT upper(symbol) AS symbol, price, quantity, t AS trade_time FROM ticks")
def tick_parse(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    data = F.struct(F.col("price").cast("string").alias("p"), F.col("quantity").cast("string").alias("q"), F.unix_millis("time").alias("T"))
    sent = t.select(F.to_json(F.struct(F.concat("symbol", F.lit("@trade")).alias("stream"), data.alias("data"))).alias("value"))
    return files.parse_envelopes(sent)


#: A block of time in as-of joins: a series of years is as many tasks as it has months.
MONTH_MS = 30 * 86_400_000
CANDLE = "open_time, open, high, low, close, volume, trade_count"


@query(f"WITH {TICKS}, {candles_cte(keys='')} SELECT {CANDLE} FROM candles")
def candles_1h(spark: SparkSession, d: str) -> DataFrame:
    return C.candles(ticks(spark, d), keys=())


@query(f"WITH {TICKS}, {candles_cte()} SELECT symbol, {CANDLE} FROM candles")
def candles_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return C.candles(ticks(spark, d))


@query(f"WITH {TICKS}, {candles_cte(300_000)} SELECT symbol, {CANDLE} FROM candles")
def candles_5m(spark: SparkSession, d: str) -> DataFrame:
    return C.candles(ticks(spark, d), 5 * C.MINUTE_MS)


@query(f"{HOURLY} SELECT symbol, {CANDLE}, is_real FROM grid")
def hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d)


@query(
    f"""{HOURLY}, s AS (SELECT symbol, open_time - {lag('open_time')} AS step FROM candles)
SELECT symbol, count(*) AS n_rows, count(*) FILTER (step <> 3600000) AS n_gaps, CAST(coalesce(sum(step // 3600000 - 1), 0) AS BIGINT) AS missing_steps,
  max(step) AS largest_step_ms FROM s GROUP BY 1"""
)
def grid_gap_report(spark: SparkSession, d: str) -> DataFrame:
    return C.gap_report(C.candles(ticks(spark, d)))


def _spoilt(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("trade_count")
    return C.candles(ticks(spark, d)).withColumns(
        {"high": F.when(n == 4, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(n == 5, -F.col("volume")).otherwise(F.col("volume")),
         "low": F.when(n == 6, F.lit(0.0)).otherwise(F.col("low"))}
    )


_SPOILT = f"""WITH {TICKS}, {candles_cte()}, s AS (SELECT symbol, open_time, open, close, trade_count, CASE WHEN trade_count = 4 THEN low - 1 ELSE high END AS high,
  CASE WHEN trade_count = 6 THEN 0.0 ELSE low END AS low, CASE WHEN trade_count = 5 THEN -volume ELSE volume END AS volume FROM candles),
v AS (SELECT *, high < greatest(open, close, low) AS bh, low > least(open, close, high) AS bl, least(open, high, low, close) <= 0 AS np, volume < 0 AS nv FROM s)"""


@query(
    f"""{_SPOILT} SELECT count(*) FILTER (bh) AS bad_high, count(*) FILTER (bl) AS bad_low, count(*) FILTER (np) AS nonpositive_price,
  count(*) FILTER (nv) AS negative_volume, count(*) FILTER (bh OR bl OR np OR nv) AS rows_quarantined FROM v"""
)
def ohlc_sanity(spark: SparkSession, d: str) -> DataFrame:
    return C.sanity_report(_spoilt(spark, d))


@query(
    f"""{_SPOILT} SELECT symbol, open_time, bh OR bl OR np OR nv AS is_bad, trade_count,
  {', '.join(f'CASE WHEN NOT (bh OR bl OR np OR nv) THEN {c} END AS {c}' for c in C.OHLCV)} FROM v"""
)
def ohlc_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return C.quarantined(_spoilt(spark, d))


_RETURNS = ", ".join(f"close / nullif({lag('close', n)}, 0) - 1 AS return_{n}h, ln(close / {lag('close', n)}) AS log_return_{n}h" for n in (1, 4, 24))


@query(f"{HOURLY}, f AS (SELECT symbol, open_time, {_RETURNS} FROM grid) SELECT symbol, open_time, {r(*(f'{p}_{n}h' for n in (1, 4, 24) for p in ('return', 'log_return')))} FROM f")
def returns_lag(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{p}_{n}h" for n in (1, 4, 24) for p in ("return", "log_return")]
    return rounded(X.with_returns(hourly(spark, d)).select("symbol", "open_time", *names))


_TARGET = f"f AS (SELECT *, lead(close, 4) OVER ({W}) / nullif(close, 0) - 1 AS target_return_4h FROM grid)"


@query(f"{HOURLY}, {_TARGET} SELECT symbol, open_time, {r('target_return_4h')}, CAST(sign(target_return_4h) AS INTEGER) AS target_direction_4h FROM f")
def forward_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_target(hourly(spark, d)).select("symbol", "open_time", "target_return_4h", "target_direction_4h"))


@query(
    f"""{HOURLY}, {_TARGET}, p AS (SELECT f.symbol, f.target_return_4h AS a, g.close / nullif(f.close, 0) - 1 AS b FROM f
  LEFT JOIN candles g ON g.symbol = f.symbol AND g.open_time = f.open_time + 14400000)
SELECT symbol, count(*) AS n_rows, count(a) AS n_targets, count(b) AS n_by_key, count(*) FILTER (abs(a - b) > 1e-9 OR (a IS NULL) <> (b IS NULL)) AS n_wrong FROM p GROUP BY 1"""
)
def target_selfjoin_proof(spark: SparkSession, d: str) -> DataFrame:
    t = X.with_target(hourly(spark, d))
    p = J.at_offset(t, ["symbol"], "open_time", "close", 4 * C.HOUR_MS, "later")
    p = p.select("symbol", F.col("target_return_4h").alias("a"), (windows.ratio("later", "close") - 1).alias("b"))
    wrong = (F.abs(F.col("a") - F.col("b")) > 1e-9) | (F.col("a").isNull() != F.col("b").isNull())
    return p.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count("a").alias("n_targets"), F.count("b").alias("n_by_key"), F.count_if(wrong).alias("n_wrong"))


_LOG = f"l AS (SELECT *, ln(close / {lag('close')}) AS lr FROM grid)"


@query(
    f"""{HOURLY}, {_LOG}, f AS (SELECT symbol, open_time, {full('stddev_samp', 'lr', 24)} AS volatility_24h, {full('stddev_samp', 'lr', 168)} AS volatility_7d FROM l),
g AS (SELECT *, volatility_24h / nullif(volatility_7d, 0) AS vol_ratio FROM f) SELECT symbol, open_time, {r('volatility_24h', 'volatility_7d', 'vol_ratio')} FROM g"""
)
def rolling_vol(spark: SparkSession, d: str) -> DataFrame:
    f = X.with_volatility(X.with_returns(hourly(spark, d)))
    return rounded(f.select("symbol", "open_time", "volatility_24h", "volatility_7d", "vol_ratio"))


@query(
    f"""{HOURLY}, f AS (SELECT symbol, open_time, {full('avg', 'volume', 24)} AS vol_sma_24, {z('volume', 24)} AS vol_zscore, volume / nullif({full('avg', 'volume', 24)}, 0) AS vol_ratio_24h FROM grid)
SELECT symbol, open_time, {r('vol_sma_24', 'vol_zscore', 'vol_ratio_24h')} FROM f"""
)
def volume_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_volume(hourly(spark, d)).select("symbol", "open_time", "vol_sma_24", "vol_zscore", "vol_ratio_24h"))


@query(
    f"""{HOURLY}, f AS (SELECT symbol, open_time, close, {full('avg', 'close', 20)} AS bb_mid, {full('stddev_samp', 'close', 20)} AS sd FROM grid),
g AS (SELECT symbol, open_time, bb_mid, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower, 4 * sd / nullif(bb_mid, 0) AS bb_width,
  (close - (bb_mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_pct_b FROM f) SELECT symbol, open_time, {r('bb_mid', 'bb_upper', 'bb_lower', 'bb_width', 'bb_pct_b')} FROM g"""
)
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    f = X.with_bollinger(hourly(spark, d))
    return rounded(f.select("symbol", "open_time", "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct_b"))


_NUMBERED = f"n AS (SELECT *, row_number() OVER ({W}) AS rn FROM grid)"


@query(
    f"""{HOURLY}, {', '.join(ewm_cte('grid', 'close', 2 / (n + 1), f'e{n}') for n in X.SPANS)}, {_NUMBERED},
f AS (SELECT n.symbol, n.open_time, n.close, {', '.join(f'e{n}.y AS ema_{n}' for n in X.SPANS)} FROM n {' '.join(f'JOIN e{n} ON e{n}.symbol = n.symbol AND e{n}.rn = n.rn' for n in X.SPANS)})
SELECT symbol, open_time, {r(*(f'ema_{n}' for n in X.SPANS))}, CAST(coalesce(ema_8 > ema_21, false) AS INTEGER) AS ema_8_21_cross,
  round((close - ema_50) / nullif(ema_50, 0), 6) + 0.0 AS price_vs_ema_50, round((close - ema_200) / nullif(ema_200, 0), 6) + 0.0 AS price_vs_ema_200 FROM f"""
)
def ema_family(spark: SparkSession, d: str) -> DataFrame:
    f = X.with_ema_flags(X.with_ema(hourly(spark, d)))
    return rounded(f.select("symbol", "open_time", *(f"ema_{n}" for n in X.SPANS), "ema_8_21_cross", "price_vs_ema_50", "price_vs_ema_200"))


@query(
    f"""{HOURLY}, {ewm_cte('grid', 'close', 2 / 13, 'fast')}, {ewm_cte('grid', 'close', 2 / 27, 'slow')},
m AS (SELECT n.symbol, n.open_time, f.y - s.y AS macd FROM (SELECT symbol, open_time, row_number() OVER ({W}) AS rn FROM grid) n
  JOIN fast f ON f.symbol = n.symbol AND f.rn = n.rn JOIN slow s ON s.symbol = n.symbol AND s.rn = n.rn), {ewm_cte('m', 'macd', 2 / 10, 'sig')},
g AS (SELECT n.symbol, n.open_time, macd, sig.y AS macd_signal FROM (SELECT *, row_number() OVER ({W}) AS rn FROM m) n JOIN sig ON sig.symbol = n.symbol AND sig.rn = n.rn),
h AS (SELECT *, macd - macd_signal AS macd_hist, {lag('macd')} AS pm, {lag('macd_signal')} AS ps FROM g)
SELECT symbol, open_time, {r('macd', 'macd_signal', 'macd_hist')}, CASE WHEN abs(macd_hist) > 1e-9 AND macd > macd_signal AND pm <= ps THEN 1 WHEN abs(macd_hist) > 1e-9 AND macd < macd_signal AND pm >= ps THEN -1 ELSE 0 END AS macd_cross FROM h"""
)
def macd_cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_macd(hourly(spark, d)).select("symbol", "open_time", "macd", "macd_signal", "macd_hist", "macd_cross"))


@query(
    f"""{HOURLY}, s AS (SELECT symbol, open_time, close - {lag('close')} AS x FROM grid), u AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS up, CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END AS down FROM s),
{', '.join(ewm_cte('u', c, 1 / n, f'{c}{n}', True) for n in (7, 14) for c in ('up', 'down'))}, {_NUMBERED}
SELECT n.symbol, n.open_time, {', '.join(f'round(CASE WHEN up{n}.nobs >= {n} THEN 100 - 100 / (1 + up{n}.y / nullif(down{n}.y, 0)) END, 6) + 0.0 AS rsi_{n}' for n in (7, 14))}
FROM n {' '.join(f'JOIN {c}{n} ON {c}{n}.symbol = n.symbol AND {c}{n}.rn = n.rn' for n in (7, 14) for c in ('up', 'down'))}"""
)
def rsi_ml(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_rsi(X.with_rsi(hourly(spark, d), 7), 14).select("symbol", "open_time", "rsi_7", "rsi_14"))


_FIVE = f"WITH RECURSIVE {TICKS}, {candles_cte()}"


@query(
    f"""{_FIVE}, s AS MATERIALIZED (SELECT symbol, row_number() OVER ({W}) AS rn, close - {lag('close')} AS x FROM candles),
f AS (SELECT symbol, avg(greatest(x, 0)) AS up, avg(greatest(-x, 0)) AS down FROM s WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
w AS (SELECT symbol, CAST(15 AS BIGINT) AS rn, up, down FROM f UNION ALL SELECT s.symbol, s.rn, (w.up * 13 + greatest(s.x, 0)) / 14, (w.down * 13 + greatest(-s.x, 0)) / 14 FROM w JOIN s ON s.symbol = w.symbol AND s.rn = w.rn + 1)
SELECT n.symbol, n.n_closes, round(CASE WHEN w.down = 0 THEN 100.0 ELSE 100 - 100 / (1 + w.up / nullif(w.down, 0)) END, 2) AS rsi,
  CASE WHEN w.rn IS NULL THEN 'WAITING' WHEN w.down > 0 AND 100 - 100 / (1 + w.up / w.down) < 30 THEN 'BUY' WHEN w.down = 0 OR 100 - 100 / (1 + w.up / w.down) > 70 THEN 'SELL' ELSE 'HOLD' END AS signal
FROM (SELECT symbol, count(*) AS n_closes FROM candles GROUP BY 1) n LEFT JOIN w ON w.symbol = n.symbol AND w.rn = n.n_closes"""
)
def rsi_wilder_latest(spark: SparkSession, d: str) -> DataFrame:
    return X.wilder_rsi_latest(C.candles(ticks(spark, d))).withColumn("signal", X.signal(F.col("rsi")))


@query(
    f"""{HOURLY}, s AS (SELECT *, {lag('close')} AS p FROM grid), t AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS true_range FROM s),
{ewm_cte('t', 'true_range', 1 / 14, 'e', True)} SELECT n.symbol, n.open_time, {r('true_range')}, round(CASE WHEN nobs >= 14 THEN y END, 6) + 0.0 AS atr_14,
  round(CASE WHEN nobs >= 14 THEN y END / nullif(close, 0), 6) + 0.0 AS atr_ratio FROM (SELECT *, row_number() OVER ({W}) AS rn FROM t) n JOIN e ON e.symbol = n.symbol AND e.rn = n.rn"""
)
def atr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_atr(hourly(spark, d)).select("symbol", "open_time", "true_range", "atr_14", "atr_ratio"))


_TIME = ["hour_of_day", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos", *X.SESSIONS]


@query(
    f"""{HOURLY}, f AS (SELECT symbol, open_time, hour(make_timestamp(open_time * 1000)) AS h, isodow(make_timestamp(open_time * 1000)) - 1 AS w FROM grid)
SELECT symbol, open_time, CAST(h AS INTEGER) AS hour_of_day, CAST(w AS INTEGER) AS day_of_week, CAST(w >= 5 AS INTEGER) AS is_weekend, round(sin(h * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(h * 2 * pi() / 24), 6) + 0.0 AS hour_cos,
  round(sin(w * 2 * pi() / 7), 6) + 0.0 AS dow_sin, round(cos(w * 2 * pi() / 7), 6) + 0.0 AS dow_cos, {', '.join(f'CAST(h >= {a} AND h < {b} AS INTEGER) AS {k}' for k, (a, b) in X.SESSIONS.items())} FROM f"""
)
def session_time_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_time(hourly(spark, d)).select("symbol", "open_time", *_TIME))


@query(
    f"""{HOURLY}, f AS (SELECT symbol, open_time, abs(close - open) / nullif(open, 0) AS candle_body, (high - greatest(open, close)) / nullif(open, 0) AS upper_wick,
  (least(open, close) - low) / nullif(open, 0) AS lower_wick, CAST(coalesce(close > open, false) AS INTEGER) AS is_bullish FROM grid) SELECT symbol, open_time, {r('candle_body', 'upper_wick', 'lower_wick')}, is_bullish FROM f"""
)
def candle_shape(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.with_candle_shape(hourly(spark, d)).select("symbol", "open_time", "candle_body", "upper_wick", "lower_wick", "is_bullish"))


def _flow_cte(width: int = 3_600_000) -> str:
    return f"""flow AS (SELECT symbol, t // {width} * {width} AS open_time, sum(CASE WHEN quantity % 2 = 1 THEN 0 ELSE quantity END) AS buy_vol, sum(CASE WHEN quantity % 2 = 1 THEN quantity ELSE 0 END) AS sell_vol,
  sum(quantity) AS total_vol FROM ticks GROUP BY ALL)"""


_FUND = "fund AS (SELECT symbol, event_id, t AS funding_time, (price - 10) / 10000 AS funding_rate FROM ticks WHERE quantity = 1)"
_LIQ = """liq AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, sum(CASE WHEN quantity % 3 = 0 THEN price ELSE 0 END) AS liq_buy_vol, sum(CASE WHEN quantity % 3 = 0 THEN 0 ELSE price END) AS liq_sell_vol, count(*) AS liq_count FROM ticks GROUP BY ALL)"""


@query(
    f"""{HOURLY}, {_flow_cte()}, {_LIQ}, {_FUND}, a AS (SELECT c.symbol, c.open_time, c.close, f.funding_rate FROM candles c ASOF LEFT JOIN fund f ON f.symbol = c.symbol AND f.funding_time <= c.open_time)
SELECT a.symbol, a.open_time, a.close, coalesce(buy_vol - sell_vol, 0) AS delta, coalesce(total_vol, 0) AS total_vol, round(coalesce(liq_buy_vol - liq_sell_vol, 0), 6) + 0.0 AS liq_net_vol, coalesce(liq_count, 0) AS liq_count, round(coalesce(funding_rate, 0), 8) + 0.0 AS funding_rate
FROM a LEFT JOIN flow USING (symbol, open_time) LEFT JOIN liq USING (symbol, open_time)"""
)
def features_view_join(spark: SparkSession, d: str) -> DataFrame:
    k = C.candles(ticks(spark, d)).select("symbol", "open_time", "close")
    flow = C.order_flow(tick_trades(spark, d), C.HOUR_MS).select("symbol", "open_time", "delta", "total_vol")
    liq = C.liquidation_buckets(liquidations(spark, d), keys=("symbol",)).select("symbol", "open_time", "liq_net_vol", "liq_count")
    k = J.asof_join(k, funding(spark, d), ["symbol"], "open_time", "funding_time", ["funding_rate"], "event_id", block=MONTH_MS)
    j = X.joined(k, [flow, liq], ["symbol", "open_time"])
    zero = lambda c, n: (F.round(F.coalesce(c, F.lit(0.0)), n) + 0.0).alias(c)
    return j.select("symbol", "open_time", "close", zero("delta", 6), zero("total_vol", 6), zero("liq_net_vol", 6), F.coalesce("liq_count", F.lit(0)).alias("liq_count"), zero("funding_rate", 8))


@query(
    f"""WITH {TICKS}, s AS (SELECT user_id, ts, price AS last_price FROM ticks WHERE symbol = 'signup') SELECT l.event_id, l.user_id, l.price, s.last_price, epoch_us(s.ts) // 1000 AS asof_signup_ms
FROM (SELECT * FROM ticks WHERE symbol <> 'signup') l ASOF LEFT JOIN s ON s.user_id = l.user_id AND s.ts <= l.ts"""
)
def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    slow = t.filter("symbol = 'signup'").select("user_id", "event_id", F.col("time").alias("signup"), F.col("price").alias("last_price"))
    fast = t.filter("symbol <> 'signup'").select("event_id", "user_id", "price", "time")
    found = J.asof_join(fast, slow, ["user_id"], "time", "signup", ["last_price"], "event_id", block=MONTH_MS * 1000)
    return found.select("event_id", "user_id", "price", "last_price", F.unix_millis("asof_signup").alias("asof_signup_ms"))


@query(
    f"""{HOURLY}, {_FUND}, h AS (SELECT symbol, funding_time // 3600000 * 3600000 AS open_time, arg_min(funding_rate, {{'a': funding_time, 'b': event_id}}) AS x FROM fund GROUP BY ALL),
j AS (SELECT g.symbol, g.open_time, x FROM grid g LEFT JOIN h USING (symbol, open_time)) SELECT symbol, open_time, round(last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS funding_rate FROM j"""
)
def equi_ffill(spark: SparkSession, d: str) -> DataFrame:
    f = funding(spark, d).withColumn("open_time", C.floor_ms(F.col("funding_time"), C.HOUR_MS))
    f = f.groupBy("symbol", "open_time").agg(F.min_by("funding_rate", F.struct("funding_time", "event_id")).alias("funding_rate"))
    g = hourly(spark, d).select("symbol", "open_time")
    return rounded(J.equi_ffill(g, f, ["symbol", "open_time"], ["symbol"], "open_time", ["funding_rate"]), 8)


_TRADES = "trades AS (SELECT l_linestatus AS symbol, l_extendedprice / l_quantity AS price, l_quantity AS q, l_returnflag = 'R' AS m, epoch_ms(l_shipdate) AS open_time FROM lineitem)"


@query(
    f"""WITH {_TRADES} SELECT symbol, open_time, sum(CASE WHEN NOT m THEN q ELSE 0 END) AS buy_vol, sum(CASE WHEN m THEN q ELSE 0 END) AS sell_vol, sum(q) AS total_vol, sum(CASE WHEN m THEN -q ELSE q END) AS delta,
  count(*) FILTER (NOT m) AS buy_trade_count, count(*) FILTER (m) AS sell_trade_count, count(*) FILTER (q >= 25) AS large_trade_count, sum(CASE WHEN q >= 25 THEN q ELSE 0 END) AS large_trade_vol FROM trades GROUP BY ALL"""
)
def order_flow_buckets(spark: SparkSession, d: str) -> DataFrame:
    return C.order_flow(agg_trades(spark, d), large=25.0)


_PROFILE = f"WITH {_TRADES}, p AS (SELECT symbol, open_time, round(round_even(price / 50.0, 0) * 50.0, 2) AS level, sum(q) AS vol, sum(CASE WHEN NOT m THEN q ELSE 0 END) AS buy, sum(CASE WHEN m THEN q ELSE 0 END) AS sell FROM trades GROUP BY ALL)"


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return C.volume_profile(agg_trades(spark, d), tick=50.0)


@query(f"{_PROFILE} SELECT * FROM p")
def volume_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


@query(f"{_PROFILE} SELECT symbol, open_time, arg_max(level, {{'a': vol, 'b': -level}}) AS poc_price, max(vol) AS poc_vol FROM p GROUP BY ALL")
def poc(spark: SparkSession, d: str) -> DataFrame:
    return C.point_of_control(_profile(spark, d))


@query(
    f"""{_PROFILE.replace('WITH', 'WITH RECURSIVE', 1)}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, open_time ORDER BY level) AS i, sum(vol) OVER (PARTITION BY symbol, open_time) AS tot FROM p),
s AS (SELECT symbol, open_time, arg_max(i, {{'a': vol, 'b': -level}}) AS lo, max(vol) AS acc, max(tot) AS tot FROM n GROUP BY ALL),
e AS (SELECT symbol, open_time, lo, lo AS hi, acc, tot FROM s UNION ALL SELECT e.symbol, e.open_time, CASE WHEN coalesce(u.vol, -1) >= coalesce(w.vol, -1) THEN e.lo ELSE e.lo - 1 END, CASE WHEN coalesce(u.vol, -1) >= coalesce(w.vol, -1) THEN e.hi + 1 ELSE e.hi END,
  e.acc + greatest(coalesce(u.vol, -1), coalesce(w.vol, -1)), e.tot FROM e LEFT JOIN n u ON u.symbol = e.symbol AND u.open_time = e.open_time AND u.i = e.hi + 1 LEFT JOIN n w ON w.symbol = e.symbol AND w.open_time = e.open_time AND w.i = e.lo - 1
  WHERE e.acc < e.tot * 0.70 AND (u.vol IS NOT NULL OR w.vol IS NOT NULL)),
f AS (SELECT symbol, open_time, min(lo) AS lo, max(hi) AS hi, arg_min(lo, hi - lo) AS poc FROM e GROUP BY ALL)
SELECT f.symbol, f.open_time, c.level AS poc_price, b.level AS vah, a.level AS val FROM f JOIN n a ON a.symbol = f.symbol AND a.open_time = f.open_time AND a.i = f.lo
JOIN n b ON b.symbol = f.symbol AND b.open_time = f.open_time AND b.i = f.hi JOIN n c ON c.symbol = f.symbol AND c.open_time = f.open_time AND c.i = f.poc"""
)
def value_area(spark: SparkSession, d: str) -> DataFrame:
    return C.value_area(_profile(spark, d))


@query(f"{_PROFILE} SELECT symbol, open_time, round(coalesce(max(abs(buy - sell) / nullif(buy + sell, 0)), 0), 6) + 0.0 AS max_imbalance FROM p GROUP BY ALL")
def max_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.max_imbalance(_profile(spark, d)))


@query(
    f"""WITH {TICKS}, {_flow_cte()} SELECT symbol, open_time, buy_vol - sell_vol AS delta, sum(buy_vol - sell_vol) OVER (PARTITION BY symbol, open_time // 86400000 ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS cvd FROM flow"""
)
def cvd_daily_reset(spark: SparkSession, d: str) -> DataFrame:
    return C.daily_cvd(C.order_flow(tick_trades(spark, d), C.HOUR_MS)).select("symbol", "open_time", "delta", "cvd")


@query(
    f"""{HOURLY}, {_flow_cte()}, v AS (SELECT symbol, open_time, sum(buy_vol - sell_vol) OVER (PARTITION BY symbol, open_time // 86400000 ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS cvd, total_vol FROM flow),
j AS (SELECT g.symbol, g.open_time, g.close, v.cvd, v.total_vol FROM grid g LEFT JOIN v USING (symbol, open_time))
SELECT symbol, open_time, CAST(coalesce(sign(cvd - {lag('cvd', 4)}) <> sign(close - {lag('close', 4)}), true) AS INTEGER) AS cvd_divergence, round(cvd / nullif({full('sum', 'total_vol', 24)}, 0), 6) + 0.0 AS cvd_norm FROM j"""
)
def cvd_divergence(spark: SparkSession, d: str) -> DataFrame:
    flow = C.daily_cvd(C.order_flow(tick_trades(spark, d), C.HOUR_MS)).select("symbol", "open_time", "cvd", "total_vol")
    j = X.joined(hourly(spark, d).select("symbol", "open_time", "close"), [flow], ["symbol", "open_time"])
    w = windows.series("symbol")
    return rounded(j.select("symbol", "open_time", X.divergence("cvd", "close", w).alias("cvd_divergence"), windows.ratio("cvd", windows.total("total_vol", w, 24)).alias("cvd_norm")))


@query(f"WITH {TICKS}, {_LIQ} SELECT symbol, open_time, {r('liq_buy_vol', 'liq_sell_vol')}, round(liq_buy_vol - liq_sell_vol, 6) + 0.0 AS liq_net_vol, liq_count FROM liq")
def liq_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.liquidation_buckets(liquidations(spark, d), keys=("symbol",)))


#: Open interest: the users' ids of an hour, summed. Its change is from the hour before that has any.
_OPEN = f"oi AS (SELECT symbol, open_time, oi, oi - {lag('oi')} AS ch FROM (SELECT symbol, t // 3600000 * 3600000 AS open_time, CAST(sum(user_id) AS DOUBLE) AS oi FROM ticks GROUP BY ALL))"
_OI = f"{_OPEN}, o AS (SELECT g.symbol, g.open_time, g.close, oi, coalesce(ch, 0) AS oi_delta, ln(close / {lag('close').replace('symbol', 'g.symbol').replace('open_time', 'g.open_time')}) AS lr FROM grid g LEFT JOIN oi USING (symbol, open_time))"


def open_interest(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d).groupBy("symbol", C.floor_ms(F.unix_millis("time"), C.HOUR_MS).alias("open_time"))
    return X.open_interest_changes(t.agg(F.sum("user_id").cast("double").alias("sum_open_interest")))


def _with_oi(spark: SparkSession, d: str) -> DataFrame:
    return X.with_open_interest(X.joined(hourly(spark, d), [open_interest(spark, d)], ["symbol", "open_time"]))


@query(
    f"""{HOURLY}, {_OI}, q AS (SELECT *, {z('oi_delta', 24)} AS zz FROM o), p AS (SELECT symbol, open_time, CAST(coalesce(zz < -1.5 AND lr < -0.01, false) AS INTEGER) AS liq_long_proxy, CAST(coalesce(zz < -1.5 AND lr > 0.01, false) AS INTEGER) AS liq_short_proxy,
  CAST(coalesce(zz < -2 AND abs(lr) > 0.015, false) AS INTEGER) AS cascade_flag FROM q)
SELECT *, liq_short_proxy - liq_long_proxy AS liq_direction, CAST({full('sum', 'cascade_flag', 4)} AS BIGINT) AS cascade_4h, CAST({full('sum', 'cascade_flag', 24)} AS BIGINT) AS cascade_24h FROM p"""
)
def cascade_flags(spark: SparkSession, d: str) -> DataFrame:
    f = X.with_liquidation_proxies(X.with_returns(_with_oi(spark, d)))
    return f.select("symbol", "open_time", "liq_long_proxy", "liq_short_proxy", "cascade_flag", "liq_direction", "cascade_4h", "cascade_24h")


@query(
    f"""{HOURLY}, {_OI}, q AS (SELECT symbol, open_time, oi_delta, {z('oi', 24)} AS oi_zscore, oi_delta / nullif(oi, 0) AS oi_delta_norm,
  CAST(coalesce(sign({full('sum', 'oi_delta', 4)}) <> sign(close - {lag('close', 4)}), true) AS INTEGER) AS oi_price_divergence FROM o) SELECT symbol, open_time, {r('oi_delta', 'oi_zscore', 'oi_delta_norm')}, oi_price_divergence FROM q"""
)
def oi_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_with_oi(spark, d).select("symbol", "open_time", "oi_delta", "oi_zscore", "oi_delta_norm", "oi_price_divergence"))


@query(
    f"""{HOURLY}, {_LIQ}, j AS (SELECT g.symbol, g.open_time, coalesce(liq_buy_vol, 0) + coalesce(liq_sell_vol, 0) AS liq_total, coalesce(liq_buy_vol - liq_sell_vol, 0) AS net FROM grid g LEFT JOIN liq USING (symbol, open_time))
SELECT symbol, open_time, {r('liq_total')}, CAST(coalesce({z('liq_total', 24)} > 2, false) AS INTEGER) AS liq_spike, CAST(sign(net) AS INTEGER) AS liq_net_sign FROM j"""
)
def liq_spikes(spark: SparkSession, d: str) -> DataFrame:
    liq = C.liquidation_buckets(liquidations(spark, d), keys=("symbol",))
    j = X.joined(hourly(spark, d).select("symbol", "open_time"), [liq], ["symbol", "open_time"])
    return rounded(X.with_liquidations(j).select("symbol", "open_time", "liq_total", "liq_spike", "liq_net_sign"))


@query(
    f"""{HOURLY}, {_FUND}, h AS (SELECT symbol, funding_time // 3600000 * 3600000 AS open_time, arg_min(funding_rate, {{'a': funding_time, 'b': event_id}}) AS x FROM fund GROUP BY ALL),
j AS (SELECT g.symbol, g.open_time, coalesce(x, 0) AS f FROM grid g LEFT JOIN h USING (symbol, open_time))
SELECT symbol, open_time, round(f, 10) + 0.0 AS funding_rate, CAST(f > 0.0008 AS INTEGER) AS funding_extreme_long, CAST(f < -0.0002 AS INTEGER) AS funding_extreme_short, round(f - {lag('f', 8)}, 10) + 0.0 AS funding_8h_change, round({full('avg', 'f', 24)}, 10) + 0.0 AS funding_24h_mean FROM j"""
)
def funding_features(spark: SparkSession, d: str) -> DataFrame:
    f = funding(spark, d).withColumn("open_time", C.floor_ms(F.col("funding_time"), C.HOUR_MS))
    f = f.groupBy("symbol", "open_time").agg(F.min_by("funding_rate", F.struct("funding_time", "event_id")).alias("funding_rate"))
    j = X.joined(hourly(spark, d).select("symbol", "open_time"), [f], ["symbol", "open_time"])
    return rounded(X.with_funding(j), 10)


@query(
    f"""WITH {TICKS}, i AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, min(event_id) AS event_id FROM ticks GROUP BY ALL), x AS (SELECT DISTINCT symbol, t // 3600000 * 3600000 AS open_time FROM ticks WHERE quantity <= 2)
SELECT i.symbol, i.open_time, i.event_id FROM i ANTI JOIN x ON x.symbol = i.symbol AND x.open_time = i.open_time"""
)
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d).select("symbol", C.floor_ms(F.unix_millis("time"), C.HOUR_MS).alias("open_time"), "event_id", "quantity")
    there = t.filter("quantity <= 2").select("symbol", "open_time").distinct()
    return sinks.new_rows(t.drop("quantity"), there, ["symbol", "open_time"], ["event_id"])


_HOUR = "t // 3600000 * 3600000 AS open_time"


@query(
    f"""WITH {TICKS}, x AS (SELECT symbol, {_HOUR}, max(event_id) AS event_id FROM ticks WHERE quantity <= 2 GROUP BY ALL), i AS (SELECT symbol, {_HOUR}, min(event_id) AS event_id FROM ticks GROUP BY ALL)
SELECT symbol, open_time, event_id FROM x UNION ALL SELECT i.symbol, i.open_time, i.event_id FROM i ANTI JOIN x ON x.symbol = i.symbol AND x.open_time = i.open_time"""
)
def snapshot_append(spark: SparkSession, d: str) -> DataFrame:
    """A table with snapshots into which rows were inserted whose keys it had in part: the first write of a key stays."""
    t = ticks(spark, d).select("symbol", C.floor_ms(F.unix_millis("time"), C.HOUR_MS).alias("open_time"), "event_id", "quantity")
    stored = SnapshotTable(spark, scratch.path(spark, "snapshots"), ["open_time", "symbol"])
    stored.insert_or_ignore(t.filter("quantity <= 2").groupBy("symbol", "open_time").agg(F.max("event_id").alias("event_id")), ["event_id"])
    stored.insert_or_ignore(t.drop("quantity"), ["event_id"])
    return stored.read()


@query("SELECT vec_id, CASE WHEN label = 3 THEN 30 ELSE label END AS label FROM embeddings")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table of vectors by id, in buckets, after an upsert of those with one label."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    stored = SnapshotTable(spark, scratch.path(spark, "snapshots"), ["vec_id"], buckets=8)
    stored.insert_or_ignore(v, ["label"])
    stored.upsert(v.filter("label = 3").withColumn("label", F.lit(30)), ["label"])
    return stored.read().select("vec_id", "label")


def klines(spark: SparkSession, d: str) -> DataFrame:
    """Candles by symbol with the share that takers bought."""
    t = ticks(spark, d)
    bought = F.sum(F.when(F.col("quantity") % 2 == 1, 0.0).otherwise(F.col("quantity")))
    share = t.groupBy("symbol", C.floor_ms(F.unix_millis("time"), C.HOUR_MS).alias("open_time")).agg((bought / F.sum("quantity")).alias("taker_buy_ratio"))
    return C.candles(t).join(share, ["symbol", "open_time"])


def footprint(spark: SparkSession, d: str) -> DataFrame:
    """Order flow, cumulative delta, value area and imbalance of each symbol's hours."""
    t, on = tick_trades(spark, d), ["symbol", "open_time"]
    profile = C.volume_profile(t, C.HOUR_MS, 1.0)
    flow = C.daily_cvd(C.order_flow(t, C.HOUR_MS, large=3.0))
    return X.joined(flow, [C.value_area(profile), C.max_imbalance(profile)], on)


_EWMS = ", ".join(
    [
        *(ewm_cte("grid", "close", 2 / (n + 1), f"e{n}") for n in (*X.SPANS, 12, 26)),
        *(ewm_cte("ud", c, 1 / n, f"{c}{n}", True) for n in (7, 14) for c in ("up", "down")),
        ewm_cte("ud", "tr", 1 / 14, "tr14", True),
        f"mc AS (SELECT u.symbol, u.open_time, e12.y - e26.y AS macd FROM ud u JOIN e12 ON e12.symbol = u.symbol AND e12.rn = u.rn JOIN e26 ON e26.symbol = u.symbol AND e26.rn = u.rn)",
        ewm_cte("mc", "macd", 2 / 10, "e9"),
    ]
)
_SIDES = f"""fl AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, sum(CASE WHEN quantity % 2 = 1 THEN 0 ELSE quantity END) AS buy_vol, sum(CASE WHEN quantity % 2 = 1 THEN quantity ELSE 0 END) AS sell_vol, sum(quantity) AS total_vol,
  count(*) FILTER (quantity % 2 <> 1) AS buy_trade_count, count(*) FILTER (quantity % 2 = 1) AS sell_trade_count, count(*) FILTER (quantity >= 3) AS large_trade_count, sum(CASE WHEN quantity >= 3 THEN quantity ELSE 0 END) AS large_trade_vol FROM ticks GROUP BY ALL),
pf AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, round(round_even(price / 1.0, 0) * 1.0, 2) AS level, sum(quantity) AS vol, sum(CASE WHEN quantity % 2 <> 1 THEN quantity ELSE 0 END) AS buy, sum(CASE WHEN quantity % 2 = 1 THEN quantity ELSE 0 END) AS sell FROM ticks GROUP BY ALL),
pn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, open_time ORDER BY level) AS i, sum(vol) OVER (PARTITION BY symbol, open_time) AS tot FROM pf),
ps AS (SELECT symbol, open_time, arg_max(i, {{'a': vol, 'b': -level}}) AS lo, max(vol) AS acc, max(tot) AS tot FROM pn GROUP BY ALL),
pe AS (SELECT symbol, open_time, lo, lo AS hi, acc, tot FROM ps UNION ALL SELECT e.symbol, e.open_time, CASE WHEN coalesce(u.vol, -1) >= coalesce(w.vol, -1) THEN e.lo ELSE e.lo - 1 END, CASE WHEN coalesce(u.vol, -1) >= coalesce(w.vol, -1) THEN e.hi + 1 ELSE e.hi END,
  e.acc + greatest(coalesce(u.vol, -1), coalesce(w.vol, -1)), e.tot FROM pe e LEFT JOIN pn u ON u.symbol = e.symbol AND u.open_time = e.open_time AND u.i = e.hi + 1 LEFT JOIN pn w ON w.symbol = e.symbol AND w.open_time = e.open_time AND w.i = e.lo - 1
  WHERE e.acc < e.tot * 0.70 AND (u.vol IS NOT NULL OR w.vol IS NOT NULL)),
pa AS (SELECT symbol, open_time, min(lo) AS lo, max(hi) AS hi, arg_min(lo, hi - lo) AS poc FROM pe GROUP BY ALL),
va AS (SELECT f.symbol, f.open_time, c.level AS poc_price, b.level AS vah, a.level AS val FROM pa f JOIN pn a ON a.symbol = f.symbol AND a.open_time = f.open_time AND a.i = f.lo
  JOIN pn b ON b.symbol = f.symbol AND b.open_time = f.open_time AND b.i = f.hi JOIN pn c ON c.symbol = f.symbol AND c.open_time = f.open_time AND c.i = f.poc),
im AS (SELECT symbol, open_time, coalesce(max(abs(buy - sell) / nullif(buy + sell, 0)), 0) AS max_imbalance FROM pf GROUP BY ALL),
fp AS (SELECT fl.*, buy_vol - sell_vol AS delta, sum(buy_vol - sell_vol) OVER (PARTITION BY symbol, open_time // 86400000 ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS cvd, poc_price, vah, val, max_imbalance FROM fl JOIN va USING (symbol, open_time) JOIN im USING (symbol, open_time)),
fh AS (SELECT symbol, funding_time // 3600000 * 3600000 AS open_time, arg_min(funding_rate, {{'a': funding_time, 'b': event_id}}) AS x FROM fund GROUP BY ALL)"""
_PLAIN = {  # columns that are taken or derived without a recursion, over the joined rows
    "hour_of_day": "CAST(hour(make_timestamp(open_time * 1000)) AS INTEGER)", "day_of_week": "CAST(isodow(make_timestamp(open_time * 1000)) - 1 AS INTEGER)",
    "is_weekend": "CAST(isodow(make_timestamp(open_time * 1000)) >= 6 AS INTEGER)",
    **{f"{k}_{f}": f"{f}({x} * 2 * pi() / {n})" for k, x, n in (("hour", "hour(make_timestamp(open_time * 1000))", 24), ("dow", "(isodow(make_timestamp(open_time * 1000)) - 1)", 7)) for f in ("sin", "cos")},
    **{k: f"CAST(hour(make_timestamp(open_time * 1000)) >= {a} AND hour(make_timestamp(open_time * 1000)) < {b} AS INTEGER)" for k, (a, b) in X.SESSIONS.items()},
    **{f"log_return_{n}h": f"ln(close / {lag('close', n)})" for n in (1, 4, 24)}, **{f"return_{n}h": f"close / nullif({lag('close', n)}, 0) - 1" for n in (1, 4, 24)},
    "candle_body": "abs(close - open) / nullif(open, 0)", "upper_wick": "(high - greatest(open, close)) / nullif(open, 0)", "lower_wick": "(least(open, close) - low) / nullif(open, 0)",
    "is_bullish": "CAST(coalesce(close > open, false) AS INTEGER)", "vol_sma_24": full("avg", "volume", 24), "vol_zscore": z("volume", 24), "vol_ratio_24h": f"volume / nullif({full('avg', 'volume', 24)}, 0)",
    "bb_upper": f"{full('avg', 'close', 20)} + 2 * {full('stddev_samp', 'close', 20)}", "bb_lower": f"{full('avg', 'close', 20)} - 2 * {full('stddev_samp', 'close', 20)}",
    "bb_width": f"4 * {full('stddev_samp', 'close', 20)} / nullif({full('avg', 'close', 20)}, 0)", "bb_pct_b": f"(close - ({full('avg', 'close', 20)} - 2 * {full('stddev_samp', 'close', 20)})) / nullif(4 * {full('stddev_samp', 'close', 20)}, 0)",
    "delta_norm": "delta / nullif(total_vol, 0)", "poc_distance": "(close - poc_price) / nullif(close, 0)", "va_range": "(vah - val) / nullif(close, 0)", "large_trade_ratio": "large_trade_vol / nullif(total_vol, 0)",
    "buy_sell_cnt_ratio": "buy_trade_count / nullif(buy_trade_count + sell_trade_count, 0)", "cvd_divergence": f"CAST(coalesce(sign(cvd - {lag('cvd', 4)}) <> sign(close - {lag('close', 4)}), true) AS INTEGER)",
    "cvd_norm": f"cvd / nullif({full('sum', 'total_vol', 24)}, 0)", "funding_extreme_long": "CAST(funding_rate > 0.0008 AS INTEGER)", "funding_extreme_short": "CAST(funding_rate < -0.0002 AS INTEGER)",
    "funding_8h_change": f"funding_rate - {lag('funding_rate', 8)}", "funding_24h_mean": full("avg", "funding_rate", 24), "oi_zscore": z("sum_open_interest", 24), "oi_delta_norm": "oi_delta / nullif(sum_open_interest, 0)",
    "oi_price_divergence": f"CAST(coalesce(sign({full('sum', 'oi_delta', 4)}) <> sign(close - {lag('close', 4)}), true) AS INTEGER)",
    "target_return_4h": f"lead(close, 4) OVER ({W}) / nullif(close, 0) - 1", "target_direction_4h": f"CAST(sign(lead(close, 4) OVER ({W}) / nullif(close, 0) - 1) AS INTEGER)",
}
_LATER = {  # columns over those
    "volatility_24h": full("stddev_samp", "log_return_1h", 24), "volatility_7d": full("stddev_samp", "log_return_1h", 168), "vol_ratio": f"({full('stddev_samp', 'log_return_1h', 24)}) / nullif({full('stddev_samp', 'log_return_1h', 168)}, 0)",
    "liq_long_proxy": f"CAST(coalesce({z('oi_delta', 24)} < -1.5 AND log_return_1h < -0.01, false) AS INTEGER)", "liq_short_proxy": f"CAST(coalesce({z('oi_delta', 24)} < -1.5 AND log_return_1h > 0.01, false) AS INTEGER)",
    "cascade_flag": f"CAST(coalesce({z('oi_delta', 24)} < -2 AND abs(log_return_1h) > 0.015, false) AS INTEGER)",
    "macd_hist": "macd - macd_signal", "macd_cross": f"CASE WHEN macd > macd_signal AND {lag('macd')} <= {lag('macd_signal')} THEN 1 WHEN macd < macd_signal AND {lag('macd')} >= {lag('macd_signal')} THEN -1 ELSE 0 END",
    "atr_ratio": "atr_14 / nullif(close, 0)", "ema_8_21_cross": "CAST(coalesce(ema_8 > ema_21, false) AS INTEGER)", **{f"price_vs_ema_{n}": f"(close - ema_{n}) / nullif(ema_{n}, 0)" for n in (50, 200)},
}
_GIVEN = (
    "open high low close volume trade_count taker_buy_ratio buy_vol sell_vol total_vol delta cvd buy_trade_count sell_trade_count large_trade_count large_trade_vol poc_price vah val max_imbalance "
    "sum_open_interest oi_delta liq_buy_vol liq_sell_vol liq_net_vol liq_count funding_rate"
).split()
_STEADY = [f"ema_{n}" for n in X.SPANS] + ["rsi_7", "rsi_14", "atr_14", "macd", "macd_signal"]
_WHOLE = {"trade_count", "buy_trade_count", "sell_trade_count", "large_trade_count", "liq_count"}
_EVERY = [*_GIVEN, *_PLAIN, *_STEADY, *_LATER, "liq_direction", "cascade_4h", "cascade_24h"]


def _digits(c: str) -> int:
    return 10 if c.startswith("funding") else 6


_FEATURE_SQL = f"""{HOURLY}, {_FUND}, {_LIQ}, {_OPEN}, {_SIDES},
tk AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, sum(CASE WHEN quantity % 2 = 1 THEN 0 ELSE quantity END) / sum(quantity) AS tb FROM ticks GROUP BY ALL),
ud AS (SELECT symbol, open_time, rn, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS up, CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END AS down, tr FROM (SELECT symbol, open_time, row_number() OVER ({W}) AS rn, close - {lag('close')} AS x,
  greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM grid)),
{_EWMS},
jn AS (SELECT g.symbol, g.open_time, g.is_real, open, high, low, close, volume, trade_count, coalesce(tb, 0.5) AS taker_buy_ratio, fp.* EXCLUDE (symbol, open_time), oi AS sum_open_interest, coalesce(ch, 0) AS oi_delta, liq_buy_vol, liq_sell_vol, liq_buy_vol - liq_sell_vol AS liq_net_vol, liq_count,
  coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.open_time ROWS UNBOUNDED PRECEDING), 0) AS funding_rate
  FROM grid g LEFT JOIN tk USING (symbol, open_time) LEFT JOIN fp USING (symbol, open_time) LEFT JOIN oi USING (symbol, open_time) LEFT JOIN liq USING (symbol, open_time) LEFT JOIN fh USING (symbol, open_time)),
k1 AS (SELECT *, row_number() OVER ({W}) AS rn, {', '.join(f'{x} AS {c}' for c, x in _PLAIN.items())} FROM jn),
k2 AS (SELECT k1.*, {', '.join(f'e{n}.y AS ema_{n}' for n in X.SPANS)}, {', '.join(f'CASE WHEN up{n}.nobs >= {n} THEN 100 - 100 / (1 + up{n}.y / nullif(down{n}.y, 0)) END AS rsi_{n}' for n in (7, 14))},
  CASE WHEN tr14.nobs >= 14 THEN tr14.y END AS atr_14, e12.y - e26.y AS macd, e9.y AS macd_signal FROM k1 {' '.join(f'JOIN {t} ON {t}.symbol = k1.symbol AND {t}.rn = k1.rn' for t in (*(f'e{n}' for n in X.SPANS), 'up7', 'down7', 'up14', 'down14', 'tr14', 'e12', 'e26', 'e9'))}),
k3 AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _LATER.items())} FROM k2),
k4 AS (SELECT *, liq_short_proxy - liq_long_proxy AS liq_direction, CAST({full('sum', 'cascade_flag', 4)} AS BIGINT) AS cascade_4h, CAST({full('sum', 'cascade_flag', 24)} AS BIGINT) AS cascade_24h FROM k3)"""


@query(
    f"""{_FEATURE_SQL} SELECT symbol, open_time, {', '.join(c if c in _WHOLE or 'CAST(' in {**_PLAIN, **_LATER}.get(c, '') or c in ('macd_cross', 'liq_direction', 'cascade_4h', 'cascade_24h') else f'round({c}, {_digits(c)}) + 0.0 AS {c}' for c in _EVERY)}
FROM k4 WHERE rn > 200 AND is_real"""
)
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """All families joined: candles, order flow, open interest, liquidations, funding, and the targets."""
    f = funding(spark, d).withColumn("open_time", C.floor_ms(F.col("funding_time"), C.HOUR_MS))
    f = f.groupBy("symbol", "open_time").agg(F.min_by("funding_rate", F.struct("funding_time", "event_id")).alias("funding_rate"))
    liq = C.liquidation_buckets(liquidations(spark, d), keys=("symbol",))
    t = X.feature_table(klines(spark, d), footprint(spark, d), open_interest(spark, d), liq, f)
    return t.select("symbol", "open_time", *((F.round(c, _digits(c)) + 0.0).alias(c) if dict(t.dtypes)[c] == "double" else c for c in _EVERY))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Candles on a grid, with returns, rolling volatility and the forward target."""
    return rounded(X.with_target(X.with_volatility(X.with_returns(hourly(spark, d)))))
