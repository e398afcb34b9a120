"""Queries over labels, splits, trades and their metrics.

No model is needed for most of them: the signal is whether a candle closed above its open, and its
probability the share of such candles among the last 24 rows, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import candles as C
from tidemark.operators import features as X
from tidemark.operators import positions as P
from tidemark.plans.base import HOURLY, TICKS, W, candles_cte, full, lag, query, rounded
from tidemark.plans.market import hourly
from tidemark.sources.tables import table, ticks

UP, DOWN = 1.0, 0.5  # hourly prices here move by more than their level
SIDES = {"upper": UP, "lower": DOWN}


def signals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-23, 0)
    c, o = F.col("close"), F.col("open")
    g = hourly(spark, d).withColumn("pred", F.when(c > o, 1).when(c < o, -1).otherwise(0))
    g = g.withColumn("proba", F.avg((F.col("pred") == 1).cast("double")).over(w))
    return B.regimes(B.barrier_label(g, UP, DOWN))


def _label_sql(bars: int = 4) -> str:
    parts = " ".join(
        f"WHEN coalesce(lead(low, {k}) OVER ({W}) <= close * {1 - DOWN}, false) THEN -1 WHEN coalesce(lead(high, {k}) OVER ({W}) >= close * {1 + UP}, false) THEN 1" for k in range(1, bars + 1)
    )
    return f"CASE WHEN close IS NULL OR count(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {bars} FOLLOWING) = 0 THEN NULL {parts} ELSE 0 END"


SIG = f"""{HOURLY}, p AS (SELECT *, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS pred FROM grid),
q AS (SELECT *, avg(CAST(pred = 1 AS DOUBLE)) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS proba, {_label_sql()} AS tb_direction, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200 FROM p),
sig AS (SELECT *, CASE WHEN sma200 IS NULL THEN 'unknown' WHEN close > sma50 AND sma50 > sma200 THEN 'bull' WHEN close < sma50 AND sma50 < sma200 THEN 'bear' ELSE 'sideways' END AS regime FROM q)"""


def taken_cte(name: str = "t", threshold: str = "0.5", direction: str = "long", cost: str = "0.0013", src: str = "sig") -> str:
    side = 1 if direction == "long" else -1
    gain, loss = B.win_return(direction, UP, DOWN)
    return f"""{name} AS (SELECT *, tb_direction = {side} AS win, CASE WHEN tb_direction = {side} THEN {gain} ELSE {loss} END::DOUBLE - ({cost}) AS ret, '{direction}' AS direction
  FROM {src} WHERE tb_direction <> 0 AND pred = {side} AND proba >= {threshold})"""


def metrics_sql(keys: str, src: str = "t", ret: str = "ret", order: str = "open_time, symbol") -> str:
    """CTEs e, dd, m: the metrics of src by keys."""
    w = f"(PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""e AS (SELECT *, {ret} AS rr, sum(ln(1 + {ret})) OVER {w} AS log_equity FROM {src}), dd AS (SELECT *, exp(log_equity - max(log_equity) OVER {w}) - 1 AS drawdown FROM e),
m AS (SELECT {keys}, count(rr) AS n_trades, count(*) FILTER (rr > 0) AS n_wins, round(count(*) FILTER (rr > 0) / count(rr), 6) + 0.0 AS win_rate, round(avg(rr), 6) + 0.0 AS avg_ret, round(sum(rr), 6) + 0.0 AS total_ret,
  round(min(drawdown), 6) + 0.0 AS max_drawdown, round(sum(rr) FILTER (rr > 0) / nullif(sum(-rr) FILTER (rr < 0), 0), 6) + 0.0 AS profit_factor FROM dd GROUP BY {keys})"""


@query(f"{SIG} SELECT symbol, open_time, CAST(tb_direction AS INTEGER) AS tb_direction FROM sig")
def barrier_label(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("symbol", "open_time", "tb_direction")


@query(
    f"""{HOURLY}, hits AS (SELECT c.symbol, c.open_time, f.open_time AS t, f.low <= c.close * {1 - DOWN} AS stop FROM grid c JOIN grid f ON f.symbol = c.symbol AND f.open_time > c.open_time AND f.open_time <= c.open_time + 4 * 3600000
  AND (f.low <= c.close * {1 - DOWN} OR f.high >= c.close * {1 + UP})),
h AS (SELECT symbol, open_time, min(t) AS t, arg_min(CASE WHEN stop THEN -1 ELSE 1 END, t) AS dir FROM hits GROUP BY ALL) SELECT dir AS tb_direction, count(*) AS n, min(t - open_time) AS soonest_ms, max(t - open_time) AS latest_ms FROM h GROUP BY 1"""
)
def barrier_touches(spark: SparkSession, d: str) -> DataFrame:
    """First touches by a range join of bars on their series, the plain form of the label."""
    g = hourly(spark, d).select("symbol", "open_time", "close", "high", "low")
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.col("open_time") + k * C.HOUR_MS)).alias("t")
    ahead = g.filter("close is not null").select("symbol", "open_time", "close", at)  # four equal keys, not a range, so it can hash
    later = g.select("symbol", F.col("open_time").alias("t"), "high", "low")
    j = ahead.join(later, ["symbol", "t"]).withColumn("stop", F.col("low") <= F.col("close") * (1 - DOWN))
    j = j.filter(F.col("stop") | (F.col("high") >= F.col("close") * (1 + UP)))
    first = j.groupBy("symbol", "open_time").agg(F.min("t").alias("t"), F.min_by(F.when(F.col("stop"), -1).otherwise(1), "t").alias("tb_direction"))
    wait = F.col("t") - F.col("open_time")
    return first.groupBy("tb_direction").agg(F.count("*").alias("n"), F.min(wait).alias("soonest_ms"), F.max(wait).alias("latest_ms"))


FAR = 500


@query(
    f"""{HOURLY}, b AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS i, count(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {FAR} FOLLOWING) AS later FROM grid),
t AS (SELECT c.symbol, c.i, min(f.i) AS hit, arg_min(CASE WHEN f.low <= c.close * {1 - 10 * DOWN / 11} THEN -1 ELSE 1 END, f.i) AS side FROM b c JOIN b f ON f.symbol = c.symbol AND f.i > c.i AND f.i <= c.i + {FAR}
  AND (f.low <= c.close * {1 - 10 * DOWN / 11} OR f.high >= c.close * {1 + 10 * UP}) GROUP BY 1, 2)
SELECT symbol, open_time, hit - b.i AS touch_bars, CASE WHEN close IS NOT NULL AND later > 0 THEN CAST(coalesce(side, 0) AS INTEGER) END AS tb_direction FROM b LEFT JOIN t USING (symbol, i)"""
)
def barrier_far(spark: SparkSession, d: str) -> DataFrame:
    """Barriers so wide that days can pass before one is reached, found by a search that skips blocks of bars."""
    found = B.first_touch(hourly(spark, d), 10 * UP, 10 * DOWN / 11, FAR)
    return found.select("symbol", "open_time", "touch_bars", "tb_direction")


@query(f"{SIG} SELECT symbol, open_time, round(sma50, 6) + 0.0 AS sma50, round(sma200, 6) + 0.0 AS sma200, regime FROM sig")
def regime_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals(spark, d).select("symbol", "open_time", "sma50", "sma200", "regime"))


@query(
    f"""{SIG}, s AS (SELECT regime, count(*) AS n FROM sig GROUP BY 1) SELECT r.regime, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT count(*) FROM sig), 6) + 0.0 AS pct FROM (VALUES ('bull'), ('bear'), ('sideways'), ('unknown')) r(regime) LEFT JOIN s USING (regime)"""
)
def regime_distribution(spark: SparkSession, d: str) -> DataFrame:
    counts = signals(spark, d).groupBy("regime").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(x,) for x in ("bull", "bear", "sideways", "unknown")], "regime string")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # four rows
    d_ = every.join(counts, "regime", "left").select("regime", F.coalesce("n", F.lit(0)).alias("n"), (100 * F.coalesce("n", F.lit(0)) / total).alias("pct"))
    return rounded(d_)


@query(
    f"""{SIG}, {taken_cte()}, {metrics_sql('regime')}, n AS (SELECT regime, count(*) AS n_bars, count(*) FILTER (tb_direction <> 0) AS n_decisive, count(*) FILTER (pred = 1 AND proba >= 0.5) AS n_signals FROM sig GROUP BY 1) SELECT * FROM n LEFT JOIN m USING (regime)"""
)
def regime_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    n = s.groupBy("regime").agg(F.count("*").alias("n_bars"), F.count_if(F.col("tb_direction") != 0).alias("n_decisive"), F.count_if((F.col("pred") == 1) & (F.col("proba") >= 0.5)).alias("n_signals"))
    m = B.metrics(B.trades(s, 0.5, **SIDES), ["regime"], ["open_time", "symbol"])
    return rounded(n.join(m, "regime", "left"))


_MONTH = "strftime(make_timestamp(open_time * 1000), '%Y-%m')"


@query(
    f"""{SIG}, s2 AS (SELECT *, {_MONTH} AS month FROM sig), {taken_cte(cost='0.001', src='s2')}, {metrics_sql('symbol, month')}, n AS (SELECT symbol, month, count(*) FILTER (tb_direction <> 0) AS n_decisive FROM s2 GROUP BY ALL HAVING count(*) FILTER (tb_direction <> 0) >= 5) SELECT * FROM n LEFT JOIN m USING (symbol, month)"""
)
def monthly_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).withColumn("month", F.date_format(F.timestamp_millis("open_time"), "yyyy-MM"))
    n = s.groupBy("symbol", "month").agg(F.count_if(F.col("tb_direction") != 0).alias("n_decisive")).filter("n_decisive >= 5")
    m = B.metrics(B.trades(s, 0.5, slippage=0.0, **SIDES), ["symbol", "month"], ["open_time", "symbol"])
    return rounded(n.join(m, ["symbol", "month"], "left"))


_LEVELS = ", ".join(f"({t}::DOUBLE)" for t in B.THRESHOLDS)


@query(
    f"""{SIG}, th(threshold) AS (VALUES {_LEVELS}), s2 AS (SELECT * FROM sig CROSS JOIN th), {taken_cte(threshold='threshold', src='s2')}, {metrics_sql('threshold')},
f AS (SELECT th.threshold, coalesce(m.n_trades, 0) AS n FROM th LEFT JOIN m USING (threshold)) SELECT m.* FROM m WHERE threshold < coalesce((SELECT min(threshold) FROM f WHERE n < 5), 2)"""
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.threshold_sweep(signals(spark, d), **SIDES))


@query(
    f"""{SIG}, sl(slippage) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in B.SLIPPAGES)}), s2 AS (SELECT * FROM sig CROSS JOIN sl), {taken_cte(threshold='0.55', cost='0.001 + slippage', src='s2')}, {metrics_sql('slippage')}
SELECT *, (SELECT min(slippage) FROM m WHERE avg_ret <= 0) AS first_unprofitable FROM m"""
)
def slippage_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.slippage_sweep(signals(spark, d), **SIDES))


_K = B.kelly(0.60, UP / DOWN)


@query(
    f"""{SIG}, {taken_cte()}, z AS (SELECT t.*, s.sizing, coalesce(s.fixed, 0.25 + 0.75 * least(greatest((proba - 0.5) / 0.5, 0), 1)) AS fraction FROM t CROSS JOIN (VALUES ('flat', 1.0::DOUBLE), ('kelly', {_K}::DOUBLE), ('half_kelly', {_K / 2}::DOUBLE), ('meta_prob', NULL)) s(sizing, fixed)),
z2 AS (SELECT *, fraction * ret AS sret FROM z), {metrics_sql('sizing', 'z2', 'sret')}, a AS (SELECT sizing, round(avg(fraction), 6) + 0.0 AS avg_fraction FROM z GROUP BY 1) SELECT * FROM m JOIN a USING (sizing)"""
)
def kelly_sizing(spark: SparkSession, d: str) -> DataFrame:
    s = B.sized(B.trades(signals(spark, d), 0.5, **SIDES), 0.5, ratio=UP / DOWN)
    m = B.metrics(s, ["sizing"], ["open_time", "symbol"], ret="sized_ret")
    return rounded(m.join(s.groupBy("sizing").agg(F.avg("fraction").alias("avg_fraction")), "sizing"))


@query(f"{SIG}, {taken_cte()}, {metrics_sql('symbol')} SELECT symbol, open_time, round(ret, 6) + 0.0 AS ret, round(log_equity, 6) + 0.0 AS log_equity, round(drawdown, 6) + 0.0 AS drawdown FROM dd")
def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    e = B.equity(B.trades(signals(spark, d), 0.5, **SIDES), ["symbol"], ["open_time"])
    return rounded(e.select("symbol", "open_time", "ret", "log_equity", "drawdown"))


_BOTH = f"{taken_cte('tl', '0.45')}, {taken_cte('ts', '0.45', 'short')}, t AS (SELECT * FROM tl UNION ALL SELECT * FROM ts)"


def _both(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    long, short = (B.trades(s, 0.45, way, **SIDES).withColumn("direction", F.lit(way)) for way in ("long", "short"))
    return long.unionByName(short)


@query(f"{SIG}, {_BOTH} SELECT symbol, open_time, direction, win, round(ret, 6) + 0.0 AS ret FROM t ORDER BY open_time, symbol, direction")
def direction_union(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_both(spark, d).select("symbol", "open_time", "direction", "win", "ret")).orderBy("open_time", "symbol", "direction")


@query(f"{SIG}, {_BOTH} SELECT coalesce(regime, 'ALL') AS regime, coalesce(direction, 'ALL') AS direction, count(*) AS n_trades, count(*) FILTER (win) AS n_wins, round(sum(ret), 6) + 0.0 AS total_ret FROM t GROUP BY ROLLUP (regime, direction)")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    g = _both(spark, d).rollup("regime", "direction").agg(F.count("*").alias("n_trades"), F.count_if("win").alias("n_wins"), F.sum("ret").alias("total_ret"))
    return rounded(g.select(F.coalesce("regime", F.lit("ALL")).alias("regime"), F.coalesce("direction", F.lit("ALL")).alias("direction"), "n_trades", "n_wins", "total_ret"))


@query(
    f"""{SIG}, {_BOTH}, b AS (SELECT direction, avg(CAST(win AS DOUBLE)) AS win_rate FROM t GROUP BY 1) SELECT direction, round(win_rate, 6) + 0.0 AS win_rate, CASE direction WHEN 'long' THEN round({B.break_even('long', UP, DOWN)}, 6) ELSE round({B.break_even('short', UP, DOWN)}, 6) END::DOUBLE AS break_even FROM b"""
)
def break_even_rates(spark: SparkSession, d: str) -> DataFrame:
    g = _both(spark, d).groupBy("direction").agg(F.avg(F.col("win").cast("double")).alias("win_rate"))
    even = F.when(F.col("direction") == "long", B.break_even("long", UP, DOWN)).otherwise(B.break_even("short", UP, DOWN))
    return rounded(g.withColumn("break_even", even))


@query(
    f"""{HOURLY}, s AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM grid), x AS (SELECT symbol, open_time, CASE WHEN i <= n * 70 // 100 THEN 'train' WHEN i <= n * 80 // 100 THEN 'validation' ELSE 'test' END AS split FROM s)
SELECT symbol, split, count(*) AS n, min(open_time) AS first_time, max(open_time) AS last_time FROM x GROUP BY ALL"""
)
def time_split(spark: SparkSession, d: str) -> DataFrame:
    return B.time_split(hourly(spark, d)).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


@query(
    f"""{HOURLY}, n AS (SELECT symbol, count(*) AS n, count(*) // 6 AS b FROM grid GROUP BY 1), f AS (SELECT n.*, unnest(range(5)) AS fold FROM n WHERE b >= 100)
SELECT symbol, CAST(fold AS INTEGER) AS fold, b * (fold + 1) AS train_end, b * (fold + 1) AS test_start, CASE WHEN fold = 4 THEN n ELSE b * (fold + 2) END AS test_end FROM f"""
)
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    return B.fold_table(hourly(spark, d))


_UPS = f"u AS (SELECT symbol, open_time, pred, CAST(sign(lead(close, 4) OVER ({W}) / close - 1) AS INTEGER) AS dir FROM sig)"


@query(
    f"""{SIG}, {_UPS}, k AS (SELECT symbol, CAST(dir = 1 AS INTEGER) AS y, CAST(pred = 1 AS INTEGER) AS p, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM u WHERE dir <> 0),
m AS (SELECT symbol, CAST(avg(y) >= 0.5 AS INTEGER) AS major FROM k WHERE i <= n * 80 // 100 GROUP BY 1)
SELECT symbol, count(*) AS n_test, round(avg(CAST(y = major AS DOUBLE)), 6) + 0.0 AS majority_accuracy, round(avg(CAST(y = p AS DOUBLE)), 6) + 0.0 AS momentum_accuracy FROM k JOIN m USING (symbol) WHERE i > n * 80 // 100 GROUP BY 1"""
)
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.ml import baselines

    s = X.with_target(signals(spark, d)).filter("target_direction_4h <> 0")
    s = s.select("symbol", "open_time", (F.col("target_direction_4h") == 1).cast("int").alias("label"), (F.col("pred") == 1).cast("int").alias("momentum"))
    return rounded(baselines(B.time_split(s)))


@query(
    f"""{SIG}, {_UPS}, k AS (SELECT symbol, dir = 1 AS y, pred = 1 AS p FROM u WHERE dir <> 0), c AS (SELECT symbol, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM k GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1 FROM c"""
)
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    s = X.with_target(signals(spark, d)).filter("target_direction_4h <> 0")
    s = s.select("symbol", (F.col("target_direction_4h") == 1).cast("int").alias("y"), (F.col("pred") == 1).cast("int").alias("p"))
    return rounded(B.classification_metrics(s, "y", "p", "symbol"))


@query(
    f"""{HOURLY}, f AS (SELECT symbol, lead(close, 4) OVER ({W}) / close - 1 AS y, close / {lag('close')} - 1 AS p FROM grid), k AS (SELECT * FROM f WHERE y IS NOT NULL AND p IS NOT NULL),
g AS (SELECT symbol, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse, 1 - avg(pow(y - p, 2)) / nullif(var_pop(y), 0) AS r2, avg(CAST(sign(y) = sign(p) AS DOUBLE)) AS directional_accuracy FROM k GROUP BY 1)
SELECT symbol, n, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('mae', 'rmse', 'r2', 'directional_accuracy'))} FROM g"""
)
def regression_report(spark: SparkSession, d: str) -> DataFrame:
    f = X.with_target(X.with_returns(hourly(spark, d)))
    return rounded(B.regression_metrics(f, "target_return_4h", "return_1h", "symbol"), 4)


_ASKED = "asked AS (SELECT DISTINCT symbol, (t // 3600000 + 1) * 3600000 AS open_time FROM ticks WHERE quantity >= 3)"


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = ticks(spark, d)
    at = C.floor_ms(F.unix_millis("time"), C.HOUR_MS) + C.HOUR_MS
    return t.filter("quantity >= 3").select("symbol", at.alias("open_time")).distinct(), C.candles(t).select("symbol", "open_time")


@query(f"WITH {TICKS}, {candles_cte()}, {_ASKED} SELECT asked.* FROM asked SEMI JOIN candles USING (symbol, open_time)")
def semi_join_signals(spark: SparkSession, d: str) -> DataFrame:
    asked, prices = _asked(spark, d)
    return asked.join(prices, ["symbol", "open_time"], "left_semi")


@query(f"WITH {TICKS}, {candles_cte()}, {_ASKED} SELECT asked.* FROM asked ANTI JOIN candles USING (symbol, open_time)")
def anti_join_unmatched(spark: SparkSession, d: str) -> DataFrame:
    asked, prices = _asked(spark, d)
    return asked.join(prices, ["symbol", "open_time"], "left_anti")


@query(
    f"""WITH {TICKS} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, symbol, CASE WHEN quantity % 2 = 1 THEN 'SELL' ELSE 'BUY' END AS side, quantity, round(price, 2) AS price FROM ticks ORDER BY ts DESC, event_id DESC LIMIT 50"""
)
def trade_log_top50(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d).orderBy(F.desc("time"), F.desc("event_id")).limit(50)
    side = F.when(F.col("quantity") % 2 == 1, "SELL").otherwise("BUY")
    return t.select("event_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "symbol", side.alias("side"), "quantity", F.round("price", 2).alias("price"))


@query(
    f"""WITH {TICKS} SELECT count(*) AS n_trades, count(*) FILTER (quantity % 2 = 1) AS n_sells, count(*) FILTER (quantity % 2 = 0) AS n_buys, round(sum(CASE WHEN quantity % 2 = 1 THEN price * quantity END), 2) AS sold, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM ticks"""
)
def trade_log_totals(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quantity")
    return ticks(spark, d).agg(
        F.count("*").alias("n_trades"), F.count_if(q % 2 == 1).alias("n_sells"), F.count_if(q % 2 == 0).alias("n_buys"),
        F.round(F.sum(F.when(q % 2 == 1, F.col("price") * q)), 2).alias("sold"), F.unix_millis(F.min("time")).alias("first_ms"), F.unix_millis(F.max("time")).alias("last_ms"),
    )


@query(
    f"""{HOURLY}, s AS (SELECT symbol, open_time, close, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM grid)
SELECT symbol, open_time, close FROM s WHERE i % greatest(1, n // 50) = 0"""
)
def downsampled_curve(spark: SparkSession, d: str) -> DataFrame:
    return B.downsample(hourly(spark, d).select("symbol", "open_time", "close"))


_SLIP = f"CAST('0x' || md5('42:' || symbol || ':' || open_time)[1:8] AS BIGINT) / 4294967296.0 * {2 * B.SLIPPAGE!r}"


@query(f"{SIG}, {taken_cte(cost=f'0.001 + {_SLIP}')} SELECT symbol, open_time, win, round(ret, 8) + 0.0 AS ret FROM t")
def random_slippage_returns(spark: SparkSession, d: str) -> DataFrame:
    t = B.trades(signals(spark, d), 0.5, slippage=B.random_slippage("symbol", "open_time"), **SIDES)
    return rounded(t.select("symbol", "open_time", "win", "ret"), 8)


@query(
    """WITH r AS (SELECT r_name, n_name, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT coalesce(r_name, 'ALL') AS region, coalesce(n_name, 'ALL') AS nation, count(*) AS n_lines, CAST(sum(x) AS DOUBLE) AS revenue FROM r GROUP BY ROLLUP (r_name, n_name)"""
)
def dimension_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.select("r_name", "n_name", money.alias("x")).rollup("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.sum("x").cast("double").alias("revenue"))
    return g.select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "n_lines", "revenue")


_RSI = f"""WITH RECURSIVE {TICKS}, {candles_cte()}, s AS MATERIALIZED (SELECT symbol, open_time, close, row_number() OVER ({W}) AS rn, close - {lag('close')} AS x FROM candles),
f AS (SELECT symbol, avg(greatest(x, 0)) AS up, avg(greatest(-x, 0)) AS down FROM s WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14),
w AS (SELECT symbol, CAST(15 AS BIGINT) AS rn, up, down FROM f UNION ALL SELECT s.symbol, s.rn, (w.up * 13 + greatest(s.x, 0)) / 14, (w.down * 13 + greatest(-s.x, 0)) / 14 FROM w JOIN s ON s.symbol = w.symbol AND s.rn = w.rn + 1),
st AS MATERIALIZED (SELECT s.symbol, s.rn, s.open_time, s.close, round_even(CASE WHEN w.down = 0 THEN 100.0 ELSE 100 - 100 / (1 + w.up / nullif(w.down, 0)) END, 2) AS rsi FROM s LEFT JOIN w ON w.symbol = s.symbol AND w.rn = s.rn)"""


@query(
    f"""{_RSI}, z AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, NULL::DOUBLE AS held, NULL::DOUBLE AS kept, CAST(-1 AS BIGINT) AS day, 0 AS buys, false AS risk, NULL::DOUBLE AS moved, false AS buy, false AS sell FROM st
  UNION ALL SELECT symbol, rn, held, CASE WHEN buy THEN close WHEN sell THEN NULL ELSE e END, day, b + CAST(buy AS INTEGER), risk, moved, buy, sell FROM (
  SELECT *, coalesce(rsi < 45 AND e IS NULL AND b < 5, false) AS buy, coalesce(rsi > 55 AND e IS NOT NULL AND NOT coalesce(rsi < 45 AND e IS NULL AND b < 5, false), false) AS sell FROM (
  SELECT st.symbol, st.rn, st.close, st.rsi, z.kept AS held, st.open_time // 86400000 AS day, CASE WHEN z.day = st.open_time // 86400000 THEN z.buys ELSE 0 END AS b, (st.close - z.kept) / z.kept AS moved,
  coalesce((st.close - z.kept) / z.kept <= -0.02 OR (st.close - z.kept) / z.kept >= 0.03, false) AS risk,
  CASE WHEN coalesce((st.close - z.kept) / z.kept <= -0.02 OR (st.close - z.kept) / z.kept >= 0.03, false) THEN NULL ELSE z.kept END AS e FROM z JOIN st ON st.symbol = z.symbol AND st.rn = z.rn + 1)))
SELECT z.symbol, st.open_time, 'SELL' AS side, CAST(0.001 AS DOUBLE) AS quantity, st.close AS price, NULL::DOUBLE AS rsi, round((st.close - held) * 0.001, 3) + 0.0 AS pnl, CASE WHEN moved <= -0.02 THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS reason FROM z JOIN st USING (symbol, rn) WHERE risk
UNION ALL SELECT z.symbol, st.open_time, 'BUY', CAST(0.001 AS DOUBLE), st.close, st.rsi, 0.0, 'RSI_SIGNAL' FROM z JOIN st USING (symbol, rn) WHERE buy
UNION ALL SELECT z.symbol, st.open_time, 'SELL', CAST(0.001 AS DOUBLE), st.close, st.rsi, round((st.close - held) * 0.001, 3) + 0.0, 'RSI_SIGNAL' FROM z JOIN st USING (symbol, rn) WHERE sell"""
)
def risk_fold(spark: SparkSession, d: str) -> DataFrame:
    log = P.risk_fold(X.wilder_rsi(C.candles(ticks(spark, d))), 45, 55)
    return log.withColumn("pnl", F.round("pnl", 3) + 0.0)


_COST = "(1 - 0.0003) * (1 - 0.001 / 2) / ({paid} * (1 + 0.0003) * (1 + 0.001 / 2)) - 1"


@query(
    f"""{SIG}, n AS MATERIALIZED (SELECT symbol, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS last, close, high, low, coalesce(pred = 1 AND proba >= 0.5, false) AND close IS NOT NULL AS entry FROM sig),
z AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, NULL::DOUBLE AS paid, CAST(0 AS BIGINT) AS age, NULL::DOUBLE AS got, NULL::DOUBLE AS was, CAST(0 AS BIGINT) AS bars FROM n
  UNION ALL SELECT symbol, i, CASE WHEN (p IS NULL OR got IS NOT NULL) AND entry AND i < last THEN close WHEN got IS NULL THEN p END, CASE WHEN p IS NOT NULL AND got IS NULL THEN age ELSE 0 END, got, p, age FROM (
  SELECT n.*, z.paid AS p, z.age + 1 AS age, CASE WHEN z.paid IS NULL THEN NULL WHEN n.low <= z.paid * {1 - DOWN} THEN z.paid * {1 - DOWN} WHEN n.high >= z.paid * {1 + UP} THEN z.paid * {1 + UP}
    WHEN z.age + 1 >= {B.MAX_BARS} OR n.i = n.last THEN coalesce(n.close, z.paid) END AS got FROM z JOIN n ON n.symbol = z.symbol AND n.i = z.i + 1)),
r AS (SELECT symbol, i, got, bars, CASE WHEN got IS NULL THEN 0.0 ELSE got * {_COST.format(paid='was')} END AS ret FROM z WHERE i > 0),
c AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY i) AS lc FROM r), c2 AS (SELECT *, exp(lc - max(lc) OVER (PARTITION BY symbol ORDER BY i)) - 1 AS fall FROM c),
a AS (SELECT symbol, count(got) AS n_trades, count(*) FILTER (got IS NOT NULL AND ret > 0) AS n_wins, exp(sum(ln(1 + ret))) - 1 AS total, min(fall) AS fall, avg(ret) AS mean, stddev_samp(ret) AS sd, sqrt(avg(pow(least(ret, 0), 2))) AS down,
  avg(bars) FILTER (got IS NOT NULL) AS avg_bars, max(ret) FILTER (got IS NOT NULL) AS best, min(ret) FILTER (got IS NOT NULL) AS worst FROM c2 GROUP BY 1)
SELECT symbol, n_trades, n_wins, round(n_wins / nullif(n_trades, 0), 6) + 0.0 AS win_rate, round(total, 6) + 0.0 AS total_return, round(fall, 6) + 0.0 AS max_drawdown, round(mean / nullif(sd, 0) * sqrt(8760), 6) + 0.0 AS sharpe,
  round(mean / nullif(down, 0) * sqrt(8760), 6) + 0.0 AS sortino, round(total / nullif(-fall, 0), 6) + 0.0 AS calmar, round(avg_bars, 6) + 0.0 AS avg_bars, round(best, 6) + 0.0 AS best, round(worst, 6) + 0.0 AS worst FROM a"""
)
def portfolio_sim(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).withColumn("entry", (F.col("pred") == 1) & (F.col("proba") >= 0.5))
    return rounded(P.portfolio(s, UP, DOWN, B.MAX_BARS))

