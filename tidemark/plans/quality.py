"""Queries over column statistics, cleaning and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import cleaning as K
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.operators import stats as S
from tidemark.plans.base import HOURLY, TICKS, W, candles_cte, full, lag, query, rounded, z
from tidemark.plans.market import hourly
from tidemark.sources import scratch
from tidemark.sources.tables import table, ticks

COLUMNS = ["return_1h", "return_4h", "return_24h", "volatility_24h", "vol_zscore", "candle_body", "volume"]
#: Rows up to here are training rows.
TRAIN_UNTIL = 1_705_881_600_000


def frame(spark: SparkSession, d: str) -> DataFrame:
    """A few features and the target on the hourly grid."""
    f = X.with_volume(X.with_volatility(X.with_returns(X.with_candle_shape(hourly(spark, d)))))
    return X.with_target(f).select("symbol", "open_time", "is_real", "close", *COLUMNS, "is_bullish", "target_return_4h", "target_direction_4h")


FEAT = f"""{HOURLY}, lr AS (SELECT *, ln(close / {lag('close')}) AS lr FROM grid),
feat AS (SELECT symbol, open_time, is_real, close, {', '.join(f'close / nullif({lag("close", n)}, 0) - 1 AS return_{n}h' for n in (1, 4, 24))}, {full('stddev_samp', 'lr', 24)} AS volatility_24h,
  {z('volume', 24)} AS vol_zscore, abs(close - open) / nullif(open, 0) AS candle_body, volume, CAST(coalesce(close > open, false) AS INTEGER) AS is_bullish,
  lead(close, 4) OVER ({W}) / nullif(close, 0) - 1 AS target_return_4h, CAST(sign(lead(close, 4) OVER ({W}) / nullif(close, 0) - 1) AS INTEGER) AS target_direction_4h FROM lr)"""
MELT = "melt AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, symbol, open_time, CAST({c} AS DOUBLE) AS x, target_return_4h AS y FROM feat" for c in COLUMNS) + ")"


@query(
    f"""{FEAT}, {MELT}, s AS (SELECT feature, count(*) - count(x) AS n_null, (count(*) - count(x)) / count(*) AS null_share FROM melt GROUP BY 1)
SELECT feature, n_null, round(null_share, 6) + 0.0 AS null_share, CASE WHEN null_share = 0 THEN 'none' WHEN null_share <= 0.1 THEN 'low' WHEN null_share <= 0.5 THEN 'medium' ELSE 'high' END AS level FROM s"""
)
def null_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.null_share(frame(spark, d), COLUMNS))


@query(
    f"""{FEAT}, {MELT}, m AS (SELECT feature, avg(x) AS mu, stddev_pop(x) AS sp, stddev_samp(x) AS sd FROM melt GROUP BY 1),
s AS (SELECT feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99, max(x) AS max, avg(pow((x - mu) / sp, 3)) AS skew, avg(pow((x - mu) / sp, 4)) - 3 AS kurtosis,
  count(*) FILTER (abs(x - mu) > 5 * sd) AS n_outliers FROM melt JOIN m USING (feature) GROUP BY 1 HAVING count(x) >= 100)
SELECT feature, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('mean', 'std', 'min', 'p1', 'p99', 'max'))}, round(skew, 3) + 0.0 AS skew, round(kurtosis, 3) + 0.0 AS kurtosis, n_outliers FROM s"""
)
def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    f = rounded(S.distribution(frame(spark, d), COLUMNS))
    return f.withColumns({c: F.round(c, 3) + 0.0 for c in ("skew", "kurtosis")})


@query(
    f"""{FEAT}, h AS (SELECT {' + '.join(f'CAST(target_return_4h >= {e} AS INTEGER)' for e in S.EDGES)} AS bin FROM feat WHERE target_return_4h IS NOT NULL)
SELECT CAST(b.bin AS INTEGER) AS bin, count(h.bin) AS n FROM range({len(S.EDGES) + 1}) b(bin) LEFT JOIN h ON h.bin = b.bin GROUP BY 1"""
)
def target_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(frame(spark, d), "target_return_4h")


@query(
    f"""{FEAT}, s AS (SELECT symbol, count(*) FILTER (target_direction_4h = 1) AS n_up, count(*) FILTER (target_direction_4h = -1) AS n_down FROM feat GROUP BY 1)
SELECT symbol, n_up, n_down, round(abs(n_up - n_down) / nullif(n_up + n_down, 0), 6) + 0.0 AS imbalance, round(n_down / nullif(n_up, 0), 6) + 0.0 AS up_weight FROM s"""
)
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.class_balance(frame(spark, d), "target_direction_4h", "symbol"))


@query(
    """WITH o AS (SELECT year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS p, o_totalprice AS v FROM orders),
m AS (SELECT p, avg(v) AS mean FROM o GROUP BY 1 HAVING count(*) > 10), s AS (SELECT count(*) AS n_periods, stddev_pop(mean) / (SELECT stddev_samp(v) FROM o) AS drift FROM m)
SELECT 'o_totalprice' AS feature, n_periods, round(drift, 6) + 0.0 AS drift, drift > 0.3 AS drifts FROM s"""
)
def half_year_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.drift(table(spark, d, "orders"), ["o_totalprice"], S.half_year(F.col("o_orderdate"))))


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


@query(
    f"""{FEAT}, p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM feat WHERE open_time <= {TRAIN_UNTIL}" for a, b in _PAIRS)}) SELECT a, b, round(c, 6) + 0.0 AS corr FROM p"""
)
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.correlation_pairs(frame(spark, d).filter(F.col("open_time") <= TRAIN_UNTIL), COLUMNS))


_RHO = f"""{FEAT}, {MELT}, k AS (SELECT feature, x, y FROM melt WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT feature, x, y, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM k),
rho AS (SELECT feature, count(*) AS n, corr(x, y) AS pearson, corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS spearman FROM rk GROUP BY 1 HAVING count(*) >= 100)"""


@query(f"{_RHO} SELECT feature, n, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman FROM rho")
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.target_correlations(frame(spark, d), COLUMNS, "target_return_4h").drop("p_value"))


#: Student's two-sided p by the continued fraction of the incomplete beta function.
_P = f"""{_RHO}, pv AS (SELECT *, CAST((n - 2) / 2.0 AS DOUBLE) AS a, CAST(0.5 AS DOUBLE) AS b, 1 - spearman * spearman AS x FROM rho),
ch AS (SELECT *, x < (a + 1) / (a + b + 2) AS direct, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) AS front FROM pv),
ar AS (SELECT feature, CASE WHEN direct THEN a ELSE b END AS p, CASE WHEN direct THEN b ELSE a END AS q, CASE WHEN direct THEN x ELSE 1 - x END AS z FROM ch),
it AS (SELECT feature, p, q, z, 0 AS k, CAST(1 AS DOUBLE) AS c, 1 / (1 - (p + q) * z / (p + 1)) AS d, 1 / (1 - (p + q) * z / (p + 1)) AS h FROM ar
  UNION ALL SELECT feature, p, q, z, k, c2, d2, h * c1 * d1 * c2 * d2 FROM (SELECT *, 1 / (1 + n2 * d1) AS d2, 1 + n2 / c1 AS c2 FROM (
  SELECT feature, p, q, z, k + 1 AS k, h, 1 / (1 + (k + 1) * (q - k - 1) * z / ((p + 2 * k + 1) * (p + 2 * k + 2)) * d) AS d1, 1 + (k + 1) * (q - k - 1) * z / ((p + 2 * k + 1) * (p + 2 * k + 2)) / c AS c1,
    -(p + k + 1) * (p + q + k + 1) * z / ((p + 2 * k + 2) * (p + 2 * k + 3)) AS n2 FROM it WHERE k < 200)))"""


@query(
    f"{_P} SELECT feature, n, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman, round(CASE WHEN direct THEN front * h / p ELSE 1 - front * h / p END, 6) + 0.0 AS p_value FROM ch JOIN it USING (feature) WHERE k = 200"
)
def spearman_p_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.target_correlations(frame(spark, d), COLUMNS, "target_return_4h"))


GROUPS = {"momentum": ["return"], "risk": ["volatility", "body"], "activity": ["vol"]}


@query(
    f"""{_RHO}, g AS ({' UNION ALL '.join(f"SELECT '{g}' AS grp, feature, abs(spearman) AS a FROM rho WHERE regexp_matches(feature, '{'|'.join(w)}')" for g, w in GROUPS.items())})
SELECT grp AS "group", count(*) AS n_features, round(avg(a), 6) + 0.0 AS mean_abs_rho, arg_max(feature, {{'a': a, 'b': feature}}) AS best_feature FROM g GROUP BY 1"""
)
def corr_group_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.group_summary(S.target_correlations(frame(spark, d), COLUMNS, "target_return_4h"), GROUPS))


_FIT = f"""{FEAT}, {MELT}, fit AS (SELECT feature, quantile_cont(x, 0.5) AS train_median, CASE WHEN count(x) >= 50 AND quantile_cont(x, 0.99) > quantile_cont(x, 0.01) THEN quantile_cont(x, 0.01) END AS clip_lo,
  CASE WHEN count(x) >= 50 AND quantile_cont(x, 0.99) > quantile_cont(x, 0.01) THEN quantile_cont(x, 0.99) END AS clip_hi FROM melt WHERE open_time <= {TRAIN_UNTIL} GROUP BY 1)"""


def _fit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = scratch.stored(frame(spark, d), "rows")  # fitted on and then cleaned
    return f, K.fit(f.filter(F.col("open_time") <= TRAIN_UNTIL), COLUMNS)


@query(f"{_FIT} SELECT feature, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('train_median', 'clip_lo', 'clip_hi'))} FROM fit")
def winsor_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fit(spark, d)[1])


def _clip_sql(c: str) -> str:
    lo, hi = (f"(SELECT {x} FROM fit WHERE feature = '{c}')" for x in ("clip_lo", "clip_hi"))
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {lo} IS NULL THEN {c} ELSE least(greatest({c}, {lo}), {hi}) END"


def _median_sql(c: str) -> str:
    return f"coalesce((SELECT train_median FROM fit WHERE feature = '{c}'), 0.0)"


# the fills as the rule says them: changes, volume scores and bodies 0, what is left the training median
_CLEANED = f"""cl AS (SELECT symbol, open_time, coalesce({_clip_sql('return_1h')}, 0.0) AS return_1h, coalesce({_clip_sql('return_4h')}, 0.0) AS return_4h, coalesce({_clip_sql('return_24h')}, 0.0) AS return_24h,
  coalesce({_clip_sql('volatility_24h')}, {_median_sql('volatility_24h')}) AS volatility_24h, coalesce({_clip_sql('vol_zscore')}, 0.0) AS vol_zscore, coalesce({_clip_sql('candle_body')}, 0.0) AS candle_body,
  coalesce({_clip_sql('volume')}, {_median_sql('volume')}) AS volume FROM feat)"""


@query(f"{_FIT}, {_CLEANED} SELECT symbol, open_time, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in COLUMNS)} FROM cl")
def winsor_impute(spark: SparkSession, d: str) -> DataFrame:
    f, stats = _fit(spark, d)
    return rounded(K.apply(f.select("symbol", "open_time", *COLUMNS), K.fitted(stats), COLUMNS))


_EFFECTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} < (SELECT clip_lo FROM fit WHERE feature = '{c}') OR {c} > (SELECT clip_hi FROM fit WHERE feature = '{c}')) AS n_clipped, count(*) - count({c}) AS n_filled, 0::BIGINT AS n_infinite FROM feat"
    for c in COLUMNS
)


@query(f"{_FIT} {_EFFECTS}")
def cleaning_effects(spark: SparkSession, d: str) -> DataFrame:
    f, stats = _fit(spark, d)
    return K.effects(f, K.fitted(stats), COLUMNS)


@query(f"{_FIT}, {_CLEANED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} NOT BETWEEN (SELECT clip_lo FROM fit WHERE feature = '{c}') - 1e-9 AND (SELECT clip_hi FROM fit WHERE feature = '{c}') + 1e-9 AND {c} <> {'0.0' if c.startswith(('return', 'vol_z', 'candle')) else _median_sql(c)}) AS n_outside, count(*) - count({c}) AS n_null FROM cl"
    for c in COLUMNS
))
def clean_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The proof that a cleaned table keeps to the bounds of the training rows."""
    f, stats = _fit(spark, d)
    s = K.fitted(stats)
    return K.within_bounds(K.apply(f.select("symbol", "open_time", *COLUMNS), s, COLUMNS), s)


@query(
    """WITH k AS (SELECT 'events' AS tbl, event_type || '/' || epoch_us(ts) // 3600000000 AS k FROM events UNION ALL SELECT 'lineitem', l_orderkey || '/' || l_linenumber FROM lineitem UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders)
SELECT tbl, count(*) AS n_rows, count(DISTINCT k) AS n_keys, count(*) - count(DISTINCT k) AS n_duplicates FROM k GROUP BY 1"""
)
def dup_audit(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d).select("symbol", C.floor_ms(F.unix_millis("time"), C.HOUR_MS).alias("h"))
    parts = [
        S.duplicate_keys(df, *key).withColumn("tbl", F.lit(name))
        for name, df, key in (
            ("events", t, ("symbol", "h")),
            ("lineitem", table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber")),
            ("orders", table(spark, d, "orders"), ("o_orderkey",)),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Candles with faults: some twice, some with a high below their low; a grid with wrong targets and prices in gaps.
_FAULTY = f"""{HOURLY}, sp AS (SELECT symbol, open_time, open, CASE WHEN trade_count = 4 THEN low - 1 ELSE high END AS high, low, close, volume, trade_count FROM candles),
dd AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE trade_count = 5),
ft AS (SELECT symbol, open_time, is_real, CASE WHEN NOT is_real AND open_time % 86400000 = 0 THEN 1.0 ELSE close END AS close, lead(close, 4) OVER ({W}) / nullif(close, 0) - 1 + CASE WHEN trade_count = 6 THEN 0.001 ELSE 0 END AS y FROM grid),
c AS (SELECT *, open_time - {lag('open_time')} AS step, abs(close / nullif({lag('close')}, 0) - 1) AS move FROM dd),
a AS (SELECT count(*) FILTER (step = 0) AS dups, count(*) FILTER (step > 3600000) AS gaps, count(*) FILTER (NOT (high >= greatest(open, close, low) AND low <= least(open, close, high) AND low > 0 AND volume >= 0)) AS insane, count(*) FILTER (move > 0.3) AS moves FROM c),
pr AS (SELECT f.*, g.close / nullif(f.close, 0) - 1 AS proof FROM ft f LEFT JOIN ft g ON g.symbol = f.symbol AND g.open_time = f.open_time + 14400000),
b AS (SELECT count(*) FILTER (coalesce(abs(y - proof) > 1e-6, (y IS NULL) <> (proof IS NULL))) AS wrong, count(*) FILTER (NOT is_real AND close IS NOT NULL) AS invented, avg(CAST(y IS NULL AS DOUBLE)) AS no_target FROM pr),
rep AS (SELECT 'duplicates' AS "check", CASE WHEN dups > 0 THEN 'FAIL' ELSE 'PASS' END AS level, 'rows that repeat a key' AS message, CAST(dups AS DOUBLE) AS value FROM a
UNION ALL SELECT 'gaps', CASE WHEN gaps > 0 THEN 'WARN' ELSE 'PASS' END, 'steps longer than an hour', gaps FROM a UNION ALL SELECT 'ohlc', CASE WHEN insane > 0 THEN 'FAIL' ELSE 'PASS' END, 'candles that break an invariant', insane FROM a
UNION ALL SELECT 'moves', CASE WHEN moves > 0 THEN 'WARN' ELSE 'PASS' END, 'hourly moves above 30 percent', moves FROM a
UNION ALL SELECT 'target', CASE WHEN wrong > 0 THEN 'FAIL' ELSE 'PASS' END, 'targets that differ from the close four hours on', wrong FROM b UNION ALL SELECT 'gap_rows', CASE WHEN invented > 0 THEN 'FAIL' ELSE 'PASS' END, 'added rows with a price', invented FROM b
UNION ALL SELECT 'target_share', CASE WHEN no_target > 0.5 THEN 'WARN' ELSE 'PASS' END, 'share of rows without a target', round(no_target, 6) FROM b)"""


def _faulty_audit(spark: SparkSession, d: str) -> DataFrame:
    c, n = C.candles(ticks(spark, d)), F.col("trade_count")
    spoilt = c.withColumn("high", F.when(n == 4, F.col("low") - 1).otherwise(F.col("high")))
    f = X.with_target(C.on_grid(c)).withColumn("target_return_4h", F.col("target_return_4h") + F.when(n == 6, 0.001).otherwise(0.0))
    f = f.withColumn("close", F.when(~F.col("is_real") & (F.col("open_time") % C.DAY_MS == 0), 1.0).otherwise(F.col("close")))
    return Q.audit(spoilt.unionByName(spoilt.filter("trade_count = 5")), f)


@query(f"{_FAULTY} SELECT * FROM rep")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return _faulty_audit(spark, d)


@query(
    f"""{_FAULTY} SELECT count(*) FILTER (level = 'PASS') AS n_pass, count(*) FILTER (level = 'WARN') AS n_warn, count(*) FILTER (level = 'FAIL') AS n_fail, CAST(count(*) FILTER (level = 'FAIL') > 0 AS INTEGER) AS exit_code FROM rep"""
)
def audit_tally(spark: SparkSession, d: str) -> DataFrame:
    return Q.tally(_faulty_audit(spark, d))


@query(
    f"""{_FAULTY}, st AS (SELECT count(*) FILTER (step = 0) AS v1, count(*) FILTER (step > 5400000) AS v2, coalesce(sum(floor(step / 3600000.0 - 1)) FILTER (step > 5400000), 0) AS hours, count(*) FILTER (step <> 3600000) - count(*) FILTER (step > 5400000) AS v4,
  count(*) FILTER (high < open OR high < close OR high < low) AS bad_high, count(*) FILTER (low > open OR low > close OR low > high) AS bad_low, count(*) FILTER (volume < 0) AS neg FROM c),
tl AS (SELECT count(*) FILTER (y IS NULL AND back <= 6) AS tail, count(DISTINCT symbol) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS back FROM ft)), nn AS (SELECT count(*) FILTER (y IS NULL) AS v9 FROM ft)
SELECT 'V1' AS "check", CASE WHEN v1 > 0 THEN 'FAIL' ELSE 'PASS' END AS level, 'duplicate times' AS message, CAST(v1 AS DOUBLE) AS value FROM st
UNION ALL SELECT 'V2', CASE WHEN v2 > 0 THEN 'WARN' ELSE 'PASS' END, 'gaps between hours', v2 FROM st UNION ALL SELECT 'V2 hours', 'PASS', 'missing hours', hours FROM st
UNION ALL SELECT 'V3', CASE WHEN bad_high + bad_low + neg > 0 THEN 'FAIL' ELSE 'PASS' END, 'candles that break an invariant', bad_high + bad_low + neg FROM st
UNION ALL SELECT 'V4', CASE WHEN v4 > 0 THEN 'WARN' ELSE 'PASS' END, 'steps that are neither an hour nor a gap', v4 FROM st
UNION ALL SELECT 'V5', 'FAIL', 'columns named after the future: next_open', 1 UNION ALL SELECT 'V6', 'PASS', 'targets among the features', 0
UNION ALL SELECT 'V6 tail', CASE WHEN tail < 4 * n THEN 'WARN' ELSE 'PASS' END, 'missing targets in the last six rows of a series', tail FROM tl
UNION ALL SELECT 'V7', 'PASS', 'statistics come from training rows only', 0 UNION ALL SELECT 'V8', 'WARN', 'alignment of funding needs its own table', 1
UNION ALL SELECT 'V9', CASE WHEN v9 = 0 THEN 'WARN' ELSE 'PASS' END, 'rows without a target', v9 FROM nn"""
)
def validation_suite(spark: SparkSession, d: str) -> DataFrame:
    """The nine checks of a feature table, over faulty candles and a column with a name from the future."""
    c, n = C.candles(ticks(spark, d)), F.col("trade_count")
    spoilt = c.withColumn("high", F.when(n == 4, F.col("low") - 1).otherwise(F.col("high"))).withColumn("next_open", F.lit(0.0))
    return Q.validations(spoilt.unionByName(spoilt.filter("trade_count = 5")), X.with_target(C.on_grid(c)), [*COLUMNS, "next_open"])


@query(
    f"""{HOURLY}, e AS (SELECT symbol, close / nullif({lag('close', 4)}, 0) - 1 + CASE WHEN trade_count = 6 THEN 0.01 ELSE 0 END AS given, CASE WHEN trade_count <> 5 OR trade_count IS NULL THEN close / nullif({lag('close', 4)}, 0) - 1 END AS formula FROM grid)
SELECT symbol, round(coalesce(max(abs(given - formula)), 0), 6) + 0.0 AS max_error, count(*) FILTER ((given IS NULL) <> (formula IS NULL)) AS n_one_sided FROM e GROUP BY 1"""
)
def causality_proof(spark: SparkSession, d: str) -> DataFrame:
    """A stored column against its formula, where some rows were changed and some lost."""
    n = F.col("trade_count")
    f = X.with_returns(hourly(spark, d)).withColumn("formula", F.when(F.coalesce(n != 5, F.lit(True)), F.col("return_4h")))
    f = f.withColumn("given", F.col("return_4h") + F.when(n == 6, 0.01).otherwise(0.0))
    return rounded(Q.max_error(f, "given", F.col("formula"), "symbol"))


@query(
    f"""{HOURLY}, s AS (SELECT symbol, coalesce(abs(volume - {lag('volume')}) > 1e-12, false) AS ch, volume FROM grid),
t AS (SELECT symbol, avg(CAST(ch AS DOUBLE)) AS rate, count(*) AS n, avg(CAST(volume IS NOT NULL AS DOUBLE)) AS cover FROM s GROUP BY 1)
SELECT symbol, round(rate, 6) + 0.0 AS step_rate, n, round(cover, 6) + 0.0 AS coverage, CASE WHEN rate > 0.3 THEN 'FAIL' WHEN cover < 0.5 THEN 'WARN' ELSE 'PASS' END AS level FROM t"""
)
def step_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.step_coverage(hourly(spark, d), "volume", "symbol"))


@query(f"WITH {TICKS}, {candles_cte()}, s AS (SELECT symbol, open_time, open_time - {lag('open_time')} AS step_ms FROM candles) SELECT * FROM s WHERE step_ms IS NOT NULL ORDER BY step_ms DESC, symbol, open_time LIMIT 5")
def largest_gaps(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions import windows

    c = C.candles(ticks(spark, d)).select("symbol", "open_time", windows.diff("open_time", windows.series("symbol")).alias("step_ms"))
    return c.filter("step_ms is not null").orderBy(F.desc("step_ms"), "symbol", "open_time").limit(5)
