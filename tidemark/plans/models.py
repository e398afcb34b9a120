"""Queries over boosted trees.

Those with SQL train on one split a tree, for which SQL can add up gradients, weigh both sides for
missing values and walk on round by round; the others train whole trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import boosting as G
from tidemark.operators import features as X
from tidemark.operators import ml
from tidemark.operators import stats as S
from tidemark.plans.base import query, rounded
from tidemark.plans.market import hourly
from tidemark.plans.quality import FEAT, TRAIN_UNTIL, frame

STUMP_COLUMNS = ["return_1h", "return_4h", "return_24h", "volatility_24h", "vol_zscore", "candle_body"]
STUMPS = G.Params(rounds=4, depth=1, rate=0.3, rows_share=1.0, columns_share=1.0, least_weight=5.0, gamma=0.0, alpha=0.1, lam=1.0, patience=None, bins=8)


def key():
    return F.xxhash64("symbol", "open_time")


def stumps_sql(y: str, where: str, loss: str, p: G.Params = STUMPS) -> str:
    """CTEs m0, m1, ... (symbol, open_time, y, train, m) of the margins after each round, and best1, best2, ... of the splits."""
    shares = "[" + ", ".join(f"CAST({k} AS DOUBLE) / {p.bins}" for k in range(1, p.bins)) + "]"
    cuts = " UNION ALL ".join(f"SELECT {i} AS i, unnest(range({p.bins - 1})) AS k, unnest(quantile_cont({c}, {shares})) AS cut FROM d WHERE train" for i, c in enumerate(STUMP_COLUMNS))
    cells = " UNION ALL ".join(f"SELECT symbol, open_time, {i} AS i, {c} AS x FROM d" for i, c in enumerate(STUMP_COLUMNS))
    start = "ln(avg(y) / (1 - avg(y)))" if loss == "logistic" else "avg(y)"
    proba = "(1 / (1 + exp(-m)))" if loss == "logistic" else "m"
    weight = f"{proba} * (1 - {proba})" if loss == "logistic" else "CAST(1 AS DOUBLE)"
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {p.alpha}, 0))"
    gain = lambda g, h: f"pow({soft(g)}, 2) / ({h} + {p.lam})"
    out = f"""{FEAT}, d AS MATERIALIZED (SELECT symbol, open_time, {', '.join(STUMP_COLUMNS)}, CAST({y} AS DOUBLE) AS y, open_time <= {TRAIN_UNTIL} AS train FROM feat WHERE {where}),
cuts AS MATERIALIZED ({cuts}), cells AS MATERIALIZED ({cells}),
b AS MATERIALIZED (SELECT symbol, open_time, i, CASE WHEN x IS NULL THEN NULL ELSE count(*) FILTER (cut < x) END AS bin FROM cells JOIN cuts USING (i) GROUP BY symbol, open_time, i, x),
m0 AS MATERIALIZED (SELECT symbol, open_time, y, train, (SELECT {start} FROM d WHERE train) AS m FROM d)"""
    for r in range(1, p.rounds + 1):
        out += f""",
h{r} AS MATERIALIZED (SELECT i, bin, sum({proba} - y) AS g, sum({weight}) AS h FROM b JOIN m{r - 1} USING (symbol, open_time) WHERE train GROUP BY ALL),
s{r} AS (SELECT i, k, missing, coalesce(sum(g) FILTER (bin <= k OR (bin IS NULL AND missing)), 0) AS lg, coalesce(sum(h) FILTER (bin <= k OR (bin IS NULL AND missing)), 0) AS lh, sum(g) AS tg, sum(h) AS th
  FROM h{r}, range({p.bins - 1}) r(k), (VALUES (true), (false)) z(missing) GROUP BY ALL),
best{r} AS MATERIALIZED (SELECT *, {r} AS round FROM (SELECT *, tg - lg AS rg, th - lh AS rh, CAST(printf('%.8e', 0.5 * ({gain('lg', 'lh')} + {gain('(tg - lg)', '(th - lh)')} - {gain('tg', 'th')}) - {p.gamma}) AS DOUBLE) AS gain FROM s{r}
  WHERE lh >= {p.least_weight} AND th - lh >= {p.least_weight}) WHERE gain > 0 ORDER BY gain DESC, i, missing DESC, k LIMIT 1),
m{r} AS MATERIALIZED (SELECT symbol, open_time, y, train, m + coalesce(CASE WHEN coalesce(bin <= k, missing) THEN -{p.rate} * {soft('lg')} / (lh + {p.lam}) ELSE -{p.rate} * {soft('rg')} / (rh + {p.lam}) END, 0) AS m
  FROM m{r - 1} LEFT JOIN (b JOIN best{r} USING (i)) USING (symbol, open_time))"""
    return out


_UP = stumps_sql("CAST(target_direction_4h = 1 AS INTEGER)", "target_direction_4h <> 0", "logistic")
_RET = stumps_sql("target_return_4h", "target_return_4h IS NOT NULL", "squared")


def _stumps(spark: SparkSession, d: str, loss: str) -> tuple[DataFrame, G.Boosted]:
    f = frame(spark, d)
    if loss == "logistic":
        f = f.filter("target_direction_4h <> 0").withColumn("y", (F.col("target_direction_4h") == 1).cast("int"))
    else:
        f = f.filter("target_return_4h IS NOT NULL").withColumn("y", F.col("target_return_4h"))
    train = f.filter(F.col("open_time") <= TRAIN_UNTIL)
    shares = tuple(k / STUMPS.bins for k in range(1, STUMPS.bins))
    cuts, _ = S.exact_quantiles(train, STUMP_COLUMNS, shares, S.wide_stats(train, STUMP_COLUMNS, shares))
    role = F.when(F.col("open_time") <= TRAIN_UNTIL, G.TRAIN)
    return f, G.fit(f, STUMP_COLUMNS, "y", role, G.replace(STUMPS, loss=loss), key(), cuts)


@query(f"{_UP} SELECT symbol, open_time, round(1 / (1 + exp(-m)), 6) + 0.0 AS proba FROM m{STUMPS.rounds} WHERE NOT train")
def boosted_direction(spark: SparkSession, d: str) -> DataFrame:
    """Test rows with the probability of a rise by boosted stumps that learn a side for missing values."""
    f, model = _stumps(spark, d, "logistic")
    return rounded(model.predict(f.filter(F.col("open_time") > TRAIN_UNTIL)).select("symbol", "open_time", "proba"))


@query(
    f"""{_RET}, t AS (SELECT y, m AS p FROM m{STUMPS.rounds} WHERE NOT train) SELECT count(*) AS n, round(avg(abs(y - p)), 6) + 0.0 AS mae, round(sqrt(avg(pow(y - p, 2))), 6) + 0.0 AS rmse,
  round(1 - avg(pow(y - p, 2)) / nullif(var_pop(y), 0), 4) + 0.0 AS r2, round(avg(CAST(sign(y) = sign(p) AS DOUBLE)), 6) + 0.0 AS directional_accuracy FROM t"""
)
def boosted_return(spark: SparkSession, d: str) -> DataFrame:
    """Errors on test rows of a regression by boosted stumps."""
    f, model = _stumps(spark, d, "squared")
    made = model.predict(f.filter(F.col("open_time") > TRAIN_UNTIL), "prediction")
    return rounded(B.regression_metrics(made, "y", "prediction")).withColumn("r2", F.round("r2", 4) + 0.0)


@query(
    f"""{_UP}, every AS ({' UNION ALL '.join(f'SELECT i, gain FROM best{r}' for r in range(1, STUMPS.rounds + 1))}), names(i, feature) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(STUMP_COLUMNS))})
SELECT feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM every), 6) + 0.0 AS importance FROM names LEFT JOIN every USING (i) GROUP BY 1"""
)
def boosted_importances(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's share of the gain of the boosted stumps."""
    _, model = _stumps(spark, d, "logistic")
    return rounded(spark.createDataFrame(model.importances(), "feature string, importance double"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    f = X.with_target(X.with_volume(X.with_volatility(X.with_returns(X.with_candle_shape(X.with_time(hourly(spark, d)))))))
    return f.filter("target_direction_4h <> 0").withColumn("label", (F.col("target_direction_4h") == 1).cast("int"))


#: Rounds of the queries below; the settings are the classifier's and the regressor's otherwise.
ROUNDS = 12


@query()
def gbt_walkforward(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of a classifier on each of five expanding folds, all trained in the same passes."""
    return G.walk_forward(_labelled(spark, d), list(ml.FEATURES), "label", G.replace(G.CLASSIFIER, rounds=ROUNDS, patience=None), key())


@query()
def gbt_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Test rows with the first model's side and probability and the probability of the second, which sees the first's."""
    s = B.time_split(_labelled(spark, d))
    first, second = G.fit_two_stage(s, list(ml.FEATURES), G.replace(G.CLASSIFIER, rounds=ROUNDS, patience=None), key())
    return G.two_stage(first, second, s.filter("split = 'test'")).select("symbol", "open_time", "pred", "model1_prob_up", "proba")


@query()
def gbt_regression(spark: SparkSession, d: str) -> DataFrame:
    """The regressor's errors on test rows."""
    s = B.time_split(_labelled(spark, d))
    role = F.when(F.col("split") == "train", G.TRAIN)
    model = G.fit(s, list(ml.FEATURES), "target_return_4h", role, G.replace(G.REGRESSOR, rounds=ROUNDS), key())
    return B.regression_metrics(model.predict(s.filter("split = 'test'"), "prediction"), "target_return_4h", "prediction")


@query()
def gbt_importances(spark: SparkSession, d: str) -> DataFrame:
    """Importances of the features of a classifier that stops early on validation rows."""
    s = B.time_split(_labelled(spark, d)).filter("split <> 'test'")
    columns = ml.feature_columns(s.select(*ml.FEATURES, "label", "close", "target_return_4h"))
    role = F.when(F.col("split") == "train", G.TRAIN).otherwise(G.VALIDATION)
    model = G.fit(s, columns, "label", role, G.replace(G.CLASSIFIER, rounds=ROUNDS, patience=4), key())
    return spark.createDataFrame(model.importances(), "feature string, importance double")
