"""Models: gradient-boosted trees, walk-forward validation, baselines, importances, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.backtest import folds

FEATURES = ("return_1h", "return_4h", "return_24h", "volatility_24h", "vol_zscore", "candle_body", "is_bullish", "hour_sin", "hour_cos")
NOT_FEATURES = ("open_time", "open", "high", "low", "close", "is_real", "label", "split", "symbol")


def feature_columns(df: DataFrame, most_null: float = 0.5) -> list[str]:
    """Numeric columns that aren't keys, prices or targets and have at most `most_null` nulls."""
    names = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES and not f.name.startswith("target_")
    ]
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names)).first()
    return [c for c in names if shares[c] is not None and shares[c] <= most_null]


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features")


def gbt_classifier(columns: list[str], iterations: int = 20, validation: str | None = None) -> Pipeline:
    """Shallow boosted trees; with a validation column they stop early."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=3, stepSize=0.05, maxIter=iterations, subsamplingRate=0.8, seed=42)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assembler(columns), gbt])


def gbt_regressor(columns: list[str], target: str = "target_return_4h", iterations: int = 20) -> Pipeline:
    gbt = GBTRegressor(labelCol=target, featuresCol="features", maxDepth=4, stepSize=0.03, maxIter=iterations, subsamplingRate=0.8, seed=42)
    return Pipeline(stages=[assembler(columns), gbt])


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls as 0, since the trees take none; cleaned tables have none."""
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in columns else c for c in df.columns))


def with_probability(model: PipelineModel, df: DataFrame, out: str = "proba") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def two_stage(first: PipelineModel, second: PipelineModel, df: DataFrame) -> DataFrame:
    """The first model's side and probability, and the probability of the second, which sees the first's."""
    d = with_probability(first, df, "model1_prob_up").withColumnRenamed("prediction", "pred")
    return with_probability(second, d, "proba").drop("prediction")


def fit_early(split: DataFrame, columns: list[str], iterations: int = 20) -> tuple[PipelineModel, int]:
    """A classifier that stops adding trees once the validation rows no longer gain, and its number of trees."""
    d = filled(split.filter("split <> 'test'"), columns).withColumn("held", F.col("split") == "validation")
    model = gbt_classifier(columns, iterations, "held").fit(d)
    return model, model.stages[-1].getNumTrees


def fit_two_stage(split: DataFrame, columns: list[str], iterations: int = 5) -> tuple[PipelineModel, PipelineModel, list[str]]:
    """A model of the direction from the training rows, and one that tells from validation rows when the first is right.

    The second sees the first's probability besides the features, and rows the first hasn't learned from.
    """
    d = filled(split, columns)
    first = gbt_classifier(columns, iterations).fit(d.filter("split = 'train'"))
    seen = with_probability(first, d.filter("split = 'validation'"), "model1_prob_up")
    right = seen.withColumn("label", (F.col("prediction") == F.col("label")).cast("int")).drop("prediction")
    return first, gbt_classifier([*columns, "model1_prob_up"], iterations).fit(right), columns


def baselines(split: DataFrame, key: str = "symbol") -> DataFrame:
    """Accuracy on the test rows of the training rows' majority class and of the momentum column."""
    major = split.filter("split <> 'test'").groupBy(key).agg((F.avg("label") >= 0.5).cast("int").alias("major"))
    t = split.filter("split = 'test'").join(major, key)
    same = lambda a: F.avg((F.col("label") == F.col(a)).cast("double"))
    return t.groupBy(key).agg(F.count("*").alias("n_test"), same("major").alias("majority_accuracy"), same("momentum").alias("momentum_accuracy"))


def with_summary(cv: DataFrame) -> DataFrame:
    """The folds' rows with a row of their means (fold -1) and one of their population deviations (fold -2)."""
    names = ("accuracy", "majority", "edge")

    def row(fold: int, of) -> DataFrame:
        n = F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test")
        return cv.agg(*n, *(of(c).alias(c) for c in names)).select(F.lit(fold).alias("fold"), "n_train", "n_test", *names)

    return cv.unionByName(row(-1, F.avg)).unionByName(row(-2, F.stddev_pop))


RESULT = "fold int, n_train long, n_test long, accuracy double, majority double, edge double"


def walk_forward_cv(df: DataFrame, columns: list[str], factory: Callable[[list[str]], Pipeline], k: int = 5, time: str = "open_time", min_block: int = 100) -> DataFrame:
    """Accuracy of a new model on each expanding fold in time, the majority's, and the edge over it.

    Folds go by times, cut where they divide the rows evenly (within the quantile's error), so
    rows of one time stay together. Folds of a single class are left out.
    """
    data = filled(df, columns).select(time, "label", *columns).cache()
    try:
        n = data.count()
        rows = []
        for i, (train_end, _, test_end) in enumerate(folds(n, k, min_block)):
            lo, hi = data.approxQuantile(time, [train_end / n, min(1.0, test_end / n)], 0.0005)
            train = data.filter(F.col(time) <= lo)
            test = data.filter((F.col(time) > lo) & (F.col(time) <= hi))
            if train.select("label").distinct().count() < 2:
                continue
            p = factory(columns).fit(train).transform(test)
            a = p.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc"), F.avg("label").alias("up")).first()
            if not a["n"] or a["up"] in (0.0, 1.0):
                continue
            major = max(a["up"], 1 - a["up"])
            rows.append((i, train.count(), a["n"], a["acc"], major, a["acc"] - major))
        return df.sparkSession.createDataFrame(rows, RESULT)
    finally:
        data.unpersist()


def importances(model: PipelineModel, columns: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted pipeline, largest first."""
    values = [(c, float(v)) for c, v in zip(columns, model.stages[-1].featureImportances.toArray())]
    return df.sparkSession.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def metadata(model: PipelineModel, columns: list[str], df: DataFrame, time: str = "open_time") -> dict:
    """What a stored model should tell: features, parameters, the rows it saw."""
    span = df.agg(F.min(time), F.max(time), F.count("*")).first()
    params = {p.name: v for p, v in model.stages[-1].extractParamMap().items() if isinstance(v, (int, float, str, bool))}
    return {"features": columns, "params": params, "first": span[0], "last": span[1], "rows": span[2], "spark": df.sparkSession.version}


def latest_path(spark: SparkSession, pattern: str) -> str:
    """The last path that fits a glob, in order of names, which hold their times; in any store Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = [f.getPath().toString() for f in found or []]
    if not names:
        raise FileNotFoundError(pattern)
    return max(names)


def latest(spark: SparkSession, pattern: str) -> PipelineModel:
    return PipelineModel.load(latest_path(spark, pattern))
