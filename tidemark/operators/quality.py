"""The audit: checks of tables as rows (check, level, message, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W

#: Parts of names that tell of the future.
LOOKAHEAD = ("future", "fwd", "ahead", "next_")
HOUR_MS = 3_600_000


def lookahead_columns(columns: list[str]) -> list[str]:
    """Columns whose names tell of the future."""
    return [c for c in columns if any(p in c.lower() for p in LOOKAHEAD)]


def graded(one: DataFrame, checks: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """Rows out of a table of one row: name, level by `fail` (else WARN by `warn`), message, value."""
    cells = F.array(
        *(
            F.struct(F.lit(name).alias("check"), level.alias("level"), F.lit(message).alias("message"), value.cast("double").alias("value"))
            for name, level, value, message in checks
        )
    )
    return one.select(F.inline(cells))


def level(fails: Column, warns: Column | None = None) -> Column:
    out = F.when(F.coalesce(fails, F.lit(False)), "FAIL")
    return (out if warns is None else out.when(F.coalesce(warns, F.lit(False)), "WARN")).otherwise("PASS")


def audit(candles: DataFrame, features: DataFrame, key: str = "symbol", horizon: int = 4) -> DataFrame:
    """Duplicates, gaps, sane candles, large moves, causality and the target's alignment.

    Gaps are counted on the candles, before a grid adds rows; `features` is the grid with
    target_return and is_real. All measures are aggregates over one pass of each table.
    """
    w = W.series(key)
    c = candles.select(
        key, "open_time", "open", "high", "low", "close", "volume", (F.col("open_time") - F.lag("open_time").over(w)).alias("step"),
        F.abs(W.change("close", w, 1)).alias("move"),
    )
    sane = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")) & (F.col("low") > 0) & (F.col("volume") >= 0)
    a = c.agg(
        F.count_if(F.col("step") == 0).alias("dups"), F.count_if(F.col("step") > HOUR_MS).alias("gaps"), F.count_if(~sane).alias("insane"),
        F.count_if(F.col("move") > 0.3).alias("moves"), F.count("*").alias("n"),
    )
    later = features.select(key, (F.col("open_time") - horizon * HOUR_MS).alias("open_time"), F.col("close").alias("later"))
    j = features.join(later, [key, "open_time"], "left")
    t = F.col(f"target_return_{horizon}h")
    proof = W.ratio("later", "close") - 1
    b = j.agg(
        F.count_if(F.coalesce(F.abs(t - proof) > 1e-6, t.isNull() != proof.isNull())).alias("wrong"),
        F.count_if(~F.col("is_real") & F.col("close").isNotNull()).alias("invented"),
        F.avg(t.isNull().cast("double")).alias("no_target"),
    )
    one = a.join(F.broadcast(b))  # one row each
    return graded(
        one,
        [
            ("duplicates", level(F.col("dups") > 0), F.col("dups"), "rows that repeat a key"),
            ("gaps", level(F.lit(False), F.col("gaps") > 0), F.col("gaps"), "steps longer than an hour"),
            ("ohlc", level(F.col("insane") > 0), F.col("insane"), "candles that break an invariant"),
            ("moves", level(F.lit(False), F.col("moves") > 0), F.col("moves"), "hourly moves above 30 percent"),
            ("target", level(F.col("wrong") > 0), F.col("wrong"), "targets that differ from the close four hours on"),
            ("gap_rows", level(F.col("invented") > 0), F.col("invented"), "added rows with a price"),
            ("target_share", level(F.lit(False), F.col("no_target") > 0.5), F.round("no_target", 6), "share of rows without a target"),
        ],
    )


def tally(report: DataFrame) -> DataFrame:
    """Counts of the levels; any FAIL makes the verdict FAIL, which is exit code 1."""
    n = lambda x: F.count_if(F.col("level") == x)
    d = report.agg(n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail"))
    return d.withColumn("exit_code", (F.col("n_fail") > 0).cast("int"))


def max_error(df: DataFrame, given: str, formula: Column, *keys: str) -> DataFrame:
    """The largest difference between a stored column and its formula, and rows where only one is known."""
    e = F.abs(F.col(given) - formula)
    return df.groupBy(*keys).agg(F.coalesce(F.max(e), F.lit(0.0)).alias("max_error"), F.count_if(F.col(given).isNull() != formula.isNull()).alias("n_one_sided"))


def step_rate(df: DataFrame, value: str, key: str, time: str = "open_time") -> DataFrame:
    """Share of rows where a value changed from the row before; the first row counts as unchanged."""
    changed = F.coalesce(F.abs(W.diff(value, W.series(key, order=time))) > 1e-12, F.lit(False))
    return df.select(key, changed.alias("c")).groupBy(key).agg(F.avg(F.col("c").cast("double")).alias("step_rate"), F.count("*").alias("n"))


def step_coverage(df: DataFrame, value: str, key: str, time: str = "open_time", most: float = 0.30, least: float = 0.50) -> DataFrame:
    """`step_rate` with the share of rows that have the value: changes in more than `most` of rows fail, a thin column warns."""
    known = df.groupBy(key).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))
    d = step_rate(df, value, key, time).join(known, key)
    return d.withColumn("level", level(F.col("step_rate") > most, F.col("coverage") < least))


def validations(candles: DataFrame, features: DataFrame, columns: list[str], key: str = "symbol", horizon: int = 4, tail: int = 6) -> DataFrame:
    """The nine checks of a feature table; `columns` are those a model would see.

    V7 holds by construction (bounds are fitted on training rows, see `cleaning.fit`) and V8 can't be
    told from features alone, so that one always warns.
    """
    w = W.series(key)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    step = F.col("step")
    gap = step > 1.5 * HOUR_MS
    bad = F.count_if((h < o) | (h < c) | (h < l)) + F.count_if((l > o) | (l > c) | (l > h)) + F.count_if(F.col("volume") < 0)
    a = candles.withColumn("step", W.diff("open_time", w)).agg(
        F.count_if(step == 0).alias("dups"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.floor(step / HOUR_MS - 1))), F.lit(0)).alias("hours"),
        bad.alias("bad"), (F.count_if(step != HOUR_MS) - F.count_if(gap)).alias("uneven"),
    )
    t = F.col(f"target_return_{horizon}h")
    back = F.row_number().over(W.series(key).orderBy(F.desc("open_time")))
    b = features.select(key, t.isNull().alias("none"), back.alias("back")).agg(
        F.count_if(F.col("none") & (F.col("back") <= tail)).alias("tail"), F.count_distinct(key).alias("series"), F.count_if("none").alias("none")
    )
    early, leaked = lookahead_columns(columns), [x for x in columns if x.startswith("target_")]
    number = lambda n: F.lit(float(n))
    return graded(
        a.join(F.broadcast(b)),  # one row each
        [
            ("V1", level(F.col("dups") > 0), F.col("dups"), "duplicate times"),
            ("V2", level(F.lit(False), F.col("gaps") > 0), F.col("gaps"), "gaps between hours"),
            ("V2 hours", F.lit("PASS"), F.col("hours"), "missing hours"),
            ("V3", level(F.col("bad") > 0), F.col("bad"), "candles that break an invariant"),
            ("V4", level(F.lit(False), F.col("uneven") > 0), F.col("uneven"), "steps that are neither an hour nor a gap"),
            ("V5", F.lit("FAIL" if early else "PASS"), number(len(early)), ": ".join(["columns named after the future", *early])),
            ("V6", F.lit("FAIL" if leaked else "PASS"), number(len(leaked)), ": ".join(["targets among the features", *leaked])),
            ("V6 tail", level(F.lit(False), F.col("tail") < horizon * F.col("series")), F.col("tail"), f"missing targets in the last {'six' if tail == 6 else tail} rows of a series"),
            ("V7", F.lit("PASS"), number(0), "statistics come from training rows only"),
            ("V8", F.lit("WARN"), number(1), "alignment of funding needs its own table"),
            ("V9", level(F.lit(False), F.col("none") == 0), F.col("none"), "rows without a target"),
        ],
    )


def edge_verdict(cv: DataFrame, least: float = 0.0) -> DataFrame:
    """Mean and population deviation of the folds' edge over the majority, and whether it is above `least`."""
    d = cv.agg(F.count("*").alias("n_folds"), F.avg("edge").alias("mean_edge"), F.stddev_pop("edge").alias("std_edge"))
    return d.withColumn("level", level(F.col("n_folds") == 0, F.coalesce(F.col("mean_edge") <= least, F.lit(True))))


def artefacts(spark, paths: list[str]) -> DataFrame:
    """Which files or folders are there, in any store Spark reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [(p, path(p).getFileSystem(conf).exists(path(p))) for p in paths]
    return spark.createDataFrame(found, "path string, present boolean")
