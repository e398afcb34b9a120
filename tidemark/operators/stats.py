"""Column statistics: missing shares, distributions, histograms, drift, correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import ceil, exp, floor, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def melted(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep, feature, value) of the columns, as doubles."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keep, F.inline(cells))


#: Rows of a column that one task may sort.
ROWS_PER_TASK = 1_000_000


def _bucket_of(value: Column, cuts: Column, parts: int) -> Column:
    """How many of the sorted cuts lie below a value, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range((parts - 1).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get(cuts, i + step - 1) < value, i + step).otherwise(i))


def bucketed(m: DataFrame, group: str, value: str, rows_per_task: int | None = None, sizes: dict[str, int] | None = None) -> tuple[DataFrame, dict[str, list[int]]]:
    """`m` with bucket_, a range of values of at most about `rows_per_task` rows, and each group's rows by bucket.

    Equal values share a bucket. The driver gets a few numbers per group and bucket; `sizes` are the
    groups' rows if they are known.
    """
    sizes = sizes or {r[0]: r[1] for r in m.groupBy(group).count().collect()}
    parts = max((ceil(n / (rows_per_task or ROWS_PER_TASK)) for n in sizes.values()), default=1)
    if parts == 1:
        return m.withColumn("bucket_", F.lit(0)), {g: [n] for g, n in sizes.items()}
    at = [i / parts for i in range(1, parts)]
    cuts = [(r[0], sorted(set(r[1]))) for r in m.groupBy(group).agg(F.percentile_approx(value, at, 20 * parts)).collect()]
    cuts = m.sparkSession.createDataFrame(cuts, f"{group} string, cuts_ array<double>")
    b = m.join(F.broadcast(cuts), group)  # a row per group
    b = b.withColumn("bucket_", _bucket_of(F.col(value), F.col("cuts_"), parts)).drop("cuts_")
    rows = {g: [0] * parts for g in sizes}
    for g, k, n in b.groupBy(group, "bucket_").count().collect():
        rows[g][k] = n
    return b, rows


#: Ranks of approximate percentiles are wrong by a share of 1 / `ACCURACY` at most.
ACCURACY = 10_000


def wide_stats(df: DataFrame, columns: list[str], shares: tuple[float, ...], more: dict[str, Callable[[Column], Column]] | None = None) -> dict[str, dict]:
    """Each column's n, the measures of `more`, and around each share's quantile a bracket (low, high): one pass over all columns.

    All of it merges, so a task sends one row. The driver gets that of all tasks.
    """
    around = sorted({min(1.0, max(0.0, s + d / ACCURACY)) for s in shares for d in (-3, 3)})
    measures = {"n": F.count, "low": F.min, "high": F.max, "cuts": lambda c: F.percentile_approx(c, around, ACCURACY)} | (more or {})
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    one = df.agg(*(f(v).alias(f"{k}:{c}") for c, v in values.items() for k, f in measures.items())).first()
    out = {}
    for c in columns:
        found = {k: one[f"{k}:{c}"] for k in measures}
        at = dict(zip(around, found.pop("cuts") or [None] * len(around)))
        found["brackets"] = [tuple(at[min(1.0, max(0.0, s + d / ACCURACY))] for d in (-3, 3)) for s in shares]
        out[c] = found
    return out


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], stats: dict[str, dict], flags: dict[str, Column] | None = None) -> tuple[dict[str, list[float]], dict[str, int]]:
    """Interpolated quantiles of each column, exact: a second pass, in which only values inside the brackets of `wide_stats` move.

    Equal values move as one row a task. Values beyond a bracket are counted on its shorter side. A
    bracket that turns out not to hold its quantile is widened to all values. The same pass counts
    each column's rows for which its condition in `flags` holds.
    """
    flags, flagged = flags or {}, {}
    pending = {(c, k) for c in columns for k in range(len(shares)) if stats[c]["n"]}
    found: dict[tuple[str, int], float] = {}
    brackets = {(c, k): stats[c]["brackets"][k] for c, k in pending}
    while pending or flags:
        cells = [F.when(on, F.struct(F.lit(c).alias("feature"), F.lit(-1).alias("k"), F.lit(None).cast("double").alias("x"))) for c, on in flags.items()]
        for c, k in sorted(pending):
            x, (low, high) = F.col(c).cast("double"), brackets[c, k]
            beyond = x < low if shares[k] <= 0.5 else x > high
            inside = x.between(low, high) & ~F.isnan(x)
            cells.append(F.when(inside | (beyond & ~F.isnan(x)), F.struct(F.lit(c).alias("feature"), F.lit(k).alias("k"), F.when(inside, x).alias("x"))))
        counts = df.select(F.inline(F.filter(F.array(*cells), lambda s: s.isNotNull()))).groupBy("feature", "k", "x").agg(F.count("*").alias("rows"))
        w = Window.partitionBy("feature", "k")
        side = F.coalesce(F.max(F.when(F.col("x").isNull(), F.col("rows"))).over(w), F.lit(0))
        held = F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("rows"))).over(w), F.lit(0))
        ends = F.sum(F.when(F.col("x").isNotNull(), F.col("rows"))).over(w.orderBy(F.col("x").asc_nulls_first()))
        places = [(c, k, stats[c]["n"], floor((stats[c]["n"] - 1) * shares[k]), shares[k] <= 0.5) for c, k in sorted(pending)]
        places = df.sparkSession.createDataFrame(places, "feature string, k int, n long, place long, from_low boolean")
        j = counts.withColumns({"side": side, "held": held, "ends": ends}).join(F.broadcast(places), ["feature", "k"], "left").filter("x IS NOT NULL OR k = -1")
        start = F.when(F.col("from_low"), F.col("side")).otherwise(F.col("n") - F.col("side") - F.col("held"))
        last = start + F.col("ends")  # places from here on belong to greater values
        near = j.filter((F.col("k") == -1) | (last > F.col("place")) & (last - F.col("rows") <= F.col("place") + 1)).select("feature", "k", "x", (last - F.col("rows")).alias("first"), last.alias("last"), "rows")
        values: dict[tuple[str, int], list] = {}
        for r in near.collect():  # one or two values for each quantile
            if r["k"] == -1:
                flagged[r["feature"]] = r["rows"]
            else:
                values.setdefault((r["feature"], r["k"]), []).append((r["first"], r["last"], r["x"]))
        for c, k in sorted(pending):
            at = (stats[c]["n"] - 1) * shares[k]
            pair = [next((x for a, b, x in values.get((c, k), []) if a <= p < b), None) for p in (floor(at), min(floor(at) + 1, stats[c]["n"] - 1))]
            if None not in pair or (pair[0] is not None and at == floor(at)):
                weight = at - floor(at)
                found[c, k] = pair[0] if not weight else pair[0] * (1 - weight) + pair[1] * weight
        flags = {}
        pending -= set(found)
        for c, k in pending:
            brackets[c, k] = (stats[c]["low"], stats[c]["high"])
    return {c: [found.get((c, k)) for k in range(len(shares))] for c in columns}, flagged


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls of each column, and its class, in one pass over the table."""
    one = df.agg(F.count("*").alias("n"), *(F.count(F.col(c)).alias(c) for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col("n") - F.col(c)).alias("n_null")) for c in columns))
    d = one.select("n", F.inline(cells)).withColumn("null_share", F.col("n_null") / F.nullif(F.col("n"), F.lit(0)))
    s = F.col("null_share")
    return d.select("feature", "n_null", "null_share", F.when(s == 0, "none").when(s <= 0.1, "low").when(s <= 0.5, "medium").otherwise("high").alias("level"))


def distribution(df: DataFrame, columns: list[str], least: int = 100) -> DataFrame:
    """Moments, percentiles and values beyond five deviations of each column with `least` values or more.

    Two passes over all columns at once: what merges, then what needs the first one's results.
    """
    moments = {"mean": F.avg, "std": F.stddev_samp, "skew": F.skewness, "kurtosis": F.kurtosis}
    s = wide_stats(df, columns, (0.01, 0.99), moments)
    have = [c for c in columns if s[c]["n"] >= least]
    beyond = {c: F.abs(F.col(c).cast("double") - s[c]["mean"]) > 5 * s[c]["std"] for c in have if s[c]["std"] is not None}
    p, far = exact_quantiles(df, have, (0.01, 0.99), s, beyond)
    varies = {c: (s[c]["std"] or 0.0) > 1e-12 * abs(s[c]["mean"]) for c in have}  # what rounding leaves of a constant column doesn't count
    rows = [(c, s[c]["n"], s[c]["mean"], s[c]["std"], s[c]["low"], *p[c], s[c]["high"], *(s[c][k] if varies[c] else None for k in ("skew", "kurtosis")), far.get(c, 0)) for c in have]
    kinds = "feature string, n long, mean double, std double, min double, p1 double, p99 double, max double, skew double, kurtosis double, n_outliers long"
    return df.sparkSession.createDataFrame(rows, kinds)


#: The histogram's edges, each class holding its lower one.
EDGES = (-0.05, -0.02, -0.01, 0.01, 0.02, 0.05)


def histogram(df: DataFrame, value: str, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Counts of the classes between the edges, empty ones too; nulls are left out."""
    v = F.col(value)
    bin_ = F.lit(0)
    for e in edges:
        bin_ = bin_ + F.when(v >= e, 1).otherwise(0)
    counts = df.filter(v.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def class_balance(df: DataFrame, direction: str, *keys: str) -> DataFrame:
    """Ups and downs (flat and null left out), their imbalance and the weight that evens them out."""
    d = F.col(direction)
    s = df.groupBy(*keys).agg(F.count_if(d == 1).alias("n_up"), F.count_if(d == -1).alias("n_down"))
    n = F.col("n_up") + F.col("n_down")
    return s.select(
        *keys, "n_up", "n_down", (F.abs(F.col("n_up") - F.col("n_down")) / F.nullif(n, F.lit(0))).alias("imbalance"),
        (F.col("n_down") / F.nullif("n_up", F.lit(0))).alias("up_weight"),
    )


def half_year(t: Column) -> Column:
    return F.concat(F.year(t).cast("string"), F.when(F.month(t) <= 6, "-H1").otherwise("-H2"))


def drift(df: DataFrame, columns: list[str], period: Column, least: int = 11, limit: float = 0.30) -> DataFrame:
    """Spread of a column's means over periods (with `least` values or more) against its overall deviation."""
    m = melted(df.withColumn("period_", period), columns, ("period_",)).filter(F.col("value").isNotNull())
    whole = m.groupBy("feature").agg(F.stddev_samp("value").alias("std"))
    means = m.groupBy("feature", "period_").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= least)
    spread = means.groupBy("feature").agg(F.count("*").alias("n_periods"), F.stddev_pop("mean").alias("spread"))
    d = spread.join(whole, "feature").withColumn("drift", F.col("spread") / F.nullif("std", F.lit(0.0)))
    return d.select("feature", "n_periods", "drift", F.coalesce(F.col("drift") > limit, F.lit(False)).alias("drifts"))


def _safe_corr(x: Column, y: Column) -> Column:
    """Pearson over rows where both are known; null where one is constant, on which corr would fail."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n, sa, sb = F.count(a), F.stddev_pop(a), F.stddev_pop(b)
    return F.when((n > 1) & (sa > 0) & (sb > 0), F.covar_pop(a, b) / F.nullif(sa * sb, F.lit(0.0)))


def _cross_sums(columns: int, centre: list[float]):
    """Sums over pairs of columns, on rows where both are known: n, x, y, xx, yy, xy, as one array a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, columns, columns))
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centre
            known = np.isfinite(x)
            x, k = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([k.T @ k, x.T @ k, k.T @ x, (x * x).T @ k, k.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of each pair in column order over rows where both are known; null where one is constant.

    Each task sums the pairs' products as one matrix product over its rows; values are taken from
    their column's mean, so that the sums keep their digits.
    """
    x = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    centre = [m or 0.0 for m in x.agg(*(F.avg(c) for c in x.columns)).first()]
    parts = x.mapInArrow(_cross_sums(len(columns), centre), "sums array<double>").select(F.posexplode("sums").alias("i", "s"))
    n = len(columns) ** 2
    pair = parts.groupBy((F.col("i") % n).alias("p"), F.floor(F.col("i") / n).cast("int").alias("k")).agg(F.sum("s").alias("s"))
    of = lambda k: F.sum(F.when(F.col("k") == k, F.col("s")))
    pair = pair.groupBy("p").agg(*(of(k).alias(c) for k, c in enumerate(("n", "sx", "sy", "xx", "yy", "xy"))))
    vx, vy, xy = (F.col(a) - F.col(b) * F.col(c) / F.nullif("n", F.lit(0.0)) for a, b, c in (("xx", "sx", "sx"), ("yy", "sy", "sy"), ("xy", "sx", "sy")))
    tiny = 1e-12  # of the sum of squares: what rounding leaves of a constant column
    corr = F.when((F.col("n") > 1) & (vx > tiny * F.col("xx")) & (vy > tiny * F.col("yy")), xy / F.nullif(F.sqrt(vx * vy), F.lit(0.0)))
    names, a, b = F.array(*map(F.lit, columns)), F.floor(F.col("p") / len(columns)).cast("int"), (F.col("p") % len(columns)).cast("int")
    return pair.filter(a < b).select(F.get(names, a).alias("a"), F.get(names, b).alias("b"), corr.alias("corr"))


def to_drop(pairs: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """The second column of each pair beyond the limit, unless the first went before; a row per pair of columns."""
    high = {(r["a"], r["b"]) for r in pairs.filter(F.abs("corr") >= limit).collect()}
    gone: list[str] = []
    for a, b in combinations(columns, 2):
        if (a, b) in high and a not in gone and b not in gone:
            gone.append(b)
    return gone


def average_ranks(m: DataFrame, group: str, value: str, out: str, rows_per_task: int | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """Ranks with ties at their mean: the place inside a range of values, after the rows of lower ranges."""
    b, rows = bucketed(m, group, value, rows_per_task, sizes)
    w = Window.partitionBy(group, "bucket_")
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(group, "bucket_", value)) - 1) / 2
    if any(len(n) > 1 for n in rows.values()):
        before = [(g, k, end - n) for g, sizes in rows.items() for k, (n, end) in enumerate(zip(sizes, accumulate(sizes)))]
        b = b.join(F.broadcast(m.sparkSession.createDataFrame(before, f"{group} string, bucket_ int, before_ long")), [group, "bucket_"])
        return b.withColumn(out, F.col("before_") + rank).drop("bucket_", "before_")
    return b.withColumn(out, rank).drop("bucket_")


def _p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation under Student's t with n - 2 degrees, by the incomplete beta function."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    if r == 0:
        return 1.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for k in range(1, 400):
            for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


p_value = F.udf(lambda r, n: _p_value(r, n), T.DoubleType())  # called once per feature


def target_correlations(df: DataFrame, columns: list[str], target: str, least: int = 100) -> DataFrame:
    """Pearson and Spearman of each column with the target over known pairs, with Spearman's p."""
    m = melted(df.filter(F.col(target).isNotNull()), columns, (target,)).filter(F.col("value").isNotNull())
    both = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()).alias(c) for c in columns)).first()
    sizes = {c: both[c] for c in columns if both[c]}
    m = average_ranks(average_ranks(m, "feature", "value", "rx_", sizes=sizes), "feature", target, "ry_", sizes=sizes)
    s = m.groupBy("feature").agg(
        F.count("*").alias("n"), _safe_corr(F.col("value"), F.col(target)).alias("pearson"), _safe_corr(F.col("rx_"), F.col("ry_")).alias("spearman")
    )
    s = s.filter(F.col("n") >= least)
    return s.withColumn("p_value", p_value("spearman", F.col("n").cast("int")))


def group_summary(correlations: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean |Spearman| and the best column of each keyword group; a column can be in several."""
    named = F.array(*(F.struct(F.lit(g).alias("group"), F.col("feature").rlike("|".join(words)).alias("in_")) for g, words in groups.items()))
    d = correlations.select("feature", F.abs("spearman").alias("rho"), F.inline(named)).filter("in_ and rho is not null")
    return d.groupBy("group").agg(
        F.count("*").alias("n_features"), F.avg("rho").alias("mean_abs_rho"), F.max_by("feature", F.struct("rho", "feature")).alias("best_feature")
    )


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Rows, keys and rows beyond the first of a key."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_duplicates"))
