"""Window helpers with the engine's null rules.

A rolling value needs a full frame of non-null rows. Flags are 0 where a comparison has a null,
except the divergence flags, where it makes them 1. Denominators of zero give null, as ANSI
arithmetic would fail on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "open_time") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg: Callable[[Column], Column], x: str | Column, w: WindowSpec, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), Window.currentRow)
    return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))


def mean(x: str | Column, w: WindowSpec, n: int) -> Column:
    return rolling(F.avg, x, w, n)


def std(x: str | Column, w: WindowSpec, n: int) -> Column:
    return rolling(F.stddev_samp, x, w, n)


def total(x: str | Column, w: WindowSpec, n: int) -> Column:
    return rolling(F.sum, x, w, n)


def ratio(a: str | Column, b: str | Column) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def zscore(x: str | Column, w: WindowSpec, n: int) -> Column:
    return ratio(col(x) - mean(x, w, n), std(x, w, n))


def diff(x: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return col(x) - F.lag(col(x), n).over(w)


def change(x: str | Column, w: WindowSpec, n: int) -> Column:
    """The simple return over n rows."""
    return ratio(x, F.lag(col(x), n).over(w)) - 1


def log_change(x: str | Column, w: WindowSpec, n: int) -> Column:
    before = F.lag(col(x), n).over(w)
    return F.when((col(x) > 0) & (before > 0), F.ln(col(x) / before))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def differs(a: Column, b: Column) -> Column:
    """1 where a and b differ or either is null."""
    return F.coalesce(a != b, F.lit(True)).cast("int")


def ffill(x: str | Column, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running(agg: Callable[[Column], Column], x: str | Column, w: WindowSpec) -> Column:
    return agg(col(x)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def scan(df: DataFrame, keys: list[str], order: str, decay: Column, gains: dict[str, Column]) -> DataFrame:
    """Adds, for each name in `gains`, y of the recurrence y = decay * y_before + gain along each series.

    `decay` is in (0, 1], gains aren't null. With L the running sum of -ln(decay), a block is a span
    of 40 in L: inside it y is a prefix sum of gain * exp(L) times exp(-L), both relative to the
    block's start so that nothing overflows, and the block before hands on its last value. What
    lies further back has decayed by more than exp(-40), below the precision of a double. All
    recurrences of one decay share their windows.
    """
    span, names, own = 40.0, list(gains), df.columns
    w = Window.partitionBy(*keys).orderBy(order)
    running_ = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = Window.partitionBy(*keys, "b_").orderBy(order)
    inside = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.partitionBy(*keys).orderBy("b_").rangeBetween(Window.unboundedPreceding, -1)
    g, y = [F.col(f"g{i}_") for i in range(len(names))], [F.col(f"y{i}_") for i in range(len(names))]
    d = df.select("*", F.sum(-F.ln(decay)).over(running_).alias("t_"), *(gains[n].alias(f"g{i}_") for i, n in enumerate(names)))
    d = d.select(*own, *g, F.floor(F.col("t_") / span).alias("b_"), (F.col("t_") - F.floor(F.col("t_") / span) * span).alias("l_"))
    d = d.select(*own, "b_", "l_", *((F.sum(x * F.exp("l_")).over(inside) * F.exp(-F.col("l_"))).alias(f"y{i}_") for i, x in enumerate(g)))
    d = d.select("*", F.last(F.struct("b_", "l_", *y)).over(whole).alias("e_"))
    d = d.select("*", F.last("e_").over(earlier).alias("c_"))
    passed = (F.col("b_") - F.col("c_.b_")) * span + F.col("l_") - F.col("c_.l_")
    carried = [F.coalesce(F.col(f"c_.y{i}_") * F.exp(-passed), F.lit(0.0)) for i in range(len(names))]
    return d.select(*own, *((a + b).alias(n) for a, b, n in zip(y, carried, names)))


def ewm(
    df: DataFrame, keys: list[str], order: str, x: str | list[str], alpha: float, out: str | list[str], adjust: bool = False, min_periods: int = 1
) -> DataFrame:
    """Adds the exponentially weighted mean of x; weights go on decaying over nulls, where the mean is carried.

    adjust=True divides the weighted sum by the sum of weights; several columns then share one
    scan. adjust=False mixes each value into the mean with alpha, against a weight that has decayed
    once for each row since the last value.
    """
    xs, outs = ([x], [out]) if isinstance(x, str) else (x, out)
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own, keep = df.columns, 1.0 - alpha
    enough = lambda i, y: F.when(F.col(f"n{i}_") >= min_periods, y)
    if adjust:
        gains = {f"s{i}_": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(xs)}
        gains |= {f"w{i}_": F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for i, c in enumerate(xs)}
        d = df.select("*", *(F.count(c).over(upto).alias(f"n{i}_") for i, c in enumerate(xs)))
        d = scan(d, keys, order, F.lit(keep), gains)
        return d.select(*own, *(enough(i, F.col(f"s{i}_") / F.nullif(f"w{i}_", F.lit(0.0))).alias(o) for i, o in enumerate(outs)))
    d = df
    for c, o in zip(xs, outs):
        has, kept = F.col(c).isNotNull(), d.columns
        d = d.select("*", F.count(c).over(upto).alias("n0_"), F.row_number().over(w).alias("p_"))
        d = d.select("*", F.last(F.when(has, F.col("p_")), ignorenulls=True).over(before).alias("q_"))
        old = F.pow(F.lit(keep), F.col("p_") - F.col("q_"))
        decay = F.when(has & F.col("q_").isNotNull(), old / (old + alpha)).otherwise(1.0)
        gain = F.when(has, F.when(F.col("q_").isNull(), F.col(c)).otherwise(F.col(c) * alpha / (old + alpha))).otherwise(0.0)
        d = scan(d, keys, order, decay, {"s0_": gain.cast("double")})
        d = d.select(*kept, enough(0, F.col("s0_")).alias(o))
    return d
