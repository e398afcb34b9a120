"""Labels, splits, trading rules and their metrics.

Equity is kept as a running sum of logarithms, so that long histories neither overflow nor vanish;
drawdown is against the running maximum, in which the starting capital isn't counted.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W

#: Barriers, costs, and the levels of the sweeps. The number of bars is a choice of ours.
UPPER, LOWER, FEE, SLIPPAGE = 0.004, 0.002, 0.001, 0.0003
MAX_BARS = 4
THRESHOLDS = (0.48, 0.50, 0.52, 0.55, 0.58, 0.60, 0.65)
SLIPPAGES = (0.0, 0.0001, 0.0002, 0.0003, 0.0005, 0.0008, 0.001, 0.0015, 0.002)


#: Children of a node in the search for touches.
FAN = 64


def first_touch(df: DataFrame, upper: float = UPPER, lower: float = LOWER, max_bars: int | None = None, key: str = "symbol", levels: int = 4) -> DataFrame:
    """Adds touch_bars (bars until a barrier is reached, null if none is) and tb_direction, as `barrier_label` defines it, at any horizon.

    Bars are leaves of a tree whose nodes know the least low and the greatest high of their `FAN`
    children. Each bar looks among its later siblings, then among those of its parent and so on, and
    walks down to the first bar that touches: a join a level, however far the horizon. With
    `max_bars` None it is the series' end, up to `FAN` ** `levels` bars of a series.
    """
    w = W.series(key)
    if max_bars is not None:
        levels = min(levels, 1 + ceil(log(max(2, max_bars), FAN)))
    bars = df.withColumn("i_", F.row_number().over(w) - 1)
    node = lambda c: F.floor(F.col(c) / FAN)
    kids = bars.select(key, F.col("i_").alias("j"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    tree = []
    for _ in range(levels):
        grouped = kids.groupBy(F.col(key).alias("key_"), node("j").alias("node_")).agg(F.array_sort(F.collect_list(F.struct("j", "lo", "hi"))).alias("kids_"))
        tree.append(grouped)
        kids = grouped.select(F.col("key_").alias(key), F.col("node_").alias("j"), F.array_min("kids_.lo").alias("lo"), F.array_max("kids_.hi").alias("hi"))
    c = F.col("close")
    q = bars.select(key, "i_", (c * (1 - lower)).alias("down_"), (c * (1 + upper)).alias("up_"), F.col("i_").alias("at_")).filter("down_ IS NOT NULL")
    q = q.select("*", F.lit(None).cast("struct<j: bigint, lo: double, hi: double>").alias("hit_"), F.lit(0).alias("found_"))
    touches = lambda k: F.coalesce(k.lo <= F.col("down_"), F.lit(False)) | F.coalesce(k.hi >= F.col("up_"), F.lit(False))
    plain = lambda k: F.struct(k.j.cast("bigint").alias("j"), k.lo.cast("double").alias("lo"), k.hi.cast("double").alias("hi"))
    first = lambda after: F.get(F.transform(F.filter("kids_", lambda k: touches(k) & (k.j > after)), plain), F.lit(0))
    for k, nodes in enumerate(tree, 1):  # up, until a later sibling holds a touch
        wanted = F.when(F.col("found_") == 0, node("at_"))
        q = q.withColumn("want_", wanted).join(nodes, (F.col(key) == F.col("key_")) & (F.col("want_") == F.col("node_")), "left")
        hit = first(F.col("at_"))
        now = (F.col("found_") == 0) & hit.isNotNull()
        # under other names first, as Spark takes an alias of the same list for the column inside a lambda
        told = q.select(key, "i_", "down_", "up_", node("at_").alias("at2_"), F.when(now, hit).otherwise(F.col("hit_")).alias("hit2_"), F.when(now, k).otherwise(F.col("found_")).alias("found2_"))
        q = told.toDF(key, "i_", "down_", "up_", "at_", "hit_", "found_")
    for k in range(levels - 1, 0, -1):  # and down again to the bar
        wanted = F.when(F.col("found_") > k, F.col("hit_.j"))
        q = q.withColumn("want_", wanted).join(tree[k - 1], (F.col(key) == F.col("key_")) & (F.col("want_") == F.col("node_")), "left")
        q = q.select(key, "i_", "down_", "up_", F.when(F.col("found_") > k, first(F.lit(-1))).otherwise(F.col("hit_")).alias("hit_"), "found_")
    far = F.col("hit_.j") - F.col("i_")
    near = far.isNotNull() if max_bars is None else far <= max_bars
    q = q.filter(near).select(F.col(key).alias("key_"), F.col("i_").alias("bar_"), far.alias("touch_bars"), F.when(F.col("hit_.lo") <= F.col("down_"), -1).otherwise(1).alias("side_"))
    later = F.count("close").over(w.rowsBetween(1, max_bars if max_bars is not None else Window.unboundedFollowing))
    out = bars.withColumn("later_", later).join(q, (F.col(key) == F.col("key_")) & (F.col("i_") == F.col("bar_")), "left")
    label = F.when(c.isNotNull() & (F.col("later_") > 0), F.coalesce("side_", F.lit(0)))
    return out.select(*df.columns, F.when(label.isNotNull(), F.col("touch_bars")).alias("touch_bars"), label.alias("tb_direction"))


def barrier_label(df: DataFrame, upper: float = UPPER, lower: float = LOWER, max_bars: int = MAX_BARS, key: str = "symbol") -> DataFrame:
    """Adds tb_direction: 1 if the next `max_bars` rows reach the upper barrier first, -1 the lower, 0 neither.

    A bar that reaches both counts as the lower. Null without a close or any later bar.
    """
    w = W.series(key)
    up, down = F.col("close") * (1 + upper), F.col("close") * (1 - lower)
    label = F.lit(0)
    for k in range(max_bars, 0, -1):  # the nearest bar decides, so it is the outermost condition
        hit_up = F.coalesce(F.lead("high", k).over(w) >= up, F.lit(False))
        hit_down = F.coalesce(F.lead("low", k).over(w) <= down, F.lit(False))
        label = F.when(hit_down, -1).when(hit_up, 1).otherwise(label)
    later = F.count("close").over(w.rowsBetween(1, max_bars))
    return df.withColumn("tb_direction", F.when(F.col("close").isNotNull() & (later > 0), label))


def regimes(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Adds sma50, sma200 and regime; unknown until the long mean is full."""
    w = W.series(key)
    d = df.withColumns({"sma50": W.mean("close", w, 50), "sma200": W.mean("close", w, 200)})
    c, s, l = F.col("close"), F.col("sma50"), F.col("sma200")
    regime = F.when(l.isNull(), "unknown").when((c > s) & (s > l), "bull").when((c < s) & (s < l), "bear").otherwise("sideways")
    return d.withColumn("regime", regime)


def time_split(df: DataFrame, train: int = 70, validation: int = 10, key: str = "symbol", legacy_float: bool = False) -> DataFrame:
    """Adds split by position: `train` and `validation` percent (rounded down), the rest test.

    `legacy_float` cuts at int(n * (a + b)) in binary floating point, which can be one row less.
    """
    w = W.series(key)
    n = F.count("*").over(Window.partitionBy(key))
    a, b = F.floor(n * train / 100), F.floor(n * (train + validation) / 100)
    if legacy_float:
        a, b = F.floor(n * F.lit(train / 100)), F.floor(n * F.lit(train / 100 + validation / 100))
    i = F.row_number().over(w)
    return df.withColumn("split", F.when(i <= a, "train").when(i <= b, "validation").otherwise("test"))


def require_split(df: DataFrame, train: int = 100, validation: int = 50, test: int = 50) -> None:
    """Fails if a part of the split is too small."""
    have = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    for part, least in (("train", train), ("validation", validation), ("test", test)):
        if have.get(part, 0) < least:
            raise ValueError(f"{have.get(part, 0)} {part} rows, {least} are needed")


def folds(n: int, k: int, min_block: int = 100) -> list[tuple[int, int, int]]:
    """(train_end, test_start, test_end) of expanding folds over n ordered rows, the last to the end; [] if too small."""
    block = n // (k + 1) if k >= 2 else 0
    if block < max(1, min_block):
        return []
    ends = [*(block * (i + 2) for i in range(k - 1)), n]
    return [(block * (i + 1), block * (i + 1), end) for i, end in enumerate(ends)]


def fold_table(df: DataFrame, k: int = 5, min_block: int = 100, key: str = "symbol") -> DataFrame:
    """Each series' folds as rows: fold, train_end, test_start, test_end (row positions from 0, ends excluded)."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    block = F.floor(F.col("n") / (k + 1))
    d = n.withColumn("block", block).filter(F.col("block") >= max(1, min_block)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("block") * (F.col("fold") + 1)
    end = F.when(F.col("fold") == k - 1, F.col("n")).otherwise(start + F.col("block"))
    out = d.select(key, "fold", start.alias("train_end"), start.alias("test_start"), end.alias("test_end"))
    return out if k >= 2 else out.limit(0)


def win_return(direction: str, upper: float = UPPER, lower: float = LOWER) -> tuple[float, float]:
    """Gross return of a trade that wins and of one that loses."""
    return (upper, -lower) if direction == "long" else (lower, -upper)


def break_even(direction: str, upper: float = UPPER, lower: float = LOWER, fee: float = FEE, slippage: float = SLIPPAGE) -> float:
    """The win rate at which costs eat all."""
    _, loss = win_return(direction, upper, lower)
    return (fee + slippage - loss) / (upper + lower)


def trades(
    df: DataFrame, threshold: float = 0.55, direction: str = "long", upper: float = UPPER, lower: float = LOWER, fee: float = FEE,
    slippage: float | Column = SLIPPAGE,
) -> DataFrame:
    """Rows a rule trades (pred is its side, proba reaches the threshold, the label isn't flat) with win and ret."""
    side = 1 if direction == "long" else -1
    t = df.filter((F.col("tb_direction") != 0) & (F.col("pred") == side) & (F.col("proba") >= threshold))
    gain, loss = win_return(direction, upper, lower)
    win = F.col("tb_direction") == side
    cost = F.lit(fee) + (slippage if isinstance(slippage, Column) else F.lit(slippage))
    return t.withColumn("win", win).withColumn("ret", F.when(win, gain).otherwise(loss) - cost)


#: Width of a block of equity: what one task sums in order.
BLOCK_MS = 30 * 86_400_000


def equity(df: DataFrame, keys: list[str], order: list[str], ret: str = "ret", block_ms: int = BLOCK_MS) -> DataFrame:
    """Adds log_equity, the running sum of ln(1 + ret), and drawdown, equity over its running maximum less 1.

    Sums and maxima run inside blocks of time; a block's sum and highest point, of which there is a
    row a block, are carried to the blocks after it. `order` begins with the time.
    """
    d = df.withColumn("block_", F.floor(F.col(order[0]) / block_ms))
    w = Window.partitionBy(*keys, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("sum_", F.sum(F.ln(1 + F.col(ret))).over(w)).withColumn("top_", F.max("sum_").over(w))
    blocks = d.groupBy(*keys, "block_").agg(F.sum(F.ln(1 + F.col(ret))).alias("all_"), F.max("sum_").alias("high_"))
    past = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base_", F.coalesce(F.sum("all_").over(past), F.lit(0.0)))
    blocks = blocks.select(*keys, "block_", "base_", F.max(F.col("base_") + F.col("high_")).over(past).alias("peak_"))
    d = d.join(blocks, [*keys, "block_"]).withColumn("log_equity", F.col("base_") + F.col("sum_"))
    highest = F.greatest(F.col("base_") + F.col("top_"), "peak_")
    d = d.withColumn("drawdown", F.exp(F.col("log_equity") - highest) - 1)
    return d.select(*df.columns, "log_equity", "drawdown")


def metric_columns(ret: str = "ret") -> list[Column]:
    r = F.col(ret)
    gains, losses = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return [
        F.count(r).alias("n_trades"), F.count_if(r > 0).alias("n_wins"), (F.count_if(r > 0) / F.nullif(F.count(r), F.lit(0))).alias("win_rate"),
        F.avg(r).alias("avg_ret"), F.sum(r).alias("total_ret"), F.min("drawdown").alias("max_drawdown"), (gains / F.nullif(losses, F.lit(0.0))).alias("profit_factor"),
    ]


def metrics(taken: DataFrame, keys: list[str], order: list[str], series: list[str] | None = None, ret: str = "ret") -> DataFrame:
    """Trades, wins, returns, drawdown and profit factor (null without losses) of each group."""
    return equity(taken, keys, order, ret).groupBy(*keys).agg(*metric_columns(ret))


def over_values(df: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    """Each row once for each value of a sweep: all values are then one grouped aggregation."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, least: int = 5, **kw) -> DataFrame:
    """Metrics by threshold, up to the first with fewer than `least` trades, which goes with all beyond."""
    swept = over_values(df, "threshold", thresholds)
    taken = trades(swept.filter(F.col("proba") >= F.col("threshold")), 0.0, **kw)
    m = metrics(taken, ["threshold"], ["open_time", "symbol"])
    every = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    full = every.join(m, "threshold", "left").withColumn("enough", F.coalesce(F.col("n_trades") >= least, F.lit(False)))
    w = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per threshold
    return full.withColumn("enough", F.min("enough").over(w)).filter("enough").drop("enough")


def slippage_sweep(df: DataFrame, slippages: tuple[float, ...] = SLIPPAGES, **kw) -> DataFrame:
    """Metrics by slippage, with the first level that loses money on each row."""
    swept = over_values(df, "slippage", slippages)
    m = metrics(trades(swept, slippage=F.col("slippage"), **kw), ["slippage"], ["open_time", "symbol"])
    return m.withColumn("first_unprofitable", F.min(F.when(F.col("avg_ret") <= 0, F.col("slippage"))).over(Window.partitionBy(F.lit(1))))


def kelly(p: float, ratio: float) -> float:
    """The Kelly fraction, within [0, 1]."""
    return min(1.0, max(0.0, (p * ratio - (1 - p)) / ratio))


def sized(taken: DataFrame, threshold: float, p: float = 0.60, ratio: float = UPPER / LOWER) -> DataFrame:
    """Each trade under each sizing: the fraction of the capital and its return on all of it."""
    f = kelly(p, ratio)
    sizes = F.array(*(F.struct(F.lit(n).alias("sizing"), F.lit(x).alias("fixed")) for n, x in (("flat", 1.0), ("kelly", f), ("half_kelly", f / 2), ("meta_prob", None))))
    span = F.least(F.greatest((F.col("proba") - threshold) / max(1 - threshold, 1e-12), F.lit(0.0)), F.lit(1.0))
    d = taken.withColumn("s_", F.explode(sizes))
    d = d.withColumns({"sizing": F.col("s_.sizing"), "fraction": F.coalesce(F.col("s_.fixed").cast("double"), 0.25 + 0.75 * span)}).drop("s_")
    return d.withColumn("sized_ret", F.col("fraction") * F.col("ret"))


def classification_metrics(df: DataFrame, truth: str, pred: str, *keys: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of 0/1 columns; 0 where a denominator is."""
    t, p = F.col(truth), F.col(pred)
    m = df.groupBy(*keys).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return m.select(
        *keys, "tp", "fp", "fn", "tn", part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"),
        part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def regression_metrics(df: DataFrame, truth: str, pred: str, *keys: str) -> DataFrame:
    """MAE, RMSE, R2 and the share of equal signs."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    m = df.filter(t.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.sqrt(F.avg(F.pow(t - p, F.lit(2)))).alias("rmse"),
        F.avg(F.pow(t - p, F.lit(2))).alias("mse_"), F.var_pop(t).alias("var_"), F.avg((F.signum(t) == F.signum(p)).cast("double")).alias("directional_accuracy"),
    )
    return m.withColumn("r2", 1 - F.col("mse_") / F.nullif("var_", F.lit(0.0))).drop("mse_", "var_")


def random_slippage(*keys: str, mean: float = SLIPPAGE, seed: int = 42) -> Column:
    """Slippage of each trade, uniform from 0 to twice the mean by a hash of the seed and the row's keys."""
    word = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary")), 1, 8)
    return F.conv(word, 16, 10).cast("double") / 2**32 * (2 * mean)


def downsample(df: DataFrame, points: int = 50, key: str = "symbol", time: str = "open_time") -> DataFrame:
    """Every n-th row of each series, n such that about `points` are left; series that are shorter stay whole."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(key)) / points))
    return df.withColumns({"i_": i, "step_": step}).filter(F.col("i_") % F.col("step_") == 0).drop("i_", "step_")
