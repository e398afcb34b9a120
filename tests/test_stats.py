"""Ranks, quantiles and equity cut into ranges and blocks give what one sorted whole gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import cleaning as K
from tidemark.operators import stats as S


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(f, float(rng.choice((rng.randint(0, 20), rng.gauss(0, 9))))) for f in ("a", "b") for _ in range(rng.randint(300, 700))] + [("c", 1.0)] * 50
    return rows, spark.createDataFrame(rows, "feature string, value double").repartition(5)


def test_exact_quantiles_in_two_passes(spark, values, monkeypatch):
    rows, _ = values
    shares = (0.0, 0.01, 0.5, 0.77, 0.99, 1.0)
    cols = {f: [v for g, v in rows if g == f] for f in ("a", "b", "c")} | {"none": [], "nan": [math.nan, 1.0, 2.0]}
    n = max(map(len, cols.values()))
    d = spark.createDataFrame([tuple(c[i] if i < len(c) else None for c in cols.values()) for i in range(n)], ", ".join(f"{c} double" for c in cols)).repartition(5)
    for accuracy in (10_000, 50):  # coarse brackets hold many values
        monkeypatch.setattr(S, "ACCURACY", accuracy)
        s = S.wide_stats(d, list(cols), shares)
        got, far = S.exact_quantiles(d, list(cols), shares, s, {"a": d["a"] > 5})
        for f, x in cols.items():
            x = sorted(v for v in x if not math.isnan(v))
            at = [(len(x) - 1) * p for p in shares]
            want = [x[math.floor(k)] * (1 - k % 1) + x[math.ceil(k)] * (k % 1) for k in at] if x else [None] * 6
            assert got[f] == pytest.approx(want) and s[f]["n"] == len(x)
        assert far == {"a": sum(v > 5 for v in cols["a"])}
    wrong = {c: x | {"brackets": [(1e9, 2e9)] * 6} for c, x in s.items()}  # a bracket without its quantile is widened
    assert S.exact_quantiles(d, list(cols), shares, wrong)[0] == got


def test_distribution_of_odd_columns(spark):
    rows = [(float(i % 10), 7.0, None) for i in range(200)] + [(1000.0, 7.0, None)]
    d = spark.createDataFrame(rows, "x double, same double, empty double")
    got = {r["feature"]: r for r in S.distribution(d, ["x", "same", "empty"]).collect()}
    assert set(got) == {"x", "same"} and got["x"]["n_outliers"] == 1 and got["same"]["n_outliers"] == 0
    assert got["same"]["skew"] is None and got["same"]["std"] == pytest.approx(0) and got["x"]["p99"] == 9.0
    assert S.distribution(d.limit(0), ["x"]).count() == 0


def test_buckets_by_halving(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 40):
        cuts = sorted(rng.sample(range(100), n))
        d = spark.range(100).select(F.col("id").cast("double").alias("v"), F.array(*map(F.lit, map(float, cuts))).alias("c"))
        got = [r[0] for r in d.select(S._bucket_of(F.col("v"), F.col("c"), n + 1)).collect()]
        assert got == [sum(c < v for c in cuts) for v in range(100)]


def test_ranks_by_ranges(values):
    rows, m = values
    got = sorted(map(tuple, S.average_ranks(m, "feature", "value", "r", 40).collect()))
    assert got == sorted(map(tuple, S.average_ranks(m, "feature", "value", "r").collect())) and len(got) == len(rows)
    x = [v for g, v in rows if g == "a"]
    for f, v, r in got[:50]:
        assert r == sum(y < v for y in x) + (x.count(v) + 1) / 2


def test_correlations_of_many_columns(spark):
    rng = random.Random(1)
    rows = [tuple(None if rng.random() < 0.1 else 5e6 + rng.gauss(0, 1) for _ in range(30)) + (7.0,) for _ in range(200)]
    names = [f"x{i}" for i in range(31)]
    got = {(r["a"], r["b"]): r["corr"] for r in S.correlation_pairs(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4), names).collect()}
    assert len(got) == 31 * 30 // 2 and all(got[n, "x30"] is None for n in names[:30])
    for i, j in ((0, 1), (3, 17), (28, 29)):
        p = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        mx, my = (sum(c) / len(p) for c in zip(*p))
        want = sum((a - mx) * (b - my) for a, b in p) / math.sqrt(sum((a - mx) ** 2 for a, _ in p) * sum((b - my) ** 2 for _, b in p))
        assert got[names[i], names[j]] == pytest.approx(want, abs=1e-6)


def test_equity_by_blocks(spark):
    rng = random.Random(2)
    rows = [(k, t * 1000, rng.uniform(-0.1, 0.11)) for k in ("x", "y") for t in range(400) if rng.random() < 0.8]
    d = spark.createDataFrame(rows, "symbol string, open_time long, ret double").repartition(3)
    key = lambda r: (r["symbol"], r["open_time"])
    small, large = (sorted(B.equity(d, ["symbol"], ["open_time"], block_ms=w).collect(), key=key) for w in (7000, 10**9))
    level, top = {}, {}
    for a, b in zip(small, large):
        level[a["symbol"]] = level.get(a["symbol"], 0.0) + math.log(1 + a["ret"])
        top[a["symbol"]] = max(top.get(a["symbol"], -9e9), level[a["symbol"]])
        want = (level[a["symbol"]], math.exp(level[a["symbol"]] - top[a["symbol"]]) - 1)
        assert (a["log_equity"], a["drawdown"]) == pytest.approx(want) and (b["log_equity"], b["drawdown"]) == pytest.approx(want)


def test_whole_cleaning(spark):
    inf = float("inf")
    rows = [("s", t, 100.0 + t, float(t), None if t % 9 == 0 else float(t % 7), inf if t == 5 else None if t < 3 else 0.001 * t, None, None if t == 4 else 1.0 * t) for t in range(120)]
    names = "symbol string, open_time long, close double, return_1h double, rsi_14 double, funding_rate double, delta_norm double, ema_8 double"
    d = spark.createDataFrame(rows + rows[:10], names).repartition(3)
    columns = ["return_1h", "rsi_14", "funding_rate", "delta_norm", "ema_8"]
    stats = K.fitted(K.fit(d.filter("open_time < 80").dropDuplicates(["open_time"]), columns))
    got = {r["open_time"]: r for r in K.cleaned(d, stats, columns, correlated=("ema_8",)).collect()}
    assert len(got) == 120 and got[0].asDict().keys() == {"symbol", "open_time", "return_1h", "rsi_14", "funding_rate", "delta_norm"}
    lo, hi = stats["return_1h"]["clip_lo"], stats["return_1h"]["clip_hi"]
    assert (lo, hi) == pytest.approx((0.79, 78.21)) and got[0]["return_1h"] == lo and got[119]["return_1h"] == hi
    assert got[9]["rsi_14"] == 50.0 and got[7]["delta_norm"] == 0.0
    assert got[5]["funding_rate"] == got[4]["funding_rate"] and got[1]["funding_rate"] == stats["funding_rate"]["train_median"]
    e = {r["feature"]: r for r in K.effects(d, stats, columns).collect()}
    assert e["funding_rate"]["n_infinite"] == 2 and e["delta_norm"]["n_filled"] == 130
    b = K.within_bounds(K.cleaned(d, stats, columns), stats).filter("n_outside > 0 or n_null > 0")
    assert b.count() == 0
    assert S.to_drop(spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.97), ("a", "c", 0.1)], "a string, b string, corr double"), ["a", "b", "c"]) == ["b"]
