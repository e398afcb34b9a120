"""Null rules, recurrences, gaps and folds against pandas and hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import backtest as B
from tidemark.operators import candles as C
from tidemark.operators import cleaning as K
from tidemark.operators import features as X
from tidemark.operators import joins as J
from tidemark.operators import positions as P
from tidemark.operators import stats as S

H = C.HOUR_MS


def series(n=400, seed=1, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [None if rng.random() < gaps else float(v) for v in x]


def frame(spark, values, name="close", symbol="a"):
    return spark.createDataFrame([(symbol, i * H, v) for i, v in enumerate(values)], f"symbol string, open_time long, {name} double")


@pytest.mark.parametrize("alpha", [2 / 9, 2 / 201, 1 / 14, 0.5])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_equals_pandas_over_gaps(spark, alpha, adjust):
    v = [None, None, *series()]
    got = W.ewm(frame(spark, v), ["symbol"], "open_time", "close", alpha, "y", adjust, 5).orderBy("open_time").toPandas()["y"]
    want = pd.Series(v, dtype=float).ewm(alpha=alpha, adjust=adjust, min_periods=5).mean()
    assert (got.isna() == want.isna()).all()
    np.testing.assert_allclose(got.dropna(), want.dropna(), rtol=1e-11)


def test_ewm_known_values(spark):
    for adjust, want in ((False, 7 / 3), (True, 2.6)):
        d = W.ewm(frame(spark, [1.0, None, 3.0]), ["symbol"], "open_time", "close", 0.5, "y", adjust)
        assert d.orderBy("open_time").toPandas()["y"].iloc[-1] == pytest.approx(want)


def test_rolling_needs_a_full_frame_and_sample_std(spark):
    v = series(60)
    d = frame(spark, v)
    w = W.series("symbol")
    got = d.select("open_time", W.mean("close", w, 5).alias("m"), W.std("close", w, 5).alias("s")).orderBy("open_time").toPandas()
    r = pd.Series(v, dtype=float).rolling(5)
    for c, want in (("m", r.mean()), ("s", r.std())):
        assert (got[c].isna() == want.isna()).all()
        np.testing.assert_allclose(got[c].dropna(), want.dropna(), rtol=1e-9)


def test_returns_and_targets_are_null_across_gaps(spark):
    rows = [("a", i * H, 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1.0, 1) for i in range(12) if i not in (5, 6)]
    c = spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double, trade_count int")
    d = X.with_target(X.with_returns(C.on_grid(c))).orderBy("open_time").collect()
    assert len(d) == 12 and [r["is_real"] for r in d].count(False) == 2
    assert d[7]["return_1h"] is None and d[1]["target_return_4h"] is None
    assert d[3]["target_return_4h"] == pytest.approx(17 / 13 - 1)


def test_rsi_definitions_on_flat_prices(spark):
    d = frame(spark, [5.0] * 40)
    assert X.with_rsi(d, 14).filter("rsi_14 is not null").count() == 0
    assert X.wilder_rsi_latest(d).first()["rsi"] == 100.0
    assert X.wilder_rsi_latest(frame(spark, [1.0] * 14)).first()["rsi"] is None


def test_wilder_rsi_equals_its_definition(spark):
    v = series(200, gaps=0)
    g = [max(b - a, 0) for a, b in zip(v, v[1:])]
    l = [max(a - b, 0) for a, b in zip(v, v[1:])]
    up, down = sum(g[:14]) / 14, sum(l[:14]) / 14
    for a, b in zip(g[14:], l[14:]):
        up, down = (up * 13 + a) / 14, (down * 13 + b) / 14
    assert X.wilder_rsi_latest(frame(spark, v)).first()["rsi"] == round(100 - 100 / (1 + up / down), 2)


def test_sanity_quarantine(spark):
    rows = [("a", 0, 1.0, 2.0, 0.5, 1.5, 1.0), ("a", H, 1.0, 0.4, 0.5, 1.5, 1.0), ("a", 2 * H, 1.0, 2.0, 0.0, 1.5, 1.0), ("a", 3 * H, 1.0, 2.0, 0.5, 1.5, -1.0)]
    c = spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double")
    assert C.sanity_report(c).first()["rows_quarantined"] == 3
    assert C.quarantined(c).filter("close is null and volume is null").count() == 3


def test_value_area_ties_go_up_and_edges_hold(spark):
    p = spark.createDataFrame([("a", 0, lv, v) for lv, v in ((1.0, 10.0), (2.0, 10.0), (3.0, 30.0), (4.0, 10.0), (5.0, 10.0))], "symbol string, open_time long, level double, vol double")
    r = C.value_area(p).first()
    assert (r["poc_price"], r["vah"], r["val"]) == (3.0, 5.0, 3.0)
    one = spark.createDataFrame([("a", 0, 1.0, 10.0), ("a", 0, 2.0, 1.0)], p.schema)
    assert C.value_area(one).first()[2:] == (1.0, 1.0, 1.0)


def test_divergence_is_one_where_unknown(spark):
    d = frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).withColumn("cvd", F.col("close"))
    got = d.select(X.divergence("cvd", "close", W.series("symbol")).alias("x")).toPandas()["x"].tolist()
    assert got == [1, 1, 1, 1, 0, 0]


def test_asof_keeps_every_left_row(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, 7.0, 1), (1, 5, 8.0, 1), (1, 5, 9.0, 2)], "k int, s int, v double, n int")
    got = sorted(map(tuple, J.asof_join(a, b, ["k"], "t", "s", ["v"], "n").collect()), key=str)
    assert got == [(1, 1, None, None), (1, 5, 5, 9.0), (1, 5, 5, 9.0), (2, 9, None, None)]


def test_folds_expand_and_cover():
    f = B.folds(1000, 4)
    assert f == [(200, 200, 400), (400, 400, 600), (600, 600, 800), (800, 800, 1000)]
    assert B.folds(1003, 4)[-1][2] == 1003 and B.folds(300, 4) == [] and B.folds(1000, 1) == []


def test_split_by_whole_percent(spark):
    d = spark.range(1000).select(F.lit("a").alias("symbol"), F.col("id").alias("open_time"))
    n = {r["split"]: r["count"] for r in B.time_split(d).groupBy("split").count().collect()}
    assert n == {"train": 700, "validation": 100, "test": 200}
    legacy = {r["split"]: r["count"] for r in B.time_split(d, legacy_float=True).groupBy("split").count().collect()}
    assert legacy["test"] == 1000 - int(1000 * (0.70 + 0.10))
    B.require_split(B.time_split(d))
    with pytest.raises(ValueError):
        B.require_split(B.time_split(d.limit(100)))


def test_barrier_label_prefers_the_stop(spark):
    rows = [("a", 0, 100.0, 100.0, 100.0), ("a", H, 101.0, 99.0, 100.0), ("a", 2 * H, 101.0, 99.9, 100.0), ("a", 3 * H, 100.1, 99.9, 100.0)]
    d = spark.createDataFrame(rows, "symbol string, open_time long, high double, low double, close double")
    assert [r["tb_direction"] for r in B.barrier_label(d).orderBy("open_time").collect()] == [-1, 1, 0, None]


def test_fit_uses_training_rows_only_and_clips_test_rows(spark):
    d = frame(spark, [float(i % 100) for i in range(1000)] + [1e6] * 10, "x")
    stats = K.fitted(K.fit(d.filter(F.col("open_time") < 1000 * H), ["x"]))
    assert stats["x"]["clip_hi"] < 100
    assert K.apply(d, stats, ["x"]).agg(F.max("x")).first()[0] == stats["x"]["clip_hi"]
    bad = frame(spark, [math.inf, math.nan, None, 5.0], "x")
    assert [r["x"] for r in K.apply(bad, stats, ["x"]).orderBy("open_time").collect()] == [stats["x"]["train_median"]] * 3 + [5.0]


def test_only_correlated_training_pairs_go(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500), rng.normal(size=500)
    d = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": 2 * a + 1, "k": np.ones(500)}))
    pairs = S.correlation_pairs(d, ["a", "b", "c", "k"])
    assert S.to_drop(pairs, ["a", "b", "c", "k"]) == ["c"]
    assert pairs.filter("corr is null").count() == 3


def test_p_values():
    assert S._p_value(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    assert S._p_value(0.0, 100) == pytest.approx(1.0) and S._p_value(None, 9) is None


def test_risk_rules():
    p = P.Position()
    day = P.DAY_MS
    assert [t[0] for t in p.step(0, 100.0, 20.0)] == ["BUY"]
    assert p.step(1, 100.5, 20.0) == []
    assert p.step(2, 97.9, None)[0][4] == "STOP_LOSS"
    for i in range(4):
        assert p.step(3 + i, 100.0, 20.0)[0][0] == "BUY"
        assert p.step(3 + i, 103.1, 50.0)[0][4] == "TAKE_PROFIT"
    assert p.step(9, 100.0, 20.0) == [] and p.step(day, 100.0, 20.0)[0][0] == "BUY"
    assert p.step(day + 1, None, 90.0) == [] and p.step(day + 2, 101.0, 80.0)[0][3] == pytest.approx(0.001)


def test_portfolio_walk():
    bars = [(100.0, 100.0, 100.0), (100.0, 100.5, 99.9), (100.0, 100.0, 100.0), (100.0, 100.0, 100.0)]
    w = P.Walk(0.004, 0.002, 2)
    got = [w.bar(*b, True, i == 3) for i, b in enumerate(bars)]
    assert got == [None, (100.0, pytest.approx(100.4), 1, "target"), None, (100.0, 100.0, 2, "time")]
    w = P.Walk(0.004, 0.002, 9)
    assert [w.bar(c, c, low, e, False) for c, low, e in ((math.nan, 1.0, True), (100.0, 100.0, True), (math.nan, math.nan, False), (99.0, 99.0, False))] == [None, None, None, (100.0, pytest.approx(99.8), 2, "stop")]


def test_folds_carry_their_state_over_batches(spark):
    rows = [(s, t * H, 100.0 + (t * 7 + k) % 11, 20.0 if t % 3 else 80.0) for k, s in enumerate(("a", "b", "c")) for t in range(300)]
    d = spark.createDataFrame(rows, "symbol string, open_time long, close double, rsi double").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for n in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got.append(sorted(map(str, P.risk_fold(d).collect())))
        p = P.portfolio(d.selectExpr("symbol", "open_time", "close", "close + 1 AS high", "close - 1 AS low", "rsi < 50 AS entry"), 0.02, 0.02, 4)
        got.append(sorted(map(str, p.collect())))
    assert got[0] == got[2] and got[1] == got[3] and len(got[1]) == 3 and len(got[0]) > 100
    assert P.risk_fold(d.limit(0)).count() == 0


def test_days_of_a_zone(spark):
    d = spark.createDataFrame([(0,), (4 * H,), (5 * H,), (24 * H,)], "t long")
    assert [r[0] for r in d.select(P.local_day("t")).collect()] == [0, 0, 0, 1]
    assert [r[0] for r in d.select(P.local_day("t", "America/New_York")).collect()] == [-1, -1, 0, 0]


def test_asof_by_blocks_gives_the_same(spark):
    rng = np.random.default_rng(4)
    a = spark.createDataFrame([(int(k) or None, int(t)) for k, t in rng.integers(0, [3, 500], (300, 2))], "k int, t int")
    b = spark.createDataFrame([(int(k) or None, int(t), i) for i, (k, t) in enumerate(rng.integers(0, [2, 500], (60, 2)))], "k int, s int, n int")
    whole, cut = (sorted(map(str, J.asof_join(a, b, ["k"], "t", "s", ["n"], "n", block=w).collect())) for w in (None, 40))
    assert whole == cut and len(cut) == 300


def test_threshold_sweep_stops_at_too_few(spark):
    rows = [("a", i * H, 1, 0.5 + (i % 10) / 100, 1 if i % 3 else -1) for i in range(40)]
    d = spark.createDataFrame(rows, "symbol string, open_time long, pred int, proba double, tb_direction int")
    got = [r["threshold"] for r in B.threshold_sweep(d).orderBy("threshold").collect()]
    assert got == [0.48, 0.50, 0.52, 0.55, 0.58]


def test_kelly_and_break_even():
    assert B.kelly(0.6, 2.0) == pytest.approx(0.4) and B.kelly(0.2, 2.0) == 0.0
    assert B.break_even("long", slippage=0) == pytest.approx(0.5) and B.break_even("short", slippage=0) == pytest.approx(5 / 6)


def test_first_touch_at_any_horizon(spark):
    import random

    rng = random.Random(12)
    rows = []
    for s, n in (("a", 700), ("b", 90), ("c", 1)):
        price = 100.0
        for t in range(n):
            price *= 1 + rng.gauss(0, 0.01)
            gap = s == "b" and t % 17 == 3
            rows.append((s, t * H, None if gap else price, None if gap else price * 1.003, None if gap else price * 0.997))
    d = spark.createDataFrame(rows, "symbol string, open_time long, close double, high double, low double").repartition(3)
    for bars, width in ((4, 0.01), (200, 0.08), (None, 0.15)):
        got = {(r["symbol"], r["open_time"]): (r["touch_bars"], r["tb_direction"]) for r in B.first_touch(d, width, width / 2, bars).collect()}
        for s in ("a", "b", "c"):
            own = [r for r in rows if r[0] == s]
            for i, r in enumerate(own):
                ahead = own[i + 1 : len(own) if bars is None else i + 1 + bars]
                want = (None, None)
                if r[2] is not None and any(x[2] is not None for x in ahead):
                    want = (None, 0)
                    for k, x in enumerate(ahead, 1):
                        if x[4] is not None and (x[4] <= r[2] * (1 - width / 2) or x[3] >= r[2] * (1 + width)):
                            want = (k, -1 if x[4] <= r[2] * (1 - width / 2) else 1)
                            break
                assert got[s, r[1]] == want
        if bars == 4:
            same = {(r["symbol"], r["open_time"]): r["tb_direction"] for r in B.barrier_label(d, width, width / 2, 4).collect()}
            assert same == {k: v[1] for k, v in got.items()}
    plans = [B.first_touch(d, 0.1, 0.1, n)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (500, 3000)]
    assert plans[0] == plans[1]  # a farther horizon makes the plan no larger
