"""Boosted trees against a plain implementation, missing values with a side of their own, and their SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as G

COLUMNS = ["a", "b", "c"]
WHOLE = G.Params(rounds=6, depth=3, rate=0.3, rows_share=1.0, columns_share=1.0, least_weight=2.0, gamma=0.05, alpha=0.2, lam=1.0, patience=None, bins=12, positive_weight=1.5)


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.randint(0, 9) / 3, rng.gauss(0, 1)
        y = int((a > 0.3) ^ (b > 2) ^ (rng.random() < 0.1))
        a = None if rng.random() < (0.5 if y else 0.05) else a  # that a is missing says much
        rows.append((i, a, b, c if rng.random() > 0.1 else float("nan"), y, a if a is not None else 2.0))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = made(900, 3)
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, t double").repartition(5)


def plain_fit(rows, cuts, p, label):
    """The same boosting row by row, over lists."""
    missing = None
    x = [[missing if v is None or math.isnan(v) else sum(c < v for c in cuts[n]) for n, v in zip(COLUMNS, r[1:4])] for r in rows]
    y = [float(r[label]) for r in rows]
    w = [p.positive_weight if p.loss == "logistic" and v > 0 else 1.0 for v in y]
    mean = sum(a * b for a, b in zip(w, y)) / sum(w) if p.loss == "logistic" else sum(y) / len(y)
    m = [math.log(mean / (1 - mean)) if p.loss == "logistic" else mean] * len(y)
    soft = lambda g: math.copysign(max(abs(g) - p.alpha, 0), g)
    score = lambda g, h: soft(g) ** 2 / (h + p.lam)

    def grow(ids, g, h, depth):
        tg, th = sum(g[i] for i in ids), sum(h[i] for i in ids)
        best = None
        for f in range(3) if depth else []:
            for left_missing in (True, False):
                for k in range(p.bins - 1):
                    left = [i for i in ids if (x[i][f] is None and left_missing) or (x[i][f] is not None and x[i][f] <= k)]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if lh < p.least_weight or th - lh < p.least_weight:
                        continue
                    gain = float(f"{0.5 * (score(lg, lh) + score(tg - lg, th - lh) - score(tg, th)) - p.gamma:.9g}")
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, left)
        if best is None:
            value = -p.rate * soft(tg) / (th + p.lam) if depth < p.depth else 0.0
            return dict.fromkeys(ids, value)
        left = set(best[1])
        return grow([i for i in ids if i in left], g, h, depth - 1) | grow([i for i in ids if i not in left], g, h, depth - 1)

    for _ in range(p.rounds):
        if p.loss == "logistic":
            q = [1 / (1 + math.exp(-v)) for v in m]
            g, h = [a * (b - c) for a, b, c in zip(w, q, y)], [a * b * (1 - b) for a, b in zip(w, q)]
        else:
            g, h = [a - b for a, b in zip(m, y)], [1.0] * len(y)
        add = grow(list(range(len(y))), g, h, p.depth)
        m = [v + add[i] for i, v in enumerate(m)]
    return [1 / (1 + math.exp(-v)) if p.loss == "logistic" else v for v in m]


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_model_equals_a_plain_one(table, loss, monkeypatch):
    rows, d = table
    monkeypatch.setattr(G, "STORED_EVERY", 4)
    p = G.replace(WHOLE, loss=loss, rounds=5)
    cuts = G.quantile_cuts(d, COLUMNS, p.bins)
    model = G.fit(d, COLUMNS, "y" if loss == "logistic" else "t", F.lit(G.TRAIN), p, F.col("id"), cuts)
    got = {r["id"]: r["proba"] for r in model.predict(d).collect()}
    want = plain_fit(rows, cuts, p, 4 if loss == "logistic" else 5)
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame([(r[0], *(None if v is None or math.isnan(v) else v for v in r[1:4])) for r in rows], columns=["id", *COLUMNS])
    con.register("t", frame)
    told = dict(con.execute(f"SELECT id, {model.sql()} FROM t").fetchall())
    assert [told[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)


def test_a_missing_value_has_its_side(table):
    _, d = table
    model = G.fit(d, COLUMNS, "y", F.lit(G.TRAIN), WHOLE, F.col("id"))
    scored = model.predict(d)
    low, high = (scored.filter(w).agg(F.avg("proba")).first()[0] for w in ("a IS NOT NULL", "a IS NULL"))
    assert high > low + 0.25
    assert dict(model.importances())["c"] < 0.2 and sum(v for _, v in model.importances()) == pytest.approx(1)
    right = scored.agg(F.avg(((F.col("proba") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.85


def test_models_of_several_folds_are_those_of_each(table):
    _, d = table
    roles = [F.when(F.col("id") < 300, G.TRAIN), F.when(F.col("id") < 600, G.TRAIN)]
    p = G.replace(WHOLE, rounds=2, rows_share=0.7, columns_share=0.7)
    cuts = G.quantile_cuts(d, COLUMNS, p.bins)
    both = G.fit_many(d, COLUMNS, "y", roles, [p, p], F.col("id"), cuts)
    alone = G.fit(d, COLUMNS, "y", roles[0], p, F.col("id"), cuts)
    shape = lambda m: [(t.feature, t.bin, t.missing_left) for t in m.trees]
    assert shape(both[0]) == shape(alone) != shape(both[1])


def test_early_stopping(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, rng.random(), rng.randint(0, 1)) for i in range(400)], "id long, x double, y int")
    role = F.when(F.col("id") % 2 == 0, G.TRAIN).otherwise(G.VALIDATION)
    passes = []
    model = G.fit_many(d, ["x"], "y", [role], [G.replace(WHOLE, rounds=30, patience=3, gamma=0.0, least_weight=1.0)], F.col("id"), watch=passes.append)[0]
    assert len(model.trees) < 20 and len(passes) <= len(model.trees) + 4  # nothing to learn, so validation stops it


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, 1), (2, 1.0, None), (3, 5.0, 0)], "id long, x double, y int")
    model = G.fit(d, ["x"], "y", F.lit(G.TRAIN), G.replace(WHOLE, rounds=1), F.col("id"))
    assert all(0 < r["proba"] < 1 for r in model.predict(d).collect())
    none = G.fit(d.limit(0), ["x"], "y", F.lit(G.TRAIN), G.replace(WHOLE, rounds=1), F.col("id"))
    assert none.predict(d).count() == 3
    with pytest.raises(ValueError):
        G.fit(d, ["x"], "y", F.lit(G.TRAIN), G.replace(WHOLE, bins=300), F.col("id"))


def test_sampling_is_a_share_and_repeats():
    keys = np.arange(20_000, dtype=np.int64) - 5000
    a, b = G._sampled(keys, 7, 0.8), G._sampled(keys, 8, 0.8)
    assert abs(a.mean() - 0.8) < 0.02 and (a == G._sampled(keys, 7, 0.8)).all() and 0.2 < (a != b).mean() < 0.45
