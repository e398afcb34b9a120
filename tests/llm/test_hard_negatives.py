"""Hard negatives against plain integer products."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int, score string, slot string, anchor string, rank string"


def brute(rows):
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in ok if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d == c) for j, w, d in ok if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:5]:
            found = [(t, k) for t, k, same in scored if not same and -30 * s <= -100 * t <= -90 * s][:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, slices=3):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(slices)
    return sorted(map(tuple, hard.mine_negatives(d, F.col("vec_id") % 100 == 0).collect()))


def some(rng, n, dims, spread=1.0, ids=None):
    return [(k if ids is None else rng.choice(ids), [rng.gauss(0, spread) for _ in range(dims)], rng.randrange(4)) for k in range(n)]


def test_negatives_equal_brute_force(spark):
    rng = random.Random(3)
    rows = some(rng, 700, 8)
    rows += [(k, [rng.choice([0.0, 0.25, -0.5]) for _ in range(3)], rng.randrange(3)) for k in range(1000, 1500)]  # other lengths, many ties
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [math.nan] * 8, 1), (401, [math.inf] * 8, 0), (None, [1.0] * 8, 2), (500, [1.0] * 8, None), (600, [], 1), (601, [], 1), (602, [], 2), (1600, [2.0] * 8, 9)]
    assert mined(spark, rows) == brute(rows) != []


def test_repeated_ids_and_rows(spark):
    rng = random.Random(5)
    rows = some(rng, 300, 4, ids=range(250))
    rows += rows[:60]
    assert mined(spark, rows) == brute(rows)


def test_large_components(spark):
    rng = random.Random(6)
    for spread in (1e3, 1e6):
        rows = some(rng, 220, 5, spread)
        assert mined(spark, rows) == brute(rows)


def test_blocks_and_few_rows(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(100 * k if k % 2 else k, v, c) for k, v, c in some(rng, 500, 6)]
    want = brute(rows)
    assert mined(spark, rows, 1) == want
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_planes_end_in_the_exact_product(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(hard, "_FEW", 5)
    for dims in (1, 3, 64):
        anchors, x = rng.integers(-300, 300, (20, dims)), rng.integers(-300, 300, (90, dims))
        labels, own = rng.integers(0, 3, 90), rng.integers(0, 3, 20)
        low, high = np.full((20, 1), -50_000), np.full((20, 1), 60_000)
        b = hard.Block(np.arange(20), np.arange(20) + 1000, own, anchors, low, high)
        best = hard._Best(b, 4)
        for at in range(0, 90, 13):
            hard._score(b, best, np.arange(20), np.arange(at, min(90, at + 13)), labels[at : at + 13], x[at : at + 13], False)
        got = {(int(a), int(i), int(s)) for a, _, s, i in best.settle().T}
        exact = anchors @ x.T
        want = set()
        for a in range(20):
            fine = sorted((-exact[a, i], i) for i in range(90) if labels[i] != own[a] and -50_000 <= exact[a, i] <= 60_000)[:4]
            want |= {(a, int(i), int(-s)) for s, i in fine}
        assert got == want


@pytest.mark.parametrize("name", ["op11_hard_negatives"])
def test_query_has_every_anchor(spark, name):
    from tidemark.llm import catalog

    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert {r[0] for r in got.select("anchor_id").distinct().collect()} <= {0, 100, 200, 300, 400}
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
