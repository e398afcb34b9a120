"""Near-duplicates where ids repeat, and the block kernel against sets."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_queries import groups

import corpus_pipeline
from tidemark.llm import neardup


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rng, base, n):
    w = list(base)
    for at in rng.sample(range(len(w)), n):
        w[at] = words(rng, 1)[0]
    return " ".join(w)


def repeated_ids(spark):
    rng = random.Random(3)
    a, b = words(rng, 200), words(rng, 200)
    x, x2, y, y2 = " ".join(a), edited(rng, a, 3), " ".join(b), edited(rng, b, 3)
    rows = [(0, x), (1, x2), (1, y), (2, y2), (None, x), (None, x), (3, "one two"), (3, "one two"), (3, "three"), (4, x2.upper()), (1, x2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_an_id_with_two_texts_joins_nothing(spark):
    rows, d = repeated_ids(spark)
    (x, x2, y, y2), short = (rows[i][1] for i in range(4)), "one two"
    text = dict(d.select(F.xxhash64("text"), "text").distinct().collect())
    got = sorted(((r["doc_id"], text[r["text_hash"]], r["component_id"], r["kept"], r["chosen"]) for r in neardup.near_duplicates(d).collect()), key=str)
    assert got == sorted(
        [
            (0, x, 0, True, True), (1, x2, 0, False, False), (1, x2, 0, False, False), (1, y, 1, True, True), (2, y2, 1, False, False),
            (None, x, None, True, True), (None, x, None, True, True), (3, short, 3, True, True), (3, short, 3, True, True),
            (3, "three", 3, True, True), (4, x2.upper(), 0, False, False),
        ],
        key=str,
    )


def test_the_pipeline_drops_rows_and_not_ids(spark):
    rows, d = repeated_ids(spark)
    docs = d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    x, y = rows[0][1], rows[2][1]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(0, x), (1, y), (None, x), (None, x), (3, "one two"), (3, "three")], key=str)


def test_ids_of_another_type(spark):
    _, d = repeated_ids(spark)
    got = neardup.near_duplicates(d.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} >= {("d0", "d0"), ("d1", "d0"), ("d1", "d1"), ("d2", "d1"), (None, None)}


def test_overlaps_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 5, 300, 4000, 8000, 8000, 20)]
    want = [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets]
    assert neardup.overlaps(sets, sets[2:]).tolist() == want
    assert neardup.overlaps([np.array([3], np.uint64)], [np.array([4], np.uint64)]).tolist() == [[0]]
    a, b = np.array([1, 2, 9]), np.array([2, 4, 9])
    assert neardup.forest(a, b, np.ones((3, 3), bool)) == [(1, 2), (1, 4), (1, 9)]
    assert neardup.forest(a, b, np.eye(3, dtype=bool)) == [(1, 2), (2, 4)]


def test_a_shared_passage_loses_no_link(spark, monkeypatch):
    """Documents with one common passage: unrelated ones just below the threshold, some pairs above it; blocks are small."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 40)
    rng = random.Random(11)
    passage = words(rng, 240)
    rows = []
    for _ in range(200):
        own = words(rng, rng.randint(45, 60))
        rows.append((len(rows), " ".join(passage + own)))
        if rng.random() < 0.4:
            rows.append((len(rows), " ".join(passage + edited(rng, own, rng.randint(4, 12)).split())))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d).collect()}
    want = groups(dict(rows))
    assert got == want and 40 < len(set(want.values())) < len(rows)
