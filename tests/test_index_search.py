"""The inverted index and the dense search against exhaustive ones."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nearest, sparse_index
from tidemark.operators import retrieval as R

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(400)], k=rng.randint(0, 60)))) for i in range(3000)]
    return spark.createDataFrame([*rows, (3000, None), (3001, "")], "id long, text string").repartition(4)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return sparse_index.build(docs, f"file://{tmp_path_factory.mktemp('index')}/i", "id", "text", 64)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 4)) for r in df.collect())


def test_search_equals_the_exhaustive_score(spark, docs, index):
    rng = random.Random(2)
    q = asked(spark, "w399", "w300 w2 w350", "w0 w0 w1", "w390 w391 w392 w390", "nothing", "", None, " ".join(rng.choices(WORDS, k=80)), *(" ".join(rng.choices(WORDS, k=3)) for _ in range(30)))
    table = R.token_table(docs, "id", "text")
    want = rows(R.bm25(q, table, R.document_frequencies(table), 7))
    assert rows(sparse_index.search(q, index, 7)) == rows(sparse_index.search(q, index, 7, few=0)) == want != []
    assert rows(sparse_index.search(q, index, 7, at_once=20, few=0)) == want
    again = sparse_index.opened(spark, index.where)
    assert again == index and (again.n_docs, round(again.average, 6)) == (3002, round(table.agg({"dl": "avg"}).first()[0], 6))


def test_a_search_reads_only_the_buckets_of_its_terms(spark, index):
    terms = asked(spark, "w399 w2 w17").selectExpr("query_id", "explode(split(text, ' ')) AS term", "1L AS times")
    read, weighed = sparse_index.read_terms(index, terms)
    buckets = lambda d: {os.path.dirname(r[0]) for r in d.select(F.input_file_name()).distinct().collect()}
    assert weighed.count() == 3 and 1 <= len(buckets(read)) <= 3 < len(buckets(index.postings))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_documents_that_cannot_matter_are_never_scored(spark, index):
    words = "w399 w0 w1 w2"
    terms = asked(spark, words).selectExpr("query_id", "explode(split(text, ' ')) AS term", "1L AS times")
    read, weighed = sparse_index.read_terms(index, terms)
    told = sparse_index.essential(read, weighed, index, 1, leading=1)
    loud = {r["term"] for r in told.filter("NOT silent").collect()}
    assert "w399" in loud and told.filter("silent").count() == 4 - len(loud) > 0
    some = sparse_index.candidates(read, told, index).count()
    holding = read.filter(F.col("term").isin(words.split())).select("id").distinct().count()
    assert 1 <= some < holding


def test_empty_corpus_and_empty_query(spark, docs, index, tmp_path):
    none = sparse_index.build(docs.limit(0), f"file://{tmp_path}/none", "id", "text")
    assert sparse_index.search(asked(spark, "w1"), none, 3).count() == 0
    assert sparse_index.search(asked(spark, "w1").limit(0), index, 3).count() == 0


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = [(int(i), x.tolist()) for i, x in enumerate(np.round(rng.normal(size=(900, 6)), 1))]  # coarse: many equal similarities
    v += [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [1.0, 2.0]), (904, [float("nan")] * 6), (None, [1.0] * 6)]
    d = spark.createDataFrame(v, "id long, embedding array<double>").repartition(5)
    q = d.filter("id % 9 = 0 OR id IN (903, 901)").withColumnRenamed("id", "query_id")
    got = {}
    for r in R.dense(q, d, 6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["sim"]))
    m = np.array([x for _, x in v[:900]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for i in range(0, 900, 9):
        sims = np.round(m @ m[i], 6)
        want = sorted(range(900), key=lambda j: (-sims[j], j))[:6]
        assert [j for _, j, _ in sorted(got[i])] == want
    assert got[903] == [(0, 903, 1.0)] and 901 not in got and len(got) == 101
    text = d.selectExpr("concat('k', id) AS id", "embedding")
    named = R.dense(text.filter("id = 'k9'").withColumnRenamed("id", "query_id"), text, 6).orderBy("rank").collect()
    assert [r["sim"] for r in named] == [s for _, _, s in sorted(got[9])]
    assert R.dense(q.limit(0), d, 6).count() == R.dense(q, d.limit(0), 6).count() == 0


def test_no_pair_is_a_row(spark):
    v = spark.range(2000).selectExpr("id", "array(id % 7 - 3.0D, id % 11 - 5.0D, 1.0D) AS embedding")
    found = nearest.nearest(v.filter("id < 500").withColumnRenamed("id", "query_id"), v, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() <= 500 * 4 * v.rdd.getNumPartitions()


def test_queries_build_the_index_anew_if_it_is_gone_or_old(spark, docs, tmp_path):
    from tidemark.plans import documents
    from tidemark.sources import scratch

    d = docs.limit(50).selectExpr("id AS doc_id", "text")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    first = documents._index(spark, str(tmp_path))
    assert documents._index(spark, str(tmp_path)) == first and first.n_docs == 50
    docs.limit(70).selectExpr("id AS doc_id", "text").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    second = documents._index(spark, str(tmp_path))
    assert second.n_docs == 70 and second.where != first.where
    scratch.clear(spark)
    assert documents._index(spark, str(tmp_path)).where != second.where
