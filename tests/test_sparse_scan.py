"""The scanning search against the exhaustive one, and what its queries store and move."""

import glob
import random
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest

from tidemark.operators import nearest, sparse_scan
from tidemark.operators import retrieval as R
from tidemark.plans import catalog
from tidemark.sources import scratch

WORDS = [f"w{k}" for k in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 60)))) for i in range(1500)]
    return spark.createDataFrame([*rows, (1500, None), (1501, ""), (1502, "w1 W1 ?")], "id long, text string").repartition(4)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 4)) for r in df.collect())


def test_scan_equals_the_exhaustive_score(spark, docs, tmp_path):
    rng = random.Random(5)
    texts = ["w299", "w0 w0 w1", "nothing", "", None, " ".join(rng.choices(WORDS, k=80)), *(" ".join(rng.choices(WORDS, k=3)) for _ in range(20))]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    table = R.token_table(docs, "id", "text")
    stats = sparse_scan.gather(docs, f"file://{tmp_path}/s", "text")
    n, average, least = R.index_totals(table, R.document_frequencies(table))
    assert (stats.n_docs, round(stats.average, 9), round(stats.least, 9)) == (n, round(average, 9), round(least, 9))
    want = rows(R.bm25(q, table, R.document_frequencies(table), 7))
    assert rows(sparse_scan.search(q, docs, stats, 7)) == rows(sparse_scan.search(q, docs, stats, 7, block=5)) == want != []
    named = docs.selectExpr("concat('k', id) AS id", "text")
    assert [round(r["score"], 4) for r in sparse_scan.search(q.filter("query_id = 0"), named, stats, 7).orderBy("rank").collect()] == [s for i, _, _, s in want if i == 0]
    assert sparse_scan.search(q.limit(0), docs, stats, 7).count() == sparse_scan.search(q, docs.limit(0), stats, 7).count() == 0
    none = sparse_scan.gather(docs.limit(0), f"file://{tmp_path}/none", "text")
    assert none.n_docs == 0 and sparse_scan.search(q, docs, none, 7).count() == 0


def test_statistics_store_terms_but_no_postings_and_repeated_ids_are_one(spark, tmp_path):
    texts = [(0, "a b b"), (0, "a c"), (1, "a d d"), (1, "a d d"), (None, "x y"), (None, "x z"), (2, None), (3, "a É"), *((k, "p q") for k in range(4, 9))]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stored = lambda: set(glob.glob(f"{scratch.folder(spark).removeprefix('file://')}/index-*"))
    before = stored()
    assert oracle.differences(spark, oracle.connect(str(tmp_path)), catalog.QUERIES["bm25_stats"], catalog.ORACLES["bm25_stats"], str(tmp_path)) == []
    assert stored() == before


def test_no_posting_is_a_row(spark, docs, tmp_path):
    stats = sparse_scan.gather(docs, f"file://{tmp_path}/s", "text")
    found = sparse_scan.search(docs.limit(30).withColumnRenamed("id", "query_id"), docs, stats, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Generate" not in plan


def test_hits_are_searched_for_once(spark):
    for name in ("source_cards", "trust_rerank"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, name


def test_blends_and_scores_halve_as_sql_does(spark):
    hits = spark.range(0, 1_000_000, 37).selectExpr("id", "id / 1e6D AS sim")
    got = [r["combined"] for r in R.trusted(hits, spark.range(0, 1_000_000, 37).selectExpr("id", "3 AS trust_tier")).orderBy("id").collect()]
    sql = "SELECT round(0.75::DOUBLE * (k / 1e6::DOUBLE) + 0.25::DOUBLE * 3 / 3.0::DOUBLE, 6) FROM range(0, 1000000, 37) t(k) ORDER BY k"
    assert got == [r[0] for r in duckdb.sql(sql).fetchall()]
    x = [294.20255, 103.40775, 0.0078125, -0.0078125, 1e-9]
    assert nearest.half_away(np.array(x), 4).tolist() == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in x]


def test_a_task_of_the_dense_search_holds_little_beside_its_queries_and_batch():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(3000, 16)), rng.normal(size=(6000, 16))
    q /= np.linalg.norm(q, axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x.tolist())], names=["id", "v_"])
    tracemalloc.start()
    n = sum(b.num_rows for b in nearest._task(SimpleNamespace(value={16: (np.arange(len(q)), q)}), 20)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 * 20 and peak < 100e6, peak
