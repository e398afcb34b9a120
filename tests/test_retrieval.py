"""Searches answer all their stated queries, however many there are."""

from hashlib import md5

import oracle

from tidemark.plans import catalog

SF = "/root/testdata/sf0.1"


def test_dense_search_asks_for_every_hundredth_vector(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").select("vec_id").collect()}
    assert len(ids) >= 20 and {r[0] for r in catalog.QUERIES["dense_topk"](spark, SF).select("query_id").distinct().collect()} == ids


def test_fusion_asks_for_every_benchmark_item(spark):
    items = {r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    fused = catalog.QUERIES["rrf_fusion"](spark, SF).filter("dense_rank IS NOT NULL")
    assert len(items) > 40 and {r[0] for r in fused.select("query_id").distinct().collect()} == items


def test_hashed_components_halfway_between_decimals_go_away_from_zero(spark, tmp_path):
    slots = {}
    for k in range(1000):
        digest = md5(f"w{k}".encode()).hexdigest()
        slots.setdefault((int(digest[:6], 16) % 64, digest[6] < "8"), f"w{k}")
    words = {True: [], False: []}
    for (_, sign), w in sorted(slots.items()):
        words[sign].append(w)
    # 1 + 4 + 25 + 225 + 127 * 127 = 128 * 128, so that the first component is 1 / 128 = 0.0078125, and its sign differs
    rest = {w: n for w, n in zip(words[True][40:], (2, 5, 15, 127))}
    texts = [" ".join(w for w, n in {first: 1, **rest}.items() for _ in range(n)) for first in (words[True][0], words[False][0])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [set(r["millionths"].split(",")) for r in catalog.QUERIES["hashed_embedding"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert "7813" in got[0] and "-7813" in got[1]
    assert oracle.differences(spark, oracle.connect(str(tmp_path)), catalog.QUERIES["hashed_embedding"], catalog.ORACLES["hashed_embedding"], str(tmp_path)) == []
