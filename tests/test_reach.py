"""Sources, sinks, text forms and model parts that no query runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import backtest as B
from tidemark.operators import ml
from tidemark.operators import retrieval as R
from tidemark.sources import files, scratch, sinks, tables
from tidemark.streaming import live


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_liquidations(spark, tmp_path):
    p = write(f"{tmp_path}/l/a.csv", "s,side,t,x,q,p,a,st,l,filled,time\nBTC, buy ,L,I,1,2,3,F,1,0.5,1704067200000\nBTC,SELL,L,I,1,2,3,F,1,2.5,1704067200000123\nBTC,SELL,L\n")
    assert sorted(map(tuple, files.read_liquidations(spark, p).collect())) == [("BUY", 0.5, 1704067200000), ("SELL", 2.5, 1704067200000)]


def test_replayed_messages(spark, tmp_path):
    good = json.dumps({"stream": "btcusdt@trade", "data": {"p": "1.5", "q": "2", "T": 5}})
    write(f"{tmp_path}/m/a.json", f"{good}\nbroken\n")
    write(f"{tmp_path}/m/b.json", f"{good}\n")
    got = live.run_to_table(files.replayed(spark, f"{tmp_path}/m"), "append", f"{tmp_path}/out")
    assert [tuple(r) for r in got.collect()] == [("BTCUSDT", 1.5, 2.0, 5)] * 2
    none = live.run_to_table(files.replayed(spark, f"{tmp_path}/m").filter("price < 0"), "append", f"{tmp_path}/none")
    assert none.count() == 0 and none.columns == got.columns


def test_time_slice_includes_both_ends(spark):
    d = spark.range(10).withColumnRenamed("id", "open_time")
    assert [r[0] for r in tables.between(d, 3, 5).orderBy("open_time").collect()] == [3, 4, 5]


def test_file_sinks(spark, tmp_path):
    t = spark.createDataFrame([("b", "2024-01-02 01:00:00", 1.0), ("a", "2024-01-01 05:00:00", 2.0), ("a", "2024-01-01 04:00:00", 3.0)], "symbol string, t string, price double")
    t = t.withColumn("time", F.to_timestamp("t")).drop("t")
    for _ in range(2):
        sinks.write_ticks(t, f"{tmp_path}/ticks")
    back = spark.read.parquet(f"{tmp_path}/ticks")
    assert back.count() == 6 and sorted(os.listdir(f"{tmp_path}/ticks"))[-2:] == ["day=2024-01-01", "day=2024-01-02"]
    for _ in range(2):
        sinks.write_csv(t.drop("time"), f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/csv").collect())) == [("a", "2.0"), ("a", "3.0"), ("b", "1.0")]
    sinks.write_json({"b": [1, None], "a": "é"}, spark, f"{tmp_path}/json")
    assert json.loads(spark.read.text(f"{tmp_path}/json").first()[0]) == {"b": [1, None], "a": "é"}
    papers = spark.createDataFrame([("1", "t", "2024", " "), ("2", "u", "2023", "x"), ("3", None, None, None)], "arxiv_id string, title string, published string, text string")
    for _ in range(2):
        sinks.append_manifest(papers, f"{tmp_path}/manifest")
    lines = spark.read.json(f"{tmp_path}/manifest")
    assert sorted((r["arxiv_id"], r["has_text"]) for r in lines.collect()) == [("1", False)] * 2 + [("2", True)] * 2 + [("3", False)] * 2
    bad = spark.createDataFrame([(5,), (1704067200000,)], "funding_time long")
    assert sinks.without_bad_times(bad).count() == 1


def test_replaced_table(spark):
    sinks.replace_table(spark.range(3), "reach_replaced")
    sinks.replace_table(spark.range(2).withColumn("x", F.lit(1)), "reach_replaced")
    assert spark.table("reach_replaced").columns == ["id", "x"] and spark.table("reach_replaced").count() == 2
    spark.sql("DROP TABLE reach_replaced")


def test_kafka_needs_its_connector_and_says_so(spark, tmp_path):
    d = spark.createDataFrame([("btc", 1.0)], "symbol string, price double")
    stream = spark.readStream.schema("symbol string, price double").json(str(tmp_path))
    for start in (
        lambda: files.kafka_ticks(spark, "localhost:9", "t"),
        lambda: sinks.write_kafka(d, "localhost:9", "t"),
        lambda: sinks.stream_to_kafka(stream, "localhost:9", "t", f"{tmp_path}/c"),
    ):
        with pytest.raises(Exception, match="(?i)kafka"):
            start()


def test_text_forms(spark):
    d = spark.createDataFrame([("abc  def ghi", "2024-05-06T07:08:09Z", "", "t")], "x string, at string, id string, title string")
    r = d.select(
        X.preview(F.col("x"), 5), X.server_preview(F.col("x"), 5), X.preview(F.col("x"), 50), X.date_prefix(F.col("at")), X.default_title(F.col("id"), F.col("title")),
        X.default_title(F.col("id")), X.squeezed(F.col("x")), X.identifier(F.lit("a b/c"), F.lit("é"), most=6),
    ).first()
    assert tuple(r) == ("abc […]", "abc   [...]", "abc  def ghi", "2024-05-06", "t", "untitled", "abc def ghi", "a_b_c_")


def test_entry_of_a_paper_has_its_day(spark):
    d = spark.createDataFrame([("arxiv_paper", 3, 0.5, "T", "One. Two.", "1.2", "2024-05-06T00:00:00Z"), ("blog_or_news", None, 0.25, None, "x", None, None)], "source_type string, trust_tier int, sim double, title string, text string, aid string, at string")
    assert [r[0] for r in d.select(R.entry("text", "aid", "at")).collect()] == ['- [trust=3, sim=0.50] "T" (arXiv:1.2, 2024-05-06)\n  One. Two.', '- [trust=?, sim=0.25] "untitled"\n  x']


def test_memory_block_leaves_out_what_is_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "RSI?"), (1, 1, "assistant", "a" * 20), (2, 0, "user", None)], "c int, t int, role string, text string")
    s = spark.createDataFrame([(1, "before")], "c int, summary string")
    got = {r["c"]: r["block"] for r in R.memory_block(turns, s, "c", "t", most=5).collect()}
    assert got[1] == "## Prior conversation (summary)\nbefore\n\n## Recent conversation (verbatim)\n**Q:** RSI?\n**A:** aaaaa […]\n\n## Session focus (signals / topics mentioned so far)\nrsi"
    assert got[2] == "## Recent conversation (verbatim)\n**Q:** "
    assert R.focus(turns, "c").count() == 1


def test_stored_index_answers_searches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, None), (4, "green")], "id int, text string")
    t = sinks.store_index(R.token_table(docs, "id", "text"), f"{tmp_path}/index")
    asked = spark.createDataFrame([(7, "fox blue"), (8, "nothing")], "query_id int, text string")
    got = R.bm25(asked, t, R.document_frequencies(t), 5).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(7, 2, 0), (7, 1, 1)] or [(r["query_id"], r["id"]) for r in got] == [(7, 2)]
    assert R.bm25(asked, t.limit(0), R.document_frequencies(t.limit(0)), 5).count() == 0


def test_dense_search_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0])], "id int, embedding array<double>")
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    one, many = (sorted(map(tuple, R.dense(q, v, 4, block=b).collect())) for b in (1000, 2))
    assert one == many and len(one) == 6 * 4


def test_embedding_has_length_one(spark):
    d = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in R.embedded(d, dims=16).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and got[2] == got[3] == [0.0] * 16


def test_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda spark: f"file://{tmp_path}/shared")
    other = tmp_path / "shared" / "tidemark-of-another"
    other.mkdir(parents=True)
    assert scratch.stored(spark.range(3), "rows").count() == 3 and os.listdir(scratch.folder(spark)[7:])[0].startswith("rows-")
    scratch.clear(spark)
    assert os.listdir(f"{tmp_path}/shared") == ["tidemark-of-another"]  # only its own


def test_no_local_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        scratch.root(Session)


@pytest.fixture(scope="module")
def learned(spark):
    d = spark.range(900).select(
        F.lit("a").alias("symbol"), F.col("id").alias("open_time"), (F.col("id") % 10).cast("double").alias("x"), F.rand(1).alias("noise"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.rand(2)).alias("thin"), F.when(F.col("id") % 4 > 0, F.lit(None).cast("double")).alias("empty"), ((F.col("id") % 10) > 4).cast("int").alias("label"),
    )
    return B.time_split(d.withColumn("target_return_4h", F.col("x") / 10 - 0.45)).cache()


def test_model_parts(spark, learned, tmp_path):
    columns = ml.feature_columns(learned)
    assert columns == ["x", "noise", "thin"]
    model, trees = ml.fit_early(learned, columns, 30)
    assert 1 <= trees <= 30
    assert ml.fit_early(learned.withColumn("label", (F.rand(3) > 0.5).cast("int")), ["noise"], 30)[1] < 30  # nothing to learn, so validation stops it
    imp = ml.importances(model, columns, learned).collect()
    assert imp[0]["feature"] == "x" and sum(r["importance"] for r in imp) == pytest.approx(1)
    meta = ml.metadata(model, columns, learned)
    assert meta["features"] == columns and (meta["first"], meta["last"], meta["rows"]) == (0, 899, 900) and meta["params"]["maxDepth"] == 3
    for name in ("model_1", "model_2"):
        model.write().overwrite().save(f"file://{tmp_path}/models/{name}")
    assert ml.latest_path(spark, f"file://{tmp_path}/models/model_*").endswith("model_2")
    again = ml.latest(spark, f"file://{tmp_path}/models/model_*")
    test = ml.filled(learned.filter("split = 'test'"), columns)
    assert ml.with_probability(again, test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] == 1.0
    with pytest.raises(FileNotFoundError):
        ml.latest(spark, f"file://{tmp_path}/models/none_*")


def test_two_stages_and_regression(learned):
    first, second, columns = ml.fit_two_stage(learned, ["x", "noise"], 3)
    test = ml.filled(learned.filter("split = 'test'"), columns)
    rows = ml.two_stage(first, second, test).collect()
    assert len(rows) == 180 and all(r["pred"] == r["label"] and r["proba"] > 0.5 for r in rows)
    reg = ml.gbt_regressor(["x"], iterations=30).fit(ml.filled(learned, ["x"]))
    assert B.regression_metrics(reg.transform(test), "target_return_4h", "prediction").first()["r2"] > 0.6


def test_walk_forward_follows_the_folds(learned):
    got = ml.with_summary(ml.walk_forward_cv(learned, ["x"], lambda c: ml.gbt_classifier(c, 2), k=3)).orderBy("fold").collect()
    want = B.folds(900, 3)
    assert [r["n_train"] for r in got[2:]] == pytest.approx([a for a, _, _ in want], abs=2)
    assert [r["n_test"] for r in got[2:]] == pytest.approx([e - b for _, b, e in want], abs=2)
    assert all(r["accuracy"] == 1.0 for r in got[2:]) and got[1]["accuracy"] == 1.0 and got[0]["accuracy"] == 0.0
