"""Sources, sinks, text functions, chunks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import chunks
from tidemark.operators import features
from tidemark.operators import retrieval as R
from tidemark.sources import files, paged, sinks
from tidemark.streaming import live


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv_sources(spark, tmp_path):
    k = write(f"{tmp_path}/k/a.csv", "open_time,open,high,low,close,volume,close_time,q,n,tb\n1704067200000,1,2,0.5,1.5,10,1704070799999,15,7,4\n1704070800000000,1,2,0.5,1.5,0,1704074399999,0,0,0\nbroken,1\n")
    got = files.read_klines(spark, k).orderBy("open_time").collect()
    assert [(r["open_time"], r["taker_buy_ratio"]) for r in got] == [(1704067200000, 0.4), (1704070800000, 0.5)]
    f = write(f"{tmp_path}/f/a.csv", "calc_time,x,rate,mark\n1704067200000,8,0.0001\n1704096000000,8,0.0002,42000\n")
    assert [r["mark_price"] for r in files.read_funding(spark, f).orderBy("funding_time").collect()] == [None, 42000.0]
    t = write(f"{tmp_path}/t/a.csv", "1,100.5,2,1,1,1704067200000123,True,True\n2,100,1,1,1,1704067200000,0,x\n3,1,1\n")
    assert [(r["time_ms"], r["is_buyer_maker"]) for r in files.read_agg_trades(spark, t).orderBy("time_ms", "price").collect()] == [(1704067200000, False), (1704067200000, True)]


def test_months(spark):
    assert [str(r[0]) for r in files.months(spark, "2023-11", "2024-02").collect()] == ["2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01"]


def test_papers_and_markdown(spark, tmp_path):
    for i, r in enumerate(({"arxiv_id": "1", "title": "t", "authors": list("abcdefg"), "text": "", "summary": "s"}, {"arxiv_id": "2", "text": " ", "summary": None})):
        write(f"{tmp_path}/p/{i}.json", json.dumps(r, indent=1))
    got = files.read_papers(spark, f"{tmp_path}/p").collect()
    assert [(r["text"], r["authors"], r["trust_tier"]) for r in got] == [("s", "a, b, c, d, e", 3)]
    write(f"{tmp_path}/m/x/note.md", "# hi")
    write(f"{tmp_path}/m/empty.md", "  ")
    assert [(r["title"], r["trust_tier"]) for r in files.read_markdown(spark, f"{tmp_path}/m", "strategy_notes").collect()] == [("note", 2)]


def test_feed(spark, tmp_path):
    write(f"{tmp_path}/feed.xml", '<feed><entry><id>http://arxiv.org/abs/1.2v1</id><title>A\n  b</title><summary> c </summary><published>2024</published><author><name>N</name></author><category term="q"/></entry></feed>')
    r = files.read_feed(spark, f"{tmp_path}/feed.xml").first()
    assert (r["arxiv_id"], r["title"], r["authors"], r["categories"]) == ("1.2v1", "A b", ["N"], ["q"])
    assert files.feed_query(["a b"], ["x", "y"]) == '(all:"a b") AND (cat:x OR cat:y)'


def test_page_text(spark):
    d = spark.createDataFrame([("<p>a &lt; b</p><script>var t='</p>';</script><!-- x --> c",)], "html string")
    assert d.select(files.page_text(F.col("html"))).first()[0] == "a < b c"


def test_paged_walk(spark):
    rows = [(i * 100, float(i), 1.0) for i in range(23)]
    fetch = lambda end, limit: [r for r in rows if r[0] <= end][-limit:]
    assert sorted(paged.walk_back(fetch, 300, 2200, 5)) == rows[3:]
    got = paged.read_open_interest(spark, fetch, 300, 2200, 5).orderBy("open_time").collect()
    assert len(got) == 20 and got[0]["oi_delta"] is None and got[1]["oi_delta"] == 1.0


def test_insert_or_ignore_keeps_the_first_write(spark, tmp_path):
    d = lambda *rows: spark.createDataFrame(rows, "k int, v int")
    path = f"{tmp_path}/t"
    sinks.insert_or_ignore(d((1, 10), (1, 9)), path, ["k"], ["v"])
    sinks.insert_or_ignore(d((1, 1), (2, 5)), path, ["k"], ["v"])
    t = spark.read.parquet(path)
    assert sorted(map(tuple, t.collect())) == [(1, 9), (2, 5)]
    assert sorted(map(tuple, sinks.upserted(d((1, 1)), t, ["k"]).collect())) == [(1, 1), (2, 5)]
    o = t.withColumnRenamed("k", "open_time")
    assert sinks.has_month(o, 2, 3) and not sinks.has_month(o, 3, 9) and sinks.resume_from(o, 10) == 12
    assert sinks.resume_from(o.limit(0)) is None


def test_dual_write_survives_a_broken_store(spark, tmp_path):
    write(f"{tmp_path}/broken", "a file, not a folder")
    failures = []
    sinks.dual_write([f"{tmp_path}/a", f"{tmp_path}/broken"], failures)(spark.range(3), 0)
    sinks.dual_write([f"{tmp_path}/a", f"{tmp_path}/broken"], failures)(spark.range(3), 0)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 3 and [f[0] for f in failures] == [0, 0]


def test_messages_and_artefacts(spark, tmp_path):
    from tidemark.operators import quality

    d = spark.createDataFrame([("btc", 1.5)], "symbol string, price double")
    assert tuple(sinks.to_messages(d).first()) == ("btc", '{"symbol":"btc","price":1.5}')
    write(f"{tmp_path}/a", "x")
    assert [r["present"] for r in quality.artefacts(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()] == [True, False]
    cv = spark.createDataFrame([(0.1,), (0.3,)], "edge double")
    assert quality.edge_verdict(cv).first()["level"] == "PASS" and quality.edge_verdict(cv.limit(0)).first()["level"] == "FAIL"
    assert quality.lookahead_columns(["ret_fwd", "close"]) == ["ret_fwd"]


def test_text_functions(spark):
    d = spark.createDataFrame([("Funding  rate and RSI, rsi. Näive_1!",)], "t string")
    r = d.select(X.tokens(F.col("t")).alias("k"), X.entities(F.col("t")).alias("e"), X.token_estimate(F.col("t")).alias("n")).first()
    assert r["k"] == ["funding", "rate", "and", "rsi", "rsi", "näive_1"] and r["e"] == ["funding  rate", "rsi"] and r["n"] == 9
    line = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("data: [DONE]",)], "l string")
    assert [x[0] for x in line.select(X.streamed_content(F.col("l"))).collect()] == ["hi", None]


@pytest.mark.parametrize("text,most,want", [("One. Two three. Four", 16, "One. Two three. […]"), ("a" * 20, 10, "a" * 10 + " […]"), (" x  y ", 10, "x y"), ("", 5, "")])
def test_sentence_trim(spark, text, most, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.sentence_trim(F.col("t"), most)).first()[0] == want


def test_chunks_keep_bounds_overlap_and_text():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * (40 + 30 * (i % 5)) for i in range(20)) + "\n\n" + "x" * 3000
    got = chunks.chunk_text(text)
    assert all(len(c) <= 1150 for c in got) and len(got) > 5
    flat = "".join(chunks.units(" ".join(text.split(" "))))
    assert "".join(flat.split()) == "".join(text.split())
    assert all(b.startswith(a[-100:].strip()[:20]) or a[-150:].strip()[:10] in b for a, b in zip(got, got[1:]))
    long = "Some words here. " * 600_000
    first = chunks._cut(__import__("pyarrow").array([long, None, "x"]), 1000, 150)
    sizes = [sum(len(c) for _, _, c in part) for part in first]
    assert len(sizes) > 2 and max(sizes) <= chunks.SENT + 1150  # they leave in parts
    assert chunks.chunk_text(None) == [] and chunks.chunk_text(" \n ") == [] and chunks.chunk_text("short") == ["short"]


def test_attention_order(spark):
    for n, want in ((5, [0, 4, 1, 3, 2]), (2, [0, 1]), (1, [0])):
        d = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(n)], "query_id int, id int, combined double")
        assert [r["place"] for r in R.attention_order(d).orderBy("id").collect()] == want


def test_context_skips_what_does_not_fit(spark):
    rows = [(1, i, i, "strategy_notes", 2, 0.5, "t", t) for i, t in enumerate(("a" * 100, "b" * 300, "c" * 20))]
    d = spark.createDataFrame(rows, "query_id int, id int, place long, source_type string, trust_tier int, sim double, title string, text string")
    r = R.contexts(d, 60).first()
    assert (r["n_included"], r["n_dropped"]) == (2, 1) and r["context"].startswith("## Your own strategy notes\n- [trust=2, sim=0.50] \"t\"") and "ccc" in r["context"]
    assert R.contexts(d, 1).first()["n_included"] == 1


def test_memory(spark):
    d = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(6)], "c int, t int, role string, text string")
    r = R.memory(d, "c", "t").first()
    assert r["buffer"] == "user: m2\nuser: m3\nuser: m4\nuser: m5" and r["n_overflow"] == 2


def test_streamed_candles_and_signals(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(3):
        e.filter(F.col("event_id") % 3 == i).write.parquet(f"{tmp_path}/in/events{i}.parquet")
    stream = live.tick_stream(spark, f"{tmp_path}/in/*", "*.parquet")
    got = live.run_to_table(live.candle_stream(stream), "complete", f"{tmp_path}/c1")
    assert got.agg(F.sum("trade_count")).first()[0] == 1000
    out = []
    live.signal_batches(lambda df, i: out.extend(df.collect()))(spark.createDataFrame([("a", i, 5.0) for i in range(3)], "symbol string, open_time long, close double"), 0)
    assert out[0]["signal"] == "WAITING"
    assert features.signal(F.lit(10)) is not None
