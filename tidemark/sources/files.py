"""File sources: exchange CSV dumps, message envelopes, paper records, markdown, pages, month lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROSECONDS_FROM = 10**15
TRUST = {"arxiv_paper": 3, "onchain_reference": 3, "strategy_notes": 2, "blog_or_news": 1}


def millis(t: Column) -> Column:
    """Epoch milliseconds from milliseconds or, from 16 digits on, microseconds."""
    return F.when(t >= MICROSECONDS_FROM, F.floor(t / 1000)).otherwise(t).cast("long")


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The first day of each month from `start` to `end` (yyyy-MM), both included."""
    bounds = (F.to_date(F.lit(f"{m}-01")) for m in (start, end))
    return spark.range(1).select(F.explode(F.sequence(*bounds, F.expr("interval 1 month"))).alias("month"))


def _csv(spark: SparkSession, path: str | list[str], columns: int) -> DataFrame:
    """A headerless CSV's first columns as strings; short rows have nulls, and a header is a row like others."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)


def _number(name: str, kind: str = "double") -> Column:
    return F.col(name).try_cast(kind)


def read_klines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Candles by position; rows whose numbers can't be read (headers, broken lines) are left out."""
    raw = _csv(spark, path, 10)
    rows = raw.select(
        millis(_number("c0", "long")).alias("open_time"),
        *(_number(f"c{i}").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)),
        millis(_number("c6", "long")).alias("close_time"),
        _number("c7").alias("quote_volume"),
        _number("c8", "int").alias("trade_count"),
        _number("c9").alias("taker_buy_base_vol"),
    ).dropna()
    return with_taker_columns(rows)


def with_taker_columns(klines: DataFrame) -> DataFrame:
    """Adds the seller side of the volume and the buyers' share, 0.5 without volume."""
    buy, volume = F.col("taker_buy_base_vol"), F.col("volume")
    return klines.withColumn("taker_sell_base_vol", volume - buy).withColumn(
        "taker_buy_ratio", F.when(volume > 0, buy / volume).otherwise(F.lit(0.5))
    )


def read_funding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = _csv(spark, path, 4)
    return raw.select(
        millis(_number("c0", "long")).alias("funding_time"), _number("c2").alias("funding_rate"), _number("c3").alias("mark_price")
    ).dropna(subset=["funding_time", "funding_rate"])


def read_liquidations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = _csv(spark, path, 11)
    return raw.select(
        F.upper(F.trim("c1")).alias("side"), _number("c9").alias("quantity"), millis(_number("c10", "long")).alias("time_ms")
    ).dropna()


def read_agg_trades(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Aggregated trades; rows with fewer than seven fields or unreadable numbers are left out."""
    raw = _csv(spark, path, 7).filter(F.col("c6").isNotNull())
    return raw.select(
        _number("c1").alias("price"), _number("c2").alias("quantity"), millis(_number("c5", "long")).alias("time_ms"),
        F.lower(F.trim("c6")).isin("true", "1").alias("is_buyer_maker"),
    ).dropna()


ENVELOPE = "struct<stream:string,data:struct<p:string,q:string,T:bigint>>"


def parse_envelopes(messages: DataFrame, column: str = "value") -> DataFrame:
    """Stream messages as ticks: the symbol is what stands before `@` in the stream's name, in capitals."""
    m = F.from_json(F.col(column).cast("string"), ENVELOPE)
    return messages.select(m.alias("m")).select(
        F.upper(F.split_part("m.stream", F.lit("@"), F.lit(1))).alias("symbol"),
        F.col("m.data.p").cast("double").alias("price"),
        F.col("m.data.q").cast("double").alias("quantity"),
        F.col("m.data.T").alias("trade_time"),
    )


def kafka_ticks(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of JSON ticks (symbol, price, quantity, timestamp) from the earliest offsets."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    raw = raw.option("subscribe", topic).option("startingOffsets", "earliest").load()
    tick = F.from_json(F.col("value").cast("string"), "symbol string, price double, quantity double, timestamp bigint")
    return raw.select(tick.alias("t"), F.col("timestamp").alias("received_at")).select("t.*", "received_at")


RECORD = (
    "arxiv_id string, title string, authors array<string>, categories array<string>, published string, "
    "summary string, pdf_url string, source_query string, pdf_path string, text string"
)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper records as documents: the body is the text or else the summary; those with neither are left out."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    r = spark.read.schema(RECORD).option("multiLine", True).json(path)
    return r.select(
        F.coalesce(blank(F.col("text")), blank(F.col("summary"))).alias("text"),
        F.lit("arxiv_paper").alias("source_type"), F.lit(TRUST["arxiv_paper"]).alias("trust_tier"), "title", "arxiv_id",
        F.array_join(F.slice("authors", 1, 5), ", ").alias("authors"), F.array_join("categories", ", ").alias("categories"),
        "published", F.col("_metadata.file_path").alias("file_path"),
    ).filter(F.col("text").isNotNull())


def read_markdown(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """Markdown files below `path` as documents titled by their names; blank ones are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(
        F.col("value").alias("text"), F.lit(source_type).alias("source_type"), F.lit(TRUST.get(source_type, 1)).alias("trust_tier"),
        F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("title"), F.col("_metadata.file_path").alias("file_path"),
    ).filter(F.trim("text") != "")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds as paper records, white space in titles and summaries collapsed."""
    schema = (
        "id string, title string, summary string, published string, author array<struct<name:string>>, "
        "category array<struct<_term:string>>"
    )
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return entries.select(
        F.regexp_extract("id", r"abs/(.+)$", 1).alias("arxiv_id"), squeeze("title").alias("title"),
        F.col("author.name").alias("authors"), F.col("category._term").alias("categories"), "published",
        squeeze("summary").alias("summary"),
    )


def replayed(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Recorded stream messages (a JSON envelope a line) as a stream of ticks, file by file; broken lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_envelopes(lines).filter(F.col("price").isNotNull() & F.col("trade_time").isNotNull())


def feed_query(keywords: list[str], categories: list[str]) -> str:
    """The search expression of a feed: any keyword, and any of the categories."""
    quoted = " OR ".join(f'all:"{k}"' for k in keywords)
    return f"({quoted})" + (f" AND ({' OR '.join(f'cat:{c}' for c in categories)})" if categories else "")


def page_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, comments and tags go, white space collapses."""
    for pattern in (r"(?is)<(script|style)\b[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, r"\s+", " "))
