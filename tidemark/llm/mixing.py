"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Each document gets a hash-random key from its id and text; its leading bits give a bucket, a range of keys. Bucket
totals are summed over the table, prefix sums over the (few) buckets of a source give each bucket's
first position, and a running sum inside the bucket gives each document's. No task sorts a whole
source: a source with a third of all rows has as many more buckets with rows as it has rows. Sources are
numbered by ranges as well and their targets found by sums over the table of sources, so that there
can be as many of them as hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, word_count

#: The weights that sources take in turn, the share of all words, the most epochs.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED, ROWS_PER_BUCKET, LEAST_BUCKETS = "mix", 20_000, 256


def numbered(sizes: DataFrame, parts: int | None = None) -> DataFrame:
    """`sizes` (source, ...) with `place`, the source's place by code point from 0, null last.

    Sources are dealt out by ranges; a source's place is that inside its range after those of earlier ranges.
    """
    spark = sizes.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "mix-sources")
    counts = dealt.groupBy("part").count()  # a row a range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("inside")).drop("part", "start", "inside")


def source_targets(sizes: DataFrame) -> DataFrame:
    """`sizes` (source, source_size) with target, by water-filling.

    A source gets weight * level, or its cap where that is less; the level makes targets add up to
    `SHARE` of all words. Each round takes the capped sources out and shares what is left anew, by
    one pass of sums, until no more are capped.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    weight = F.element_at(weights, F.pmod(F.col("place"), F.lit(len(WEIGHTS))).cast("int") + 1)
    caps = stored(numbered(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST), "mix-targets")
    capped, known = F.lit(False), -1
    while True:
        row = caps.agg(
            F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.count_if(capped)
        ).first()
        total, taken, heavy, n = row
        if n == known or not heavy:
            break
        left, known = total * SHARE - taken, n
        capped = F.col("weight") * F.lit(left) > F.col("cap") * F.lit(heavy)
    share = F.col("weight") * F.lit(left) / F.lit(heavy) if heavy else F.lit(None).cast("double")
    return caps.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(share).cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    whole: bool = False,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, then the columns of `keep`.

    taken counts words with repeats: full epochs of the source, then its documents in key order up
    to the budget (the floor of the target), where the one that crosses it is cut; with `whole` it
    is taken whole if at least half of it fits, else left. The key is a hash of id and text (null:
    empty), so rows that repeat an id or have none are dealt out by their texts; ties in the key go
    by size, and equal rows are interchangeable. Null and empty texts have size 0 and give nothing;
    a null source is a source, the last. An empty table gives an empty one. Results don't depend on
    the number of buckets.
    """
    known = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), known(id_col), F.md5(known(text_col).cast("binary"))).cast("binary"))
    rows = docs.select(
        key.alias("key"),
        docs[id_col].alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col].cast("string")).alias("size"),
        F.struct(*(docs[c].alias(c) for c in keep)).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
    )
    narrow = rows.select("source", "size", "key")
    total = docs.count()
    buckets = max(LEAST_BUCKETS, -(-total // rows_per_bucket))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")

    # one row per source and bucket: about total / rows_per_bucket of them, or LEAST_BUCKETS to a source
    sums = stored(
        narrow.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")),
        "mix-buckets",
    )
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start")
    )
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("b_source"), F.col("s.bucket").alias("b_bucket"), "start", "source_size", "target"
    )
    placed = rows.withColumn("bucket", bucket)
    joined = placed.join(
        starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("key", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    budget = F.floor("target").cast("long")
    before = F.col("start") + F.sum("size").over(inside) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    out = joined.select("doc_id", "size", "source_size", "target", before.alias("before"), epochs.alias("epochs"), "kept")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("before")
    last = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    if whole:
        last = F.when(2 * last >= F.col("size"), F.col("size")).otherwise(0)
    return out.select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        *(F.col(f"kept.{c}").alias(c) for c in keep if c != "doc_id"),
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('{SEED}:' || doc_id || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
c AS (SELECT *, {MOST} * source_size AS cap, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER () * {SHARE} - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM c),
lv AS (SELECT rest, heavy FROM l WHERE rest / heavy <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * CAST((SELECT rest FROM lv) AS DOUBLE) / (SELECT heavy FROM lv), cap)) AS target FROM l),
p AS (SELECT doc_id, d.source, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
  CAST(floor(target) AS BIGINT) // source_size * size
  + least(greatest(CAST(floor(target) AS BIGINT) % source_size - before, 0), size) END AS BIGINT) AS taken FROM p"""
