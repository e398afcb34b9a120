"""The corpus operators' queries, each over its whole table, and their SQL where SQL can express them.

Where it can't because of a fitted model or a format, further queries give the columns of the same
operator that it can.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, hard_negatives, language_id, license_scan, mixing, mpeg_audio, neardup, periodic_runs, piecewise_hash, pieces, quality_rules, secret_scan, warc
from tidemark.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.read_records(warc.write_archives(table(spark, sf_dir, "pages"))))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.fit(docs))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.describe_media(mpeg_audio.store_media(table(spark, sf_dir, "documents")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, :probe AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)",
        args={"probe": chat_format.PROBE},
    )
    return chat_format.digests(chat_format.format_conversations(said.unionByName(probe)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_texts(table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(spark))
    return found.select(
        "doc_id",
        "n_candidates",
        F.size("findings").cast("long").alias("n_secrets"),
        "findings",
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(v.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.fingerprint_texts(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.scan_runs(periodic_runs.plant_periods(table(spark, sf_dir, "documents"))))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rules of op1 count, without the model's columns."""
    found = op1_quality_rules(spark, sf_dir)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, s FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM win JOIN twice USING (doc_id, s)) GROUP BY 1),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed
FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)"""


def undetermined_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts op4 calls undetermined."""
    found = op4_language_id(spark, sf_dir)
    return found.select("doc_id", (F.col("lang_pred") == language_id.UNKNOWN).alias("undetermined"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads that op6 reads back."""
    return op6_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op12."""
    return op12_piecewise_hash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 decodes its ids to."""
    return op8_sentencepiece(spark, sf_dir).select("doc_id", "decoded_sha256", "decoded_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_source_mixing": op5_source_mixing,
    "op6_mpeg_audio": op6_mpeg_audio,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secret_scan": op9_secret_scan,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_piecewise_hash": op12_piecewise_hash,
    "op13_periodic_runs": op13_periodic_runs,
    "quality_counts": quality_counts,
    "undetermined_language": undetermined_language,
    "media_payloads": media_payloads,
    "edited_texts": edited_texts,
    "piece_round_trip": piece_round_trip,
}
ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE_SQL,
    "op3_license_scan": license_scan.ORACLE_SQL,
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op7_chat_formatting": chat_format.ORACLE_SQL,
    "op10_near_duplicates": neardup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 4 AS q FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - q) || substr(next, 1, q)) AS edited_sha256 FROM n""",
    "quality_counts": _QUALITY_SQL,
    "undetermined_language": r"SELECT doc_id, NOT coalesce(regexp_matches(text, '\p{L}'), false) AS undetermined FROM documents",
    "media_payloads": """
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS m FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(t || repeat(chr(0), CAST(m - n AS BIGINT))) AS payload_sha256 FROM p""",
    "piece_round_trip": "SELECT doc_id, sha256(text) AS decoded_sha256, CAST(length(text) AS BIGINT) AS decoded_chars FROM documents",
}
