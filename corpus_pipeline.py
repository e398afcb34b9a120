"""A corpus pipeline out of the operators of tidemark.llm.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the
last return the columns of documents (doc_id, text, lang, source, n_chars). `run` stores what a
stage returns and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixing, neardup, pieces, secret_scan
from tidemark.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: From this score on (0.5 is a tie), the predicted language replaces another one that the row says.
SURE = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letter, null text) go; the prediction corrects lang.

    A null lang becomes the predicted one; another lang does where the score is `SURE` or more.
    """
    found = language_id.predict_languages(docs, language_id.fit(docs), keep=("text", "lang", "source", "n_chars"))
    kept = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return kept.withColumn("lang", lang).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; of rows that repeat an id and text, one.

    Rows go by id and text: another text under the same id is judged on its own. Rows without an id
    belong to no group and stay, all of them.
    """
    found = stored(neardup.near_duplicates(docs), "near-duplicates")
    key = ["doc_id", "text_hash"]
    gone = found.filter(~F.col("chosen")).select(*key).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("text_hash")).join(gone, key, "left_anti")
    again = found.filter(F.col("chosen") & F.col("doc_id").isNotNull()).groupBy(*key).count().filter("count > 1").select(*key)
    if not again.isEmpty():  # rows that repeat an id and text
        once = rows.join(again, key, "left_semi").dropDuplicates(key)
        rows = rows.join(again, key, "left_anti").unionByName(once)
    return rows.select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text is replaced by a mark; n_chars follows. No document goes.

    Null and empty texts, texts of any length, repeated rows and null ids are scanned like any other
    (a null text stays null); an empty table gives an empty one; columns besides those of documents go.
    """
    found = secret_scan.scan(docs, secret_scan.train(spark), keep=("lang", "source", "n_chars"))
    changed = F.size("findings") > 0
    n_chars = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; what the mix doesn't take goes.

    A null or empty text has no words, so no mix takes it. Rows that repeat id and text are dealt out
    alike, null ids by their text, a null source is one of its own (the last); an empty table gives an empty one.
    """
    mixed = mixing.mix_sources(docs, keep=("text", "lang", "source", "n_chars"), whole=True)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    copies = F.explode(F.sequence(F.lit(1), times))
    return mixed.filter(times > 0).withColumn("copy", copies).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with a digest of what they decode to.

    A null text counts as null in the digest, an empty one has no ids. Texts of any length are encoded
    whole, repeated rows and null ids like any other; an empty table gives an empty one.
    """
    return pieces.digests(pieces.encode_texts(docs))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Stages fit models and run iterative joins, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
