"""What the corpus operators share: word patterns, scratch tables, input hygiene."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word by white space: a run of characters other than space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's own part of the shared folder."""
    return f"{scratch_root(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrowed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, under names of its own, so that others can't clash."""
    return docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[c].alias(c) for c in more)
    )


def word_count(text: Column) -> Column:
    """Words of a text by `WORD`; null counts as empty. Cutting at white space costs a fraction of collecting matches."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")
