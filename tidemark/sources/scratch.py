"""Tables in the folder that the cluster shares, for what is computed once and read more often."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    return folder.rstrip("/")


def folder(spark: SparkSession) -> str:
    """The application's own folder below it; what other jobs have stored there lies elsewhere."""
    return f"{root(spark)}/tidemark-{spark.sparkContext.applicationId}"


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written there and read again."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def _listed(spark: SparkSession, where: str) -> list:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.listStatus(p)) if fs.exists(p) else []


def state(spark: SparkSession, where: str) -> tuple:
    """What tells whether the files of a table have changed: names, sizes and times."""
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in _listed(spark, where)))


def exists(spark: SparkSession, where: str) -> bool:
    return bool(_listed(spark, where))


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has stored there; for the end of a job."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
