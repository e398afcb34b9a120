"""A stream's rows as JSON lines that appear batch by batch, whole and once.

Tasks write files of their own below `parts`. When all have ended the driver publishes the batch: a file with its
number that lists them. A batch that is tried again publishes under the same number, so its first list stands or is
replaced by one of the same rows; what a failed task leaves is in no list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        first = next(rows, None)
        if first is None:
            return Written(None, 0)
        fs.create_dir(f"{folder}/parts", recursive=True)
        name, n = f"parts/{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            row: Row | None = first
            while row is not None:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                n += 1
                row = next(rows, None)
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(f"{folder}/batches", recursive=True)
        files = sorted(m.path for m in messages if m is not None and m.path)
        aside = f"{folder}/batches/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps({"files": files, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        fs.move(aside, f"{folder}/batches/{batchId:012d}.json")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(f"{folder}/{m.path}")


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return OutboxWriter(self.options)


def stream_to_outbox(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts writing a stream below `path`, a URI of a folder that the cluster shares."""
    df.sparkSession.dataSource.register(Outbox)
    out = df.writeStream.format("outbox").option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start(path)


def read_outbox(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all published batches."""
    fs, folder = pafs.FileSystem.from_uri(path.rstrip("/"))
    batches = fs.get_file_info(pafs.FileSelector(f"{folder}/batches", allow_not_found=True))
    files = []
    for b in sorted(x.path for x in batches if x.base_name.endswith(".json") and x.base_name[0] != "."):
        with fs.open_input_stream(b) as f:
            files += json.loads(f.read())["files"]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{f}" for f in files])
