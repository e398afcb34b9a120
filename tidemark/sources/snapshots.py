"""Tables with snapshots: immutable Parquet files, and a numbered manifest for each state of the table.

A write adds files that nobody sees, then publishes the next manifest under its number. Publishing
fails if that number is there already, so of two writers one wins and the other looks at what has
come in between and tries again: a key is inserted once, whoever writes. Readers see the files of
one manifest; what a failed or lost write leaves is in none.

A file belongs to a bucket of the table's keys, and its manifest entry tells the range of its first
key, so that a write reads only files that may hold its own keys.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import first_of_each


class Lost(Exception):
    """Another writer has published this number."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    files: list[dict]  # path, rows, bucket, low and high of the first key


class SnapshotTable:
    """A table at `path` with unique keys: key columns, whose first is the range key, and buckets by a hash of all of them.

    `schema` is needed by the first write only. One bucket suits tables that grow along their first
    key, as time; many suit keys without an order.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 1):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # the store ------------------------------------------------------------------------------
    def _fs(self, name: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _publish(self, number: int, files: list[dict], schema: str) -> None:
        """Writes a manifest aside and renames it to its number, which doesn't replace one that is there."""
        jvm = self.spark.sparkContext._jvm
        fs, aside = self._fs(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(json.dumps({"files": files, "schema": schema}).encode())
        out.close()
        _, target = self._fs(f"manifests/{number:012d}.json")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if fs.getScheme() == "file":  # a link can't replace a file, where a local rename would look first and then move
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            else:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, target, none)
        except Exception as e:
            if not isinstance(e, FileExistsError) and "AlreadyExists" not in str(e):
                raise
            raise Lost(number) from e
        finally:
            fs.delete(aside, False)

    def _numbers(self) -> list[int]:
        fs, folder = self._fs("manifests")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[0] != ".")

    def _manifest(self, number: int) -> dict:
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    # reading --------------------------------------------------------------------------------
    def snapshot(self, number: int | None = None) -> Snapshot:
        """The state of that number, or the last one; 0 is the empty table."""
        number = max(self._numbers(), default=0) if number is None else number
        return Snapshot(number, self._manifest(number)["files"] if number else [])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot."""
        s = self.snapshot(number)
        if not s.number:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        return self._rows(s.files, self._manifest(s.number)["schema"])

    def _rows(self, files: list[dict], schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.path}/{f['path']}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def history(self) -> list[int]:
        return self._numbers()

    # writing --------------------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _spans(self, df: DataFrame) -> dict[int, tuple]:
        """Range of the first key in each bucket: a row a bucket."""
        k = F.col(self.key[0])
        return {r[0]: (r[1], r[2]) for r in df.groupBy(self._bucket().alias("b")).agg(F.min(k), F.max(k)).collect()}

    def _write(self, df: DataFrame) -> list[dict]:
        """Adds files of `df` below data/, and returns what a manifest tells of them; one row a file comes to the driver."""
        folder = f"data/{uuid.uuid4().hex}"
        where = f"{self.path}/{folder}"
        dealt = df.withColumn("bucket_", self._bucket())
        dealt = dealt.repartition("bucket_") if self.buckets > 1 else dealt
        keyed = dealt.sortWithinPartitions("bucket_", *self.key).write.partitionBy("bucket_")
        keyed.options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in self.key}).parquet(where)
        found = self.spark.read.schema(f"{df.select(*self.key).schema.simpleString()[7:-1].replace(':', ' ')}, bucket_ int").parquet(where)
        name = F.regexp_extract(F.input_file_name(), r"(bucket_=[^/]+/[^/]+)$", 1)
        rows = found.groupBy(name.alias("f"), "bucket_").agg(F.count("*").alias("n"), F.min(self.key[0]).alias("low"), F.max(self.key[0]).alias("high")).collect()
        return [{"path": f"{folder}/{r['f']}", "rows": r["n"], "bucket": r["bucket_"], "low": _plain(r["low"]), "high": _plain(r["high"])} for r in sorted(rows, key=lambda r: r["f"])]

    def touched(self, files: list[dict], spans: dict[int, tuple]) -> list[dict]:
        """Files that may hold a key of these buckets and ranges."""
        return [f for f in files if f["bucket"] in spans and not (f["high"] < _plain(spans[f["bucket"]][0]) or f["low"] > _plain(spans[f["bucket"]][1]))]

    def insert_or_ignore(self, incoming: DataFrame, order: list[str], attempts: int = 20) -> int:
        """Adds the rows with keys that the table doesn't have, of several with one key the first in `order`; returns the
        new snapshot's number. Rows with a null key can't be told apart and are an error."""
        self._no_nulls(incoming)
        rows = first_of_each(incoming, self.key, order)
        spans, schema, tried = self._spans(incoming), _ddl(incoming), None
        for _ in range(attempts):
            now = self.snapshot()
            old = self.touched(now.files, spans)
            if tried is not None:  # only what came in between can hold keys of the rows that were written
                fresh = self.touched([f for f in now.files if f["path"] not in {x["path"] for x in tried[0]}], spans)
                keep = tried[1] if not fresh else None
            else:
                keep = None
            if keep is None:
                keep = self._write(rows.join(self._rows(old, schema).select(*self.key), self.key, "left_anti"))
            try:
                self._publish(now.number + 1, now.files + keep, schema)
                return now.number + 1
            except Lost:
                tried = (now.files, keep)
        raise Lost(f"{attempts} attempts at {self.path}")

    def upsert(self, incoming: DataFrame, order: list[str], attempts: int = 20) -> int:
        """Puts rows in place of those with their keys, of several with one key the first in `order`. Files that may hold
        one of the keys are written anew, the others stay."""
        self._no_nulls(incoming)
        rows = first_of_each(incoming, self.key, order)
        spans, schema = self._spans(incoming), _ddl(incoming)
        for _ in range(attempts):
            now = self.snapshot()
            old = self.touched(now.files, spans)
            kept = self._rows(old, schema).join(rows.select(*self.key), self.key, "left_anti")
            made = self._write(kept.unionByName(rows))
            gone = {f["path"] for f in old}
            try:
                self._publish(now.number + 1, [f for f in now.files if f["path"] not in gone] + made, schema)
                return now.number + 1
            except Lost:
                continue
        raise Lost(f"{attempts} attempts at {self.path}")

    def delete(self, condition: Column, attempts: int = 20) -> int:
        """Takes the rows for which the condition holds out; nulls in it keep a row."""
        for _ in range(attempts):
            now = self.snapshot()
            schema = self._manifest(now.number)["schema"]
            hit = self._rows(now.files, schema).filter(condition).select(F.input_file_name().alias("f")).distinct().collect()  # one row a file
            names = {r["f"].rsplit("/data/", 1)[1] for r in hit}
            old = [f for f in now.files if f["path"].removeprefix("data/") in names]
            made = self._write(self._rows(old, schema).filter(~F.coalesce(condition, F.lit(False)))) if old else []
            try:
                self._publish(now.number + 1, [f for f in now.files if f not in old] + made, schema)
                return now.number + 1
            except Lost:
                continue
        raise Lost(f"{attempts} attempts at {self.path}")

    def has_range(self, low, high) -> bool:
        """Whether any row's first key is in [low, high); files that lie wholly inside answer without being read."""
        s = self.snapshot()
        if any(_plain(low) <= f["low"] and f["high"] < _plain(high) for f in s.files):
            return True
        near = [f for f in s.files if f["high"] >= _plain(low) and f["low"] < _plain(high)]
        return bool(near) and not self._rows(near, self._manifest(s.number)["schema"]).filter((F.col(self.key[0]) >= low) & (F.col(self.key[0]) < high)).limit(1).isEmpty()

    def _no_nulls(self, df: DataFrame) -> None:
        anywhere = F.lit(False)
        for c in self.key:
            anywhere = anywhere | F.col(c).isNull()
        if not df.filter(anywhere).limit(1).isEmpty():
            raise ValueError("a key is null")


def _plain(x):
    return x.isoformat() if hasattr(x, "isoformat") else x


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
