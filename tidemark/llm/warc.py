"""WARC archives: written with an index of byte ranges, read back by coalesced ranges of the index.

Each task writes gzip members, one a record, into files of its own in the shared folder, and
returns an index row per record: file, offset, length, URL and digest. The index is a table, so a
task that is run again leaves at most a file that nothing refers to. To read, index rows are dealt
out by ranges of (file, offset), as many as the archives' bytes ask for, and sorted; ranges that lie
near each other become one read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored

LEAST_BYTES = 100  # a smaller payload is never a revisit
FILE_BYTES, READ_BYTES, GAP_BYTES = 128 << 20, 8 << 20, 64 << 10
#: Uncompressed bytes after which the records that were read leave a task.
SENT_BYTES = 16 << 20
#: Compressed bytes that a reading task gets, and up to how many shared digests (some 100 bytes each) are broadcast.
TASK_BYTES, FEW_DIGESTS = 8 << 20, 200_000
#: Where digests are too many for that, rows of one digest are dealt to so many tasks.
SALTS = 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("b7a1f6f2-5d0e-5c53-9d4e-3f5f6c1f4a10")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has no payload, and its HTTP header tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record's headers, with its payload (None for a revisit) and payload size."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    size = int(head["Content-Length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return head | {"payload": None if head["WARC-Type"] == "revisit" else payload, "payload_bytes": int(fields["Content-Length"])}


_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = record_bytes(r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["first"], r["revisit"])
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(data) + packer.flush()
                    out.write(member)
                    rows.append((f"{root}/{name}", at, len(member), r["page_id"], r["url"], r["digest"], "revisit" if r["revisit"] else "response"))
                    at += len(member)
                columns = zip(*rows) if rows else [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the index: file, offset, length, page_id, url, digest, record_type.

    Of equal payloads of at least `LEAST_BYTES` bytes the row with the smallest id is the response
    and the others revisit it; rows that repeat that id are responses too, and a row without an id
    is a revisit if any equal one has an id. A null payload is empty; a null URL has no header.
    Ids are whole numbers (another type is cast and has to fit). An empty table gives an empty
    index; other columns are ignored.

    Digests that pages share are found from narrow rows. Few are broadcast, so that no payload is
    shuffled; many are joined by digest, past which payloads too short for a revisit go unshuffled.
    """
    spark = pages.sparkSession
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.col("size") >= LEAST_BYTES
    same = p.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = stored(same.filter("n > 1").select("digest", "first"), "warc-digests")
    if same.count() <= FEW_DIGESTS:
        p = p.join(F.broadcast(same), "digest", "left").withColumn("first", F.when(long_enough, F.col("first")))
    else:
        short = p.filter(~long_enough).withColumn("first", F.lit(None).cast("long"))
        salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        own = p.filter(long_enough).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        p = own.join(salted, ["digest", "salt"], "left").drop("salt").unionByName(short)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.withColumn("revisit", revisit).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    rows = p.select("page_id", "url", "payload", "size", "digest", "first", "revisit")
    return stored(rows.mapInArrow(_writer(scratch(spark, "warc")), _INDEX), "warc-index")


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload binary, digest string, refers_to long"


def _members(run: list[tuple[str, int, int]]) -> Iterator[dict]:
    """The records of ranges that lie near each other in one file: one read, and one record unpacked at a time."""
    file, start = run[0][0], run[0][1]
    fs, path = _store(file)
    with fs.open_input_file(path) as f:  # random access, never decompressed
        data = memoryview(f.read_at(run[-1][1] + run[-1][2] - start, start))
    for _, offset, length in run:
        yield parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
    run: list[tuple[str, int, int]] = []
    for batch in batches:
        for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if run:
                last, end = run[-1], run[-1][1] + run[-1][2]
                near = file == last[0] and 0 <= offset - end <= GAP_BYTES and offset + length - run[0][1] <= READ_BYTES
                if not near:
                    yield run
                    run = []
            run.append((file, offset, length))
    if run:
        yield run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in batches of `SENT_BYTES` of payload, or one record more, however far they were compressed."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        number = lambda x: None if x is None else int(x)
        columns = [
            (pa.int64(), [number(r.get("X-Page-ID")) for r in rows]),
            (pa.string(), [r.get("WARC-Target-URI") for r in rows]),
            (pa.string(), [r["WARC-Type"] for r in rows]),
            (pa.int64(), [r["payload_bytes"] for r in rows]),
            (pa.binary(), [r["payload"] for r in rows]),
            (pa.string(), [r["WARC-Payload-Digest"].removeprefix("sha256:") for r in rows]),
            (pa.int64(), [number(r.get("X-Refers-To-Page")) for r in rows]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for k, v in columns], names=[f.split()[0] for f in _RECORD.split(", ")])

    rows: list[dict] = []
    size = 0
    for run in _runs(batches):
        for record in _members(run):
            rows.append(record)
            size += len(record["payload"] or b"") + 500
            if size >= SENT_BYTES:
                yield made(rows)
                rows, size = [], 0
    if rows:
        yield made(rows)


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of `index` point to: page_id, url, record_type, payload_bytes, payload, digest, refers_to.

    payload is null for a revisit; the URL is as in the header, with unsafe characters escaped. An
    index row whose archive is missing, or whose range isn't one record, raises an error.

    Payloads of any length are read whole. What a task holds is a read of `READ_BYTES` (or one
    record) and `SENT_BYTES` of payload (or one record more), even if pages compress a thousandfold.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read, _RECORD)


def digests(records: DataFrame) -> DataFrame:
    """Payload sizes and digests of records; a response's are taken from its payload anew."""
    own = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to FROM f"""
