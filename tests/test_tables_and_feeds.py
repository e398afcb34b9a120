"""Snapshots under concurrent writers, and a live feed that breaks off and is started again."""

import base64
import hashlib
import json
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feed, files, paged
from tidemark.sources.snapshots import Lost, SnapshotTable

H = 3_600_000


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_insert_or_ignore_keeps_the_first_write(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", ["time", "symbol"])
    d = lambda *r: spark.createDataFrame(r, "time long, symbol string, v int")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.insert_or_ignore(d((1, "a", 5), (1, "a", 4), (2, "a", 7)), ["v"]) == 1
    assert t.insert_or_ignore(d((2, "a", 0), (2, "b", 1)), ["v"]) == 2
    assert rows(t.read()) == [(1, "a", 4), (2, "a", 7), (2, "b", 1)]
    assert rows(t.read(1)) == [(1, "a", 4), (2, "a", 7)] and t.history() == [1, 2]  # what was there before can still be read
    assert t.insert_or_ignore(d(), ["v"]) == 3 and t.read().count() == 3
    with pytest.raises(ValueError):
        t.insert_or_ignore(d((None, "a", 1)), ["v"])
    t.delete(F.col("v") == 7)
    assert rows(t.read()) == [(1, "a", 4), (2, "b", 1)]


def test_two_writers_leave_each_key_once(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []

    def work(k):
        try:
            mine = SnapshotTable(spark, path, ["time"])
            for part in range(3):
                mine.insert_or_ignore(spark.range(part * 40, part * 40 + 60).select(F.col("id").alias("time"), F.lit(k).alias("who")), ["who"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = SnapshotTable(spark, path, ["time"])
    assert not failed and t.history() == list(range(1, 10))
    got = [r["time"] for r in t.read().collect()]
    assert sorted(got) == list(range(140))


def test_a_number_is_published_once(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", ["k"])
    t._publish(1, [], "k int")
    with pytest.raises(Lost):
        t._publish(1, [], "k int")
    assert t.history() == [1] and t.read().count() == 0


def test_writes_touch_only_files_that_may_hold_their_keys(spark, tmp_path):
    days = SnapshotTable(spark, f"file://{tmp_path}/days", ["time"])
    for day in range(5):
        days.insert_or_ignore(spark.range(day * 24, day * 24 + 24).select((F.col("id") * H).alias("time")), ["time"])
    s = days.snapshot()
    assert len(days.touched(s.files, {0: (96 * H, 119 * H)})) < len(s.files) / 4  # a day's append opens that day's files
    assert days.has_range(24 * H, 48 * H) and not days.has_range(120 * H, 999 * H) and not days.has_range(5 * H + 1, 6 * H)
    v = SnapshotTable(spark, f"file://{tmp_path}/v", ["id"], buckets=8)
    d = lambda ids, x: spark.createDataFrame([(f"c{i}", x) for i in ids], "id string, x int")
    v.upsert(d(range(200), 1), ["x"])
    before = {f["path"] for f in v.snapshot().files}
    v.upsert(d([7, 999], 2), ["x"])
    after = {f["path"] for f in v.snapshot().files}
    assert len(before & after) >= 6 and v.read().count() == 201  # at most two buckets are written anew
    assert dict(rows(v.read().filter("x = 2"))) == {"c7": 2, "c999": 2}


def test_pages_by_slices_of_time(spark):
    series = [(t * 100, float(t * t), 1.0) for t in range(1, 60) if not 20 <= t < 33]
    fetch = lambda end, limit: [r for r in series if r[0] <= end][-limit:]
    whole = rows(paged.read_open_interest(spark, fetch, 300, 5000, 5))
    cut = paged.read_open_interest(spark, fetch, 300, 5000, 5, slice_ms=700)
    assert rows(cut) == whole and len(whole) > 30
    assert [(s.start_ms, s.end_ms) for s in paged.slices(300, 1500, 700)] == [(300, 699), (700, 1399), (1400, 1500)]
    assert paged.read_open_interest(spark, fetch, 5, 1, 5, slice_ms=700).count() == 0


class Server(threading.Thread):
    """A web socket server that breaks off after some messages and goes on with the next one when it is asked again."""

    def __init__(self, messages, per_connection):
        super().__init__(daemon=True)
        self.messages, self.per, self.at, self.connections = messages, per_connection, 0, 0
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.port = self.listener.getsockname()[1]
        self.go = threading.Event()
        self.upto = 0

    def run(self):
        while True:
            c, _ = self.listener.accept()
            self.connections += 1
            try:
                self.serve(c)
            except OSError:
                pass
            c.close()

    def serve(self, c):
        head = b""
        while b"\r\n\r\n" not in head:
            head += c.recv(4096)
        key = next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Sec-WebSocket-Key"))
        accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
        c.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
        c.sendall(b"\x89\x02hi")  # a ping
        for n in range(self.per):
            while self.at >= self.upto:
                time.sleep(0.01)
            data = self.messages[self.at].encode()
            if n % 3 == 2:  # in fragments, which come in pieces
                c.sendall(b"\x01" + bytes([10]) + data[:4])
                time.sleep(0.05)
                c.sendall(data[4:10] + b"\x80" + self.size(len(data) - 10) + data[10:])
            else:
                c.sendall(b"\x81" + self.size(len(data)) + data)
            self.at += 1
        time.sleep(0.05)

    @staticmethod
    def size(n):
        return bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n)


def test_a_feed_that_breaks_off_and_is_started_again(spark, tmp_path):
    envelope = lambda i: json.dumps({"stream": "btcusdt@trade", "data": {"p": str(100 + i), "q": "1", "T": i, "pad": "x" * (i % 5) * 60}})
    server = Server([envelope(i) for i in range(60)], 7)
    server.start()
    log, seen = f"file://{tmp_path}/log", f"{tmp_path}/rows"

    def start(fail_at=None):
        def write(batch, number):
            if fail_at is not None and number >= fail_at:
                raise RuntimeError("lost in the middle of a batch")
            batch.write.mode("overwrite").parquet(f"{seen}/batch={number}")

        ticks = files.parse_envelopes(feed.feed(spark, [f"ws://127.0.0.1:{server.port}/ws"], log, 0.4))
        return ticks.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/check").start()

    def until(condition, query, seconds=60):
        end = time.monotonic() + seconds
        while not condition() and time.monotonic() < end and query.isActive:
            time.sleep(0.2)

    server.upto = 30
    q = start(fail_at=1)
    until(lambda: False, q)  # the second batch fails and the query ends
    assert not q.isActive and q.exception() is not None
    server.upto = 60
    q = start()
    count = lambda: spark.read.parquet(seen).count() if any((tmp_path / "rows").glob("batch=*/part*")) else 0
    until(lambda: server.at == 60 and count() >= 60, q)
    q.stop()
    got = [r["trade_time"] for r in spark.read.parquet(seen).select(F.col("trade_time").cast("string").alias("trade_time")).collect()]
    assert len(got) == len(set(got)) == 60 and server.connections > 5
    left = list((tmp_path / "log").glob("*.jsonl"))
    assert len(left) <= 2  # segments of committed batches are gone


def test_an_outbox_shows_whole_batches_once(spark, tmp_path):
    from tidemark.sources import outbox

    for part in range(3):
        spark.range(part * 10, part * 10 + 10).selectExpr("id", "concat('é', id) AS name").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").repartition(3)
    where = f"file://{tmp_path}/out"
    assert outbox.read_outbox(spark, where, "id long, name string").count() == 0
    outbox.stream_to_outbox(stream(), where, f"{tmp_path}/check").awaitTermination()
    got = rows(outbox.read_outbox(spark, where, "id long, name string"))
    assert got == [(i, f"é{i}") for i in range(30)] and len(list((tmp_path / "out" / "batches").glob("*.json"))) == 3
    # a batch whose publishing was lost is written again: its files from before are in no list
    (tmp_path / "check" / "commits" / "2").unlink()
    (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    (tmp_path / "out" / "batches" / f"{2:012d}.json").unlink()
    outbox.stream_to_outbox(stream(), where, f"{tmp_path}/check").awaitTermination()
    assert rows(outbox.read_outbox(spark, where, "id long, name string")) == got
    writer = outbox.OutboxWriter({"path": where})
    made = writer.write(iter([]))
    assert made.rows == 0 and made.path is None
    part = writer.write(iter([__import__("pyspark").sql.Row(id=1, name="x")]))
    writer.abort([part, None], 9)
    assert not (tmp_path / "out" / part.path).exists()
