"""A live feed of text messages over web sockets as a stream that can be replayed.

A web socket can't be asked again for what it has sent. So what the stream's driver receives is first
written to a log in the shared folder, a segment a batch, and offsets are numbers of segments: a
batch that is tried again, also after a restart, reads the same segments, by tasks of its own. Segments go
when their batch is committed. A connection that breaks is opened again, with growing pauses.
"""

from __future__ import annotations

import base64
import json
import os
import socket
import ssl
import time
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: what the protocol (RFC 6455) adds to a key before it is hashed.
_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


class WebSocket:
    """A client's side of the protocol: text messages, fragments, pings and closing."""

    def __init__(self, url: str, timeout: float = 5.0):
        at = urlsplit(url)
        port = at.port or (443 if at.scheme == "wss" else 80)
        self.socket = socket.create_connection((at.hostname, port), timeout)
        if at.scheme == "wss":
            self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=at.hostname)
        self.buffer, self.parts = b"", []
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.socket.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.hostname}:{port}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        while b"\r\n\r\n" not in self.buffer:
            self._more()
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        if b" 101 " not in head.split(b"\r\n")[0] or base64.b64encode(sha1((key + _GUID).encode()).digest()) not in head:
            raise ConnectionError("the server doesn't take up web sockets")

    def _more(self) -> None:
        data = self.socket.recv(1 << 16)
        if not data:
            raise ConnectionError("closed")
        self.buffer += data

    def _send(self, kind: int, payload: bytes) -> None:
        mask = os.urandom(4)
        self.socket.sendall(bytes([0x80 | kind, 0x80 | len(payload)]) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(payload)))

    def _frame(self) -> tuple[bool, int, bytes] | None:
        """The next whole frame of what has come in: whether it ends a message, its kind, its payload."""
        b = self.buffer
        if len(b) < 2:
            return None
        size, at = b[1] & 0x7F, 2
        if size > 125:
            wide = 2 if size == 126 else 8
            if len(b) < at + wide:
                return None
            size, at = int.from_bytes(b[at : at + wide], "big"), at + wide
        mask = b""
        if b[1] & 0x80:
            mask, at = b[at : at + 4], at + 4
        if len(b) < at + size:
            return None
        payload, self.buffer = b[at : at + size], b[at + size :]
        return bool(b[0] & 0x80), b[0] & 0x0F, bytes(x ^ mask[i % 4] for i, x in enumerate(payload)) if mask else payload

    def receive(self, wait: float) -> str | None:
        """The next message; None if none has come whole within `wait` seconds, whose beginning is kept."""
        self.socket.settimeout(wait)
        while True:
            frame = self._frame()
            if frame is None:
                try:
                    self._more()
                except TimeoutError:
                    return None
                continue
            last, kind, payload = frame
            if kind == 8:
                raise ConnectionError("closed by the server")
            if kind == 9:
                self._send(10, payload)
            elif kind in (0, 1, 2):
                self.parts.append(payload)
                if last:
                    whole, self.parts = b"".join(self.parts), []
                    return whole.decode()

    def close(self) -> None:
        self.socket.close()


class _Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.urls, self.uri = options["urls"].split(), options["log"]
        self.fs, self.folder = pafs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.poll, self.most = float(options.get("poll", "1.0")), int(options.get("messages", "100000"))
        self.open: dict[str, WebSocket] = {}
        self.pause: dict[str, tuple[float, float]] = {}  # when to try again, and the pause before that

    def __getstate__(self) -> dict:  # sockets don't travel: tasks get the reader without them
        return {k: v for k, v in self.__dict__.items() if k not in ("fs", "open", "pause")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, open={}, pause={}, fs=pafs.FileSystem.from_uri(state["uri"])[0])

    def _numbers(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.folder))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".jsonl"))

    def _done(self) -> int:
        found = self.fs.get_file_info(pafs.FileSelector(self.folder))
        return max((int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".done")), default=0)

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def _listen(self) -> list[str]:
        """Messages of up to `poll` seconds; each connection is read in turn."""
        lines, until = [], time.monotonic() + self.poll
        while time.monotonic() < until and len(lines) < self.most:
            for url in self.urls:
                if url not in self.open:
                    at, pause = self.pause.get(url, (0.0, 0.1))
                    if time.monotonic() < at:
                        continue
                    try:
                        self.open[url] = WebSocket(url)
                    except OSError:
                        self.pause[url] = (time.monotonic() + pause, min(30.0, 2 * pause))
                        continue
                try:
                    while len(lines) < self.most and (m := self.open[url].receive(0.02)) is not None:
                        lines.append(json.dumps({"source": url, "received": time.time_ns() // 1_000_000, "value": m}))
                        self.pause.pop(url, None)
                except OSError:
                    self.open.pop(url).close()
            if not self.open:
                time.sleep(0.02)
        return lines

    def latestOffset(self) -> dict:
        """What has come in is written before it is counted; a segment appears whole or not at all."""
        last = max([self._done(), *self._numbers()])
        lines = self._listen()
        if lines:
            last += 1
            aside = f"{self.folder}/{last:012d}.part"
            with self.fs.open_output_stream(aside) as f:
                f.write(("\n".join(lines) + "\n").encode())
            self.fs.move(aside, f"{self.folder}/{last:012d}.jsonl")
        return {"segment": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Segment(f"{self.folder}/{n:012d}.jsonl") for n in range(start["segment"] + 1, end["segment"] + 1)]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        with self.fs.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                r = json.loads(line)
                yield (r["source"], r["received"], r["value"])

    def commit(self, end: dict) -> None:
        """Segments of committed batches go; an empty mark keeps their number."""
        old = [n for n in self._numbers() if n <= end["segment"]]
        if old:
            before = self._done()
            with self.fs.open_output_stream(f"{self.folder}/{max(old):012d}.done"):
                pass
            for n in old:
                self.fs.delete_file(f"{self.folder}/{n:012d}.jsonl")
            if before and before != max(old):
                self.fs.delete_file(f"{self.folder}/{before:012d}.done")

    def stop(self) -> None:
        for s in self.open.values():
            s.close()


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "source string, received long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options)


def feed(spark: SparkSession, urls: list[str], log: str, poll_seconds: float = 1.0, messages: int = 100_000) -> DataFrame:
    """Messages of web sockets as a stream (source, received in ms, value), at most about `messages` a batch.

    `log` is a folder of this stream alone, that the cluster shares. Within a batch the driver's
    source process holds the messages once. What a server sends while no connection is open is lost
    unless the server sends it again. `files.parse_envelopes` takes the values.
    """
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feed").option("urls", " ".join(urls)).option("log", log).option("poll", str(poll_seconds)).option("messages", str(messages)).load()
