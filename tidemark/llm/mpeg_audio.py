"""Media columns of MPEG audio: payloads as layer III streams, and a reader for tags, frames and tables.

`pack` stores bytes as the ancillary data of silent 48 kHz mono frames (an empty granule ends at
once, and what is left of a frame is free for data), each with its checksum, behind an ID3v2 tag and
a variable-bitrate table and before an ID3v1 tag. A frame lasts 24 ms exactly. The last data frame
takes the least bitrate that holds what remains, so streams vary in bitrate.

`parse` reads any stream of MPEG 1, 2 or 2.5 and layers I to III: it reads ID3v2 tags of versions 2 to
4 (unsynchronised ones and extended headers too), APE tags at either end and ID3v1, resynchronises on
a header that another header or the end follows, verifies the checksums of layers I and III, reads
Xing, Info and VBRI tables with an encoder's delay and padding, and lists frame offsets and exact
durations. A free-format frame is as long as the way to the next header of its kind. What layer II
covers with its checksum depends on allocation tables that aren't read, so those aren't verified.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import narrowed, stored

#: Fixed values of the format: kilobits a second by index for (MPEG 1?, layer), hertz of MPEG 1, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
BLOCK = 64
_KEY = "payload"
_SIDE = 17  # bytes of side information of a mono MPEG 1 layer III frame
_SLICE = 256


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    checked: bool
    bitrate: int
    rate: int
    size: int
    samples: int
    mono: bool
    covered: int = 0  # bytes behind the checksum that it covers, 0 where they aren't known
    padding: int = 0  # bytes that a free-format frame has besides its usual size

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        """Where a layer III frame's main data begins."""
        return 4 + 2 * self.checked + self.side


@lru_cache(4096)
def read_header(four: bytes) -> Header | None:
    """A frame header; None if the four bytes aren't one. A free-format frame has bitrate and size 0."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = (four[1] >> 3) & 3, 4 - ((four[1] >> 1) & 3)
    kbps, hertz = four[2] >> 4, (four[2] >> 2) & 3
    if version == 1 or layer == 4 or kbps == 15 or hertz == 3 or four[3] & 3 == 2:
        return None
    mpeg1 = version == 3
    bitrate = BITRATES[mpeg1, layer][kbps]
    rate = RATES[hertz] // {3: 1, 2: 2, 0: 4}[version]
    samples, padding = SAMPLES[mpeg1, layer], (four[2] >> 1) & 1
    size = (12 * bitrate * 1000 // rate + padding) * 4 if layer == 1 else samples * bitrate * 125 // rate + padding
    mode, bound = four[3] >> 6, 4 * ((four[3] >> 4 & 3) + 1)
    mono = mode == 3
    allocation = 16 if mono else 32 if mode != 1 else 16 + bound // 2  # four bits a subband and channel, shared from the bound on
    covered = {1: allocation, 3: (17 if mono else 32) if mpeg1 else (9 if mono else 17)}.get(layer, 0)
    return Header(mpeg1, layer, not four[1] & 1, bitrate, rate, size if bitrate else 0, samples, mono, covered, padding * (4 if layer == 1 else 1))


@lru_cache(4096)
def checksum(covered: bytes) -> int:
    """CRC-16 (polynomial 0x8005, from all ones) of the header's last two bytes and the side information."""
    crc = 0xFFFF
    for b in covered:
        crc ^= b << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _frame(index: int, data: bytes) -> bytes:
    """A checked 48 kHz mono MPEG 1 layer III frame of silence with `data` behind its side information."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(_SIDE)
    frame = head + checksum(head[2:] + side).to_bytes(2, "big") + side + data
    return frame + bytes(3 * BITRATES[True, 3][index] - len(frame))


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def _tag(values: dict[str, str]) -> bytes:
    body = b""
    for key, value in values.items():
        text = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


_ROOM = [3 * kbps - 6 - _SIDE for kbps in BITRATES[True, 3]]


def pack(data: bytes) -> bytes:
    """The stream that stores `data` with zeros up to a positive multiple of `BLOCK` bytes."""
    payload = data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))
    full = _ROOM[14]
    frames = []
    for at in range(0, len(payload), full):
        part = payload[at : at + full]
        frames.append(_frame(next(i for i in range(1, 15) if _ROOM[i] >= len(part)), part))
    total, n = sum(map(len, frames)) + 192, len(frames)
    # all but the last frame are of one size, so the place of each hundredth of the time is known
    toc = bytes(min(255, 256 * (192 + n * p // 100 * len(frames[0])) // total) for p in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    first = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0)) + bytes(_SIDE) + table
    first += bytes(192 - len(first))
    end = b"TAG" + str(len(data)).encode().ljust(124, b"\0") + b"\xff"
    return b"".join([_tag({_KEY: str(len(data))}), first, *frames, end])


@dataclass
class Stream:
    """What `parse` found: frame offsets and headers, tags, the table, skipped bytes and failed checksums."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    table: dict | None = None
    skipped: int = 0
    checked: int = 0
    failed: int = 0
    sizes: list[int] = field(default_factory=list)

    @property
    def seconds(self) -> Fraction:
        """Exact, without what the encoder says it put before and behind the sound."""
        spare = sum(map((self.table or {}).get, ("delay", "padding"), (0, 0)))
        whole = sum((Fraction(h.samples, h.rate) for h in self.headers), Fraction(0))
        return max(Fraction(0), whole - Fraction(spare, self.headers[0].rate)) if self.headers else whole


def _number(b: bytes) -> int:
    """A syncsafe number."""
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _read_tag(data: bytes, tags: dict[str, str]) -> int:
    """Reads the ID3v2 tag at the start; returns where it ends. Names of version 2 have three letters."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags = data[3], data[5]
    size = _number(data[6:10])
    end = min(len(data), 10 + size + 10 * bool(flags & 16))
    body = data[10 : min(len(data), 10 + size)]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 64 and len(body) >= 4 and version > 2:
        at = _number(body) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    letters, width, head = (3, 3, 6) if version == 2 else (4, 4, 10)
    while at + head <= len(body) and body[at] != 0:
        raw = body[at + letters : at + letters + width]
        n = _number(raw) if version == 4 else int.from_bytes(raw, "big")
        name, value = body[at : at + letters].decode("latin-1"), body[at + head : at + head + n]
        how = body[at + 9] if version == 4 else 0
        if how & 2 or version == 4 and flags & 128:
            value = value.replace(b"\xff\x00", b"\xff")
        if how & 1:
            value = value[4:]  # its length without these marks
        if name[0] == "T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace")
            key, _, rest = text.rstrip("\0").partition("\0")
            own = name in ("TXXX", "TXX")
            tags[key if own else name] = rest.lstrip("\ufeff") if own else text.rstrip("\0")
        at += head + n
    return end


def _read_items(data: bytes, at: int, items: int, tags: dict[str, str]) -> None:
    """Reads an APE tag's text items."""
    for _ in range(items):
        n, kind = int.from_bytes(data[at : at + 4], "little"), data[at + 4 : at + 8]
        stop = data.find(b"\0", at + 8)
        if len(kind) < 4 or stop < 0:
            return
        if kind[0] & 6 == 0:
            tags[data[at + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
        at = stop + 1 + n


def _read_ape(data: bytes, low: int, high: int, tags: dict[str, str]) -> tuple[int, int]:
    """Reads APE tags at either end of a range; returns the range without them."""
    if data[high - 32 : high - 24] == b"APETAGEX" and high - 32 >= low:
        size, items, flags = (int.from_bytes(data[high - k : high - k + 4], "little") for k in (20, 16, 12))
        _read_items(data, high - size, items, tags)
        high = max(low, high - size - 32 * (flags >> 31))
    if data[low : low + 8] == b"APETAGEX":
        size, items = (int.from_bytes(data[low + k : low + k + 4], "little") for k in (12, 16))
        _read_items(data, low + 32, items, tags)
        low = min(high, low + 32 + size)
    return low, high


def _read_table(frame: bytes, h: Header) -> dict | None:
    for at in (4 + h.side, h.body):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out = {}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    out[name] = frame[at : at + size] if name == "toc" else int.from_bytes(frame[at : at + size], "big")
                    at += size
            if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= at + 24:
                both = int.from_bytes(frame[at + 21 : at + 24], "big")
                out |= {"encoder": frame[at : at + 9].rstrip(b"\0 ").decode("latin-1"), "delay": both >> 12, "padding": both & 0xFFF}
            return out
    if frame[36:40] == b"VBRI":
        return {"bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return None


def _free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a free-format frame without padding: the way to the next header of its kind that another such way follows."""
    kind, there = (h.mpeg1, h.layer, h.rate, 0), at + 24
    while 0 <= (there := data.find(data[at : at + 2], there, min(end, at + 8192))):
        g = read_header(data[there : there + 4])
        if g and (g.mpeg1, g.layer, g.rate, g.bitrate) == kind:
            size = there - at - h.padding
            third = there + size + g.padding
            f = read_header(data[third : third + 4])
            if third == end or f and (f.mpeg1, f.layer, f.rate, f.bitrate) == kind:
                return size
        there += 1
    return 0


def parse(data: bytes) -> Stream:
    """Tags, table and frames of a stream; bytes that belong to none count as skipped."""
    s = Stream()
    at, end = _read_tag(data, s.tags), len(data)
    if data[end - 128 : end - 125] == b"TAG" and end - 128 >= at:
        end -= 128
        s.tags["id3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    at, end = _read_ape(data, at, end, s.tags)
    free = 0
    synced, stream = False, None  # stream: version, layer and rate, which all frames share
    kind = lambda h: h and (h.mpeg1, h.layer, h.rate)
    while at + 4 <= end:
        h = read_header(data[at : at + 4])
        if h and not h.size:
            free = free or _free_size(data, at, end, h)
        size = h.size or free + h.padding if h else 0
        after = at + size
        sure = h and size >= 24 and after <= end and stream in (None, kind(h))
        sure = sure and (synced or after == end or kind(read_header(data[after : after + 4])) == kind(h))
        if not sure:
            synced = False
            there = data.find(b"\xff", at + 1, end)
            there = end if there < 0 else there
            s.skipped += there - at
            at = there
            continue
        synced, stream = True, kind(h)
        if not s.headers and s.table is None and h.layer == 3 and (t := _read_table(data[at:after], h)) is not None:
            s.table = t
        else:
            s.offsets.append(at)
            s.headers.append(h)
            s.sizes.append(size)
            if h.checked and h.covered:
                s.checked += 1
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.covered]
                s.failed += checksum(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        at = after
    s.skipped += max(0, end - at)
    return s


def unpack(data: bytes) -> tuple[bytes, int, Stream]:
    """The payload with its zeros, its length without them, and the parsed stream."""
    s = parse(data)
    size = int(s.tags[_KEY])
    body = b"".join([data[o + h.body : o + h.size] for o, h in zip(s.offsets, s.headers)])
    return body[: max(BLOCK, -(-size // BLOCK) * BLOCK)], size, s


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table doc_id, media with a row per input row: the stream of each whole text in UTF-8.

    A null text counts as empty, and an empty one is stored as `BLOCK` zeros. Equal texts have equal
    streams. Repeated rows and null ids are stored like any other; an empty table gives an empty
    one; other columns are ignored.
    """
    d = narrowed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                media = pa.array([pack((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), media], names=["doc_id", "media"])

    return stored(d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, media binary"), "media")


_OUT = [
    ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"),
    ("feature", pa.string(), "string"), ("n_frames", pa.int64(), "long"), ("duration_ms", pa.float64(), "double"),
    ("seek_offsets", pa.list_(pa.int64()), "array<long>"),
]


def _described(media: bytes) -> tuple:
    payload, size, s = unpack(media)
    table = s.table or {}
    rates = sorted({h.bitrate for h in s.headers})
    feature = (
        f"frames={len(s.headers)};samples={sum(h.samples for h in s.headers)};seconds={s.seconds};kbps={rates[0]}-{rates[-1]};"
        f"table_frames={table.get('frames')};table_bytes={table.get('bytes')};checked={s.checked};failed={s.failed};"
        f"skipped={s.skipped};seek_crc32={zlib.crc32(','.join(map(str, s.offsets)).encode()):08x}"
    )
    return (
        size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, len(s.headers), float(s.seconds * 1000), s.offsets,
    )


def describe_media(media: DataFrame) -> DataFrame:
    """What is read back from each stream of `store_media`: payload and stream digests, features, seek offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                columns = zip(*map(_described, part.column(1).to_pylist()))
                arrays = [pa.array(list(c), kind) for c, (_, kind, _) in zip(columns, _OUT)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *(n for n, _, _ in _OUT)])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} {k}" for n, _, k in _OUT)]))
