"""Context-triggered piecewise hashes: texts cut where a rolling hash says so, compared by edit distance.

A hash of the last seven bytes decides where a text is cut, so an edit moves no cut but those near
it. At block size 3 * 2^k a byte ends a chunk if its rolling hash is 3 * 2^k - 1 modulo that size;
cuts of a size are cuts of all smaller ones. The size of a text is the smallest that makes at most
`MOST` chunks, so a fingerprint covers the whole text and yet is short. It holds the signatures (18
bits a chunk) of that size and of the next one; two fingerprints are compared where they have a size
in common, by the edit distance of the signatures' chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import narrowed, stored

WINDOW, MOST, BASE = 7, 64, 3
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A spread number for each byte, by a multiplicative rule.
_SPREAD = ((np.arange(1, 257, dtype=np.uint64) * 0x9E3779B97F4A7C15) >> 29).astype(np.uint32)
#: Bytes that are hashed at once.
_SLICE = 1 << 22


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each byte with the six before it (fewer at the start)."""
    v = _SPREAD[data]
    h = v.copy()
    for back in range(1, min(WINDOW, len(v))):
        h[back:] += v[: len(v) - back] * np.uint32(pow(0x01000193, back, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _cuts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at the smallest size, and up to which 2^k each stays an end."""
    whole, ends, powers = np.frombuffer(data, np.uint8), [], []
    for at in range(0, len(data), _SLICE):
        lead = min(at, WINDOW - 1)
        h = _rolling(whole[at - lead : at + _SLICE])[lead:].astype(np.int64) + 1
        hit = np.flatnonzero(h % BASE == 0)
        u = h[hit] // BASE
        ends.append(hit + at + 1)
        powers.append(u & -u)
    return (np.concatenate(ends), np.concatenate(powers)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _signature(data: bytes, ends: np.ndarray) -> str:
    view, out, start = memoryview(data), [], 0
    for end in [*ends.tolist(), len(data)]:
        if end > start:
            x = zlib.crc32(view[start:end])
            out.append(_DIGITS[x & 63] + _DIGITS[x >> 6 & 63] + _DIGITS[x >> 12 & 63])
            start = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """`size:signature:signature at twice the size`; a null text is an empty one."""
    data = (text or "").encode()
    ends, powers = _cuts(data)
    k = 0
    while len(ends) >= MOST:
        k += 1
        stay = powers >= 1 << k
        ends, powers = ends[stay], powers[stay]
    return f"{BASE << k}:{_signature(data, ends)}:{_signature(data, ends[powers >= 2 << k])}"


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and replacements that turn a into b, a column of the table in the bits of one number."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0  # rows where the column rises by one, and where it falls
    for x in b:
        same = at.get(x, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(zero | up) & full, up & zero & full
        found += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(zero | right) & full, right & zero
    return found


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else 1 less the edit distance over the longer signature; 0 without a size in common."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    if m == n:
        x, y = a1, b1
    elif int(m) == 2 * int(n):
        x, y = a1, b2
    elif 2 * int(m) == int(n):
        x, y = a2, b1
    else:
        return 0.0
    chunks = [[s[i : i + 3] for i in range(0, len(s), 3)] for s in (x, y)]
    longest = max(map(len, chunks))
    return 1.0 - edit_distance(*chunks) / longest if longest and all(chunks) else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first code points of `following`, or all."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _pair(text: str, own: str, following: str, other: str) -> tuple:
    changed = edited(text, following)
    changed_print = own if changed == text else fingerprint(changed)
    return hashlib.sha256(changed.encode()).hexdigest(), changed_print, likeness(own, changed_print), likeness(own, other)


_PAIR = [("edited_sha256", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]
_OWN = [("n_chars", pa.int64(), "long"), ("fingerprint", pa.string(), "string")]
_EDGE = [("part", pa.int32(), "int"), ("head", pa.string(), "string"), ("tail", pa.string(), "string")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the one after it; the first one's text is kept as head, the last one's as tail."""
    names = ["doc_id", *(n for n, _, _ in _OWN + _PAIR + _EDGE)]
    kinds = [k for _, k, _ in _OWN + _PAIR + _EDGE]
    part, held, head = TaskContext.get().partitionId(), None, None

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [kind, *kinds])], names=names)

    kind = None
    for batch in batches:
        rows, kind = [], batch.schema.field(0).type
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                head = text
            else:
                rows.append((held[0], len(held[1]), held[2], *_pair(held[1], held[2], text, own), part, head, None))
                head = None
            held = (i, text, own)
        if rows:
            yield made(rows, kind)
    if held is not None:
        yield made([(held[0], len(held[1]), held[2], None, None, None, None, part, head, held[1])], kind)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owns, texts, heads = (batch.column(c).to_pylist() for c in (2, 3, 4))
        rows = [_pair(text, own, head, fingerprint(head)) for own, text, head in zip(owns, texts, heads)]
        arrays = [pa.array([r[c] for r in rows], t) for c, (_, t, _) in enumerate(_PAIR)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], names=["doc_id", *(n for n, _, _ in _OWN + _PAIR)])


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each text, with those of its edited text and its likeness to that and to the next text.

    The next text is that of the row with the next greater id (after the last: the first); null ids
    come last, rows of one id go by a digest of the text, and rows that repeat both follow each
    other. The edited text is `edited(text, next text)`. A null text is an empty one, with the
    fingerprint `3::`; it is like only itself. A single row is its own next one. An empty table
    gives an empty one; other columns are ignored.

    Texts of any length are hashed whole, in slices of 4 MB. Rows are dealt out once, by ranges of
    (id, digest), and sorted; each task walks its range and leaves the texts at its two ends, which
    are joined afterwards.
    """
    d = narrowed(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = lambda fields: ", ".join([f"doc_id {kind}", *(f"{n} {k}" for n, _, k in fields)])
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest").asc_nulls_first(), F.col("at")]
    keyed = d.withColumn("digest", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = stored(ranges.mapInArrow(_walk, schema(_OWN + _PAIR + _EDGE)), "piecewise")
    tails, heads = walked.filter(F.col("tail").isNotNull()), walked.filter(F.col("head").isNotNull())
    parts = heads.select("part").distinct()  # one row a task
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = parts.select("part", following.alias("next_part"))
    open_rows = tails.drop("head").join(pairs, "part").join(heads.select(F.col("part").alias("next_part"), "head"), "next_part")
    closed = open_rows.select("doc_id", "n_chars", "fingerprint", "tail", "head").mapInArrow(_close, schema(_OWN + _PAIR))
    return walked.filter(F.col("tail").isNull()).drop("part", "head", "tail").unionByName(closed)
