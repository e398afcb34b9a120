"""Text of PDF files: a binary scan with parsers tried in order, the last one a plain local one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
#: Inside a content stream: a string, the end of an array or string that is shown, or a move to another line.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?(?=[\s\]\[(<])|[A-Za-z'\"*]+|\[|\]", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
_GAP = -200  # a shift in an array that stands for a space, in thousandths of the font's size


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.DOTALL)


def _shown(content: bytes) -> str:
    """What a content stream shows, a line for each move of the text's place; one byte is one character."""
    out: list[str] = []
    pending: list[str] = []
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] == b"(":
            pending.append(_unescaped(t[1:-1]).decode("latin-1"))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1]).decode()
            pending.append(bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("latin-1"))
        elif t[:1] in b"-0123456789":
            if pending and float(t) < _GAP:
                pending.append(" ")
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out += ["\n"] * (t in (b"'", b'"')) + pending
            pending = []
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            pending = []
        elif t not in (b"[", b"]"):
            pending = []
    return "".join(out)


def pdf_text(data: bytes) -> str | None:
    """Text of a PDF's uncompressed and deflated content streams, in the file's order; None if it has none.

    Fonts with encodings of their own and encrypted files aren't read.
    """
    if not data.startswith(b"%PDF-"):
        return None
    parts = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" in body and b"ET" in body:
            parts.append(_shown(body))
    text = re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", "\n".join(parts))).strip()
    return text or None


def read_pdfs(spark: SparkSession, path: str, parsers: tuple[Callable[[bytes], str | None], ...] = (pdf_text,)) -> DataFrame:
    """(file_path, text, parser) of each PDF below `path`: of the parsers, the first that gives text and its place.

    A hosted parser can stand before the local one: one that fails or gives nothing passes the file
    on. text is null, and parser too, if none gives any. A file is one row, so it fits in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(c.to_pylist() for c in batch.columns)):
                text = used = None
                for k, parse in enumerate(parsers):
                    try:
                        text = parse(data)
                    except Exception:  # whatever a parser raises, the next one is asked
                        continue
                    if text:
                        used = k
                        break
                columns = [pa.array([file]), pa.array([text or None], pa.string()), pa.array([used], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["file_path", "text", "parser"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInArrow(run, "file_path string, text string, parser int")
