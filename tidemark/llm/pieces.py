"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives Viterbi.

The automaton reads a text once; at each position its output links give all pieces that end there,
longest first, and each relaxes the best score there by the best score where it starts. A single
character without a piece of its own costs the least score less 10 and is written as byte pieces.
No piece of a usable model goes on past the end of a word, so words are segmented apart and frequent
ones are remembered: ids, score and the choice among equal scores are those of one pass over the
whole text, as no piece, and so no comparison, spans two words. A literal U+2581 goes through
byte pieces, so decoding gives back every text exactly. The model is only read, never trained.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "\u2581"
#: Stands for a literal U+2581 in the working text; no valid text holds a lone surrogate.
_LITERAL = "\udfff"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
REMEMBERED, REMEMBERED_LENGTH = 250_000, 40
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_SLICE = 256
_WORST = float("-inf")


def model_path() -> str:
    """The default model's file; callers may name another."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields (number, value) of a serialised protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A model file's pieces with their automaton."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix = True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 3:
                f = dict(_fields(value))
                self.prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("the model changes texts before it encodes them, so they can't be restored")
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        scores = [s for _, s, kind in self.pieces if kind == NORMAL]
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.bytes = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            self.bytes.append(piece.replace(SPACE, " ").encode() if kind in (NORMAL, USER) else b"")
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[-1] = bytes([int(piece[1:-1], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind in (NORMAL, USER):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} spans words")
                gain = score if kind == NORMAL else len(piece) * max(scores, default=0.0) - 0.1
                self.automaton.add_word(piece, (len(piece), gain, i))
                if len(piece) == 1:
                    self.singles.add(piece)
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces, so unknown characters would be lost")
        self.automaton.make_automaton()
        self.known: dict[str, tuple[tuple[int, ...], float]] = {}

    def segment(self, s: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of the best segmentation; of equal ones, that with the longest piece at each end."""
        n = len(s)
        best = [0.0] + [_WORST] * n
        back: list[tuple[int, float, int] | None] = [None] * (n + 1)  # the piece that ends here: length, gain, id
        gaps = () if self.singles.issuperset(s) else iter([k for k, c in enumerate(s, 1) if c not in self.singles])
        gap = next(gaps, 0) if gaps else 0  # the next character without a piece of its own
        for end, hit in self.automaton.iter(s):
            while 0 < gap <= end:
                self._unknown_at(gap, best, back)
                gap = next(gaps, 0)
            end += 1
            k, gain, _ = hit
            score = best[end - k] + gain
            if score > best[end]:
                best[end], back[end] = score, hit
        while gap:
            self._unknown_at(gap, best, back)
            gap = next(gaps, 0)
        ids: list[int] = []
        at = n
        while at:
            k, _, i = back[at]
            if i < 0:
                c = s[at - 1]
                ids += [self.byte_ids[b] for b in reversed((SPACE if c == _LITERAL else c).encode())]
            else:
                ids.append(i)
            at -= k
        ids.reverse()
        return tuple(ids), best[n]

    def _unknown_at(self, end: int, best: list[float], back: list) -> None:
        if (score := best[end - 1] + self.unknown_score) > best[end]:
            best[end], back[end] = score, (1, self.unknown_score, -1)

    def encode(self, text: str) -> tuple[list[int], float]:
        if not text:
            return [], 0.0
        s = (SPACE if self.prefix else "") + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        ids: list[int] = []
        score, known = 0.0, self.known
        for word in _WORD.findall(s):
            got = known.get(word)
            if got is None:
                got = self.segment(word)
                if len(word) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = got
            ids += got[0]
            score += got[1]
        return ids, score

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        data = b"".join([table[i] for i in ids])
        return (data[1:] if self.prefix else data).decode("utf-8", "replace")


_models: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """One automaton for each worker process and model."""
    if (key := hash(data)) not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, score, decoded.

    decoded is the text read back from ids. A null text gives no ids, score 0 and decoded null; an
    empty one gives no ids and decodes to itself. Repeated rows and null ids are encoded like any
    other; an empty table gives an empty one; other columns are ignored. The model file (of fixed
    size) is read by the driver and sent to the executors.
    """
    data = Path(path or model_path()).read_bytes()
    PieceModel(data)  # errors show here
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                flat, ends, scores, texts = [], [0], [], []
                for text in part.column(1).to_pylist():
                    ids, score = model.encode(text or "")
                    flat += ids
                    ends.append(len(flat))
                    scores.append(score)
                    texts.append(None if text is None else model.decode(ids) if ids else "")
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                sizes = pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), sizes, lists, pa.array(scores, pa.float64()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "score", "decoded"],
                )

    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, score double, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The rows of `encode_texts` with decoded as a digest."""
    return encoded.select(
        "doc_id", "n_tokens", "ids", "score", F.sha2("decoded", 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("decoded_chars")
    )
