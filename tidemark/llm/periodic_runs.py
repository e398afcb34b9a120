"""Periodic runs of words: maximal stretches that repeat a period four times or more.

Every stretch of 2^k words gets a name (Karp, Miller and Rosenberg): equal stretches share it, and
a level's names come from sorting pairs of names of the level below. How far two places agree is
then read off by descending the levels. A run of period q agrees with itself q words on over 3 q
words at least, so it holds a place of a grid of that pitch; only grid places are tried, and each
that agrees is extended both ways. One task works on one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import narrowed

LEAST_TIMES, LEAST_WORDS = 4, 6
#: Places of the grid that are tried at once, and texts (in characters, at least one text) that leave a task together.
TRIED, SENT = 1 << 20, 8 << 20


def levels_of(ids: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words, up to the last width at which two are equal."""
    levels, width = [ids], 1
    while 2 * width <= len(ids):
        last = levels[-1]
        pairs = last[: len(last) - width].astype(np.int64) * (int(last.max()) + 1) + last[width:]
        named = np.unique(pairs, return_inverse=True)[1].astype(np.int32)
        if int(named.max()) + 1 == len(named):
            break
        levels.append(named)
        width *= 2
    return levels


def _forward(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that agree from places x and y > x on."""
    done = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):  # no two stretches of twice the top level's width are equal
        i, j = x + done, y + done
        fits = j < len(levels[k])
        i, j = np.where(fits, i, 0), np.where(fits, j, 0)
        done += (fits & (levels[k][i] == levels[k][j])).astype(np.int64) << k
    return done


def _backward(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that agree before places x and y; where there are `most` or more, some number that is no less than `most`."""
    done = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        if 1 << k > int(most.max(initial=0)):
            continue
        i, j = x - done - (1 << k), y - done - (1 << k)
        fits = (i >= 0) & ((1 << k) <= most)
        i, j = np.where(fits, i, 0), np.where(fits, j, 0)
        done += (fits & (levels[k][i] == levels[k][j])).astype(np.int64) << k
    return done


def _pitch(period: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_WORDS - period, (LEAST_TIMES - 1) * period)


def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to try in n words, about `TRIED` at once."""
    periods = np.arange(1, n // LEAST_TIMES + 1)
    places = -(-(n - periods) // _pitch(periods))
    ends = np.cumsum(places)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TRIED, "right")))
        q, m = periods[at:to], places[at:to]
        period = np.repeat(q, m)
        yield (np.arange(len(period)) - np.repeat(np.cumsum(m) - m, m)) * _pitch(period), period
        at = to


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers (int32, from 0), by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS or int(ids.max()) + 1 == n:
        return []
    levels, found = None, []
    for place, period in _grids(n):
        same = ids[place] == ids[place + period]
        if not same.any():
            continue
        levels = levels or levels_of(ids)
        place, period = place[same], period[same]
        before = _backward(levels, place, place + period, _pitch(period))
        first = before < _pitch(period)  # else the grid's place before lies in the same stretch
        place, period, before = place[first], period[first], before[first]
        length = before + _forward(levels, place, place + period) + period
        long = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        found.append(np.stack([(place - before)[long], length[long], period[long]], axis=1))
    if not found:
        return []
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)  # a multiple of a period gives the same stretch again: the smallest one stays
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return [tuple(map(int, r)) for r in runs[np.lexsort((runs[:, 2], runs[:, 0]))]]


def collapse(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words joined by single spaces without what a run repeats after its first period."""
    words = (text or "").encode().split()  # bytes are cut at the six ASCII white spaces only
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    runs = find_runs(ids)
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        r = np.array(runs)
        np.add.at(depth, r[:, 0] + r[:, 2], 1)
        np.add.at(depth, r[:, 0] + r[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return len(ids), runs, b" ".join(words).decode()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def scan_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed, a row per input row.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. A run is a stretch with smallest
    period q and max(6, 4 q) words or more that can't be extended at either end. collapsed is the
    text without the words that stand in a run after its first q ones; words of overlapping runs go
    if any of them says so. A null or empty text has no words, no runs and an empty collapsed text.
    Rows with null ids and repeated rows are worked on like any other; an empty table gives an empty
    one; other columns are ignored.

    Texts of any length are read whole. Names take 4 bytes a word and level, and levels end at the
    longest stretch that occurs twice; time is n log(n) steps a level for n words.
    """
    d = narrowed(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: pa.Array, rows: list) -> pa.RecordBatch:
            n, runs, texts = zip(*rows)
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(_RUN))
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), runs, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            rows, size, start = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                rows.append(collapse(text.as_py()))
                size += len(rows[-1][2]) + 24 * len(rows[-1][1])
                if size >= SENT or k == batch.num_rows - 1:
                    yield made(batch.column(0).slice(start, len(rows)), rows)
                    rows, size, start = [], 0, k + 1

    return d.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(scanned: DataFrame) -> DataFrame:
    """Count, longest run and digests of what `scan_runs` returns."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = scanned.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.floor(1000 * length / period).cast("long")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def plant_periods(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with a periodic tail in the texts whose h = crc32(doc_id in decimals) ends in 0.

    With g = h // 10 and n > 0 words, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Rows without an id or words stay as they are.
    """
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    chosen = F.col("h").isNotNull() & (F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    w = F.when(chosen, words)
    n, g = F.size(w), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")
    return d.select("doc_id", F.when(chosen, made).otherwise(F.col("text")).alias("text"))
