"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays.

`statistics` counts what the base rules need and a few shares besides. The trees are grown on the
driver from at most `max_rows` labelled documents (those whose ids hash least): depth-limited
Newton boosting on histograms of a logistic loss, where a feature with a monotonic constraint may
only split so that the outputs keep its order, and each child stays on its side of the middle
between the two. All trees lie in five numpy arrays, so a batch of documents is scored by `depth`
rounds of indexing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, narrowed

#: Symbols, window width, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: Feature and constraint: -1 where more must not raise the score, 1 where it must not lower it.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbol_share", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("upper_share", -1),
    ("digit_share", -1),
    ("letter_share", 1),
    ("punct_share", 0),
    ("line_words", 0),
    ("distinct_share", 0),
    ("long_word_share", 0),
)
MAX_ROWS, MIN_SCORE = 8_000, 0.5
_SLICE = 512
_WORD = re.compile(WORD)


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words covered by a window of `width` words that stands twice or more in the text."""
    if len(words) <= width:
        return 0
    ids: dict[str, int] = {}
    h = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(words) - width + 1
    key, span = h[:n].copy(), len(ids)
    for k in range(1, width):
        if span * len(ids) >= 2**62:  # number the keys anew, so that equal keys stay exactly the equal windows
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max()) + 1
        key = key * len(ids) + h[k : k + n]
        span *= len(ids)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge[starts] += 1  # starts are distinct
    edge[starts + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    counts = Counter(text.split("\n"))
    return sum(n - 1 for line, n in counts.items() if n > 1 and _WORD.search(line))


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point: 1 a capital, 2 another letter, 3 a digit, 4 a sentence mark, 5 a symbol, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kinds[i] = 1 if c.isupper() else 2
        elif c.isdigit():
            kinds[i] = 3
    kinds[[ord(c) for c in ".,;:!?"]] = 4
    kinds[[ord(c) for c in SYMBOLS]] = 5
    return kinds


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the values of `FEATURES`."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars, lines = len(words), sum(map(len, words)), text.count("\n") + 1
    _, upper, lower, digits, marks, symbols = np.bincount(
        _kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=6
    ).tolist()
    dups, repeats = duplicate_lines(text), repeated_words(words)
    c, w = max(1, chars), max(1, n)
    values = [
        float(np.log1p(n)), chars / w, symbols / c, dups / lines, repeats / w, upper / c, digits / c,
        (upper + lower) / c, marks / c, n / lines, len(set(words)) / w, sum(len(x) > 20 for x in words) / w,
    ]
    return [n, chars, symbols, dups, repeats], values


@dataclass
class Forest:
    """Trees as node arrays: a leaf points to itself; `roots` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1 for each row of `x`."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def _best_split(bins, g, h, constraints, low, high, least, ridge):
    """(gain, feature, bin, left value, right value) of the best split of these rows, None without one."""
    best = None
    total_g, total_h = g.sum(), h.sum()
    old = total_g**2 / (total_h + ridge)
    for f in range(bins.shape[1]):
        top = int(bins[:, f].max()) + 1
        n = np.cumsum(np.bincount(bins[:, f], minlength=top))[:-1]
        lg = np.cumsum(np.bincount(bins[:, f], g, top))[:-1]
        lh = np.cumsum(np.bincount(bins[:, f], h, top))[:-1]
        if not len(n):
            continue
        a, b = np.clip(-lg / (lh + ridge), low, high), np.clip(-(total_g - lg) / (total_h - lh + ridge), low, high)
        gain = -(2 * lg * a + (lh + ridge) * a**2) - (2 * (total_g - lg) * b + (total_h - lh + ridge) * b**2) - old
        fits = (n >= least) & (len(g) - n >= least) & (constraints[f] * (b - a) >= 0)
        gain = np.where(fits, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], f, k, a[k], b[k])
    return best


def grow(
    x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 60, depth: int = 3, rate: float = 0.1,
    bins: int = 32, least: int = 20, ridge: float = 1.0,
) -> Forest:
    """Newton boosting of the logistic loss; deterministic in its inputs."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not len(y):
        none = np.empty(0, np.int64)
        return Forest(none, np.empty(0), none, none, np.empty(0), none, 0, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), base)

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, at, at, rate * value])
        split = _best_split(binned[rows], g[rows], h[rows], constraints, low, high, least, ridge) if level < depth else None
        if split is None:
            margin[rows] += rate * value
            return at
        _, f, k, a, b = split
        sides = binned[rows, f] <= k
        middle, c = (a + b) / 2, constraints[f]
        bounds = ((low, high), (low, high)) if not c else ((low, middle), (middle, high)) if c > 0 else ((middle, high), (low, middle))
        nodes[at][0], nodes[at][1] = f, float(cuts[f][k])
        nodes[at][2] = build(rows[sides], g, h, level + 1, *bounds[0])
        nodes[at][3] = build(rows[~sides], g, h, level + 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(build(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    flat = np.array(nodes).reshape(-1, 5)
    whole = lambda k: flat[:, k].astype(np.int64)
    return Forest(whole(0), flat[:, 1], whole(2), whole(3), flat[:, 4], np.array(roots, np.int64), depth, base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t)[1] for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"]
        )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS
) -> Forest:
    """Trees from the `max_rows` labelled documents whose ids hash least; without any, every score is 0.5.

    Of rows that repeat a labelled id, one teaches, so the driver gets `max_rows` rows of numbers at most.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna()
    chosen = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "label").limit(max_rows)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most `max_rows` ids
    rows = narrowed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_features, f"doc_id {kind}, label int, x array<double>")
    made = made.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("r.label", "r.x")
    got = sorted((r["label"], r["x"]) for r in made.collect())
    x = np.array([v for _, v in got]).reshape(-1, len(FEATURES))
    y = np.array([float(label > 0) for label, _ in got])
    return grow(x, y, [c for _, c in FEATURES])


OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, score double"
)


def apply_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept and the trees' score.

    A null, empty or blank text has no words and so fails the base rules. Repeated rows and null
    ids are judged like any other; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = [statistics(t) for t in part.column(1).to_pylist()]
                base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED_PERCENT * base[:, 0])
                score = forest.score(np.array([v for _, v in found]).reshape(-1, len(FEATURES)))
                columns = [*base.T, failed, ~failed & (score >= min_score), score]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c) for c in columns)],
                    names=["doc_id", *(f.split()[0] for f in OUT.split(", "))],
                )

    d = narrowed(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {OUT}")
