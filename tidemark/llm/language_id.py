"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed character 1- to 3-grams of the text's letters (other runs count as one space),
square roots of their counts, scaled to unit length. A squared-hinge linear SVM per pair of
families votes for the family; inside it one per pair of languages votes for the language. The
models are fitted on the driver from at most `per_language` labelled documents of each language,
those with the least hash of their id and text; all documents are predicted from their whole texts.

A letter is a code point of a Unicode category L* (`_letters`), in training, prediction and `und`
alike: numerals such as \u00b2, \u00bd or \u2167, marks and symbols are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import narrowed

#: Families of languages; one that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS = 4096
PER_LANGUAGE = 400
UNKNOWN = "und"
_SLICE = 256
#: How many times `per_language` rows are asked for, as counts of distinct rows are off by some percent.
_SPARE = 1.25


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter (str.isalpha: the categories Lu, Ll, Lt, Lm and Lo)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text, None if it has no letter."""
    if not text or not _letters()[_points(text)].any():
        return None
    c = _points(text.lower())
    c = np.where(_letters()[c], c, np.uint32(32))
    blank = c == 32
    c = c[~(blank & np.append(True, blank[:-1]))]
    c = np.concatenate(([np.uint32(32)], c[:-1] if c[-1] == 32 else c, [np.uint32(32)])).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    counts = np.zeros(DIMS)
    for h in (one, two, three):
        counts += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(20), minlength=DIMS)
    v = np.sqrt(counts, dtype=np.float64).astype(np.float32)
    return v / np.linalg.norm(v)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights (the last one the bias) of the squared-hinge SVM with classes of equal weight; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    step, momentum = 1 / (1 / c + 4 * max(share) * len(y)), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - step * (ahead / c / len(y) - 2 * x.T @ (share * y * slack))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = after + (momentum - 1) / faster * (after - w), after, faster
    return w.astype(np.float32)


class OneVersusOne:
    """Pairwise SVMs over the classes of `labels`; a single class needs none."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        y = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.w = []
        for a, b in self.pairs:
            of = (y == self.classes[a]) | (y == self.classes[b])
            self.w.append(linear_svm(x[of], np.where(y[of] == self.classes[a], 1.0, -1.0)))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The class with most votes (ties: the larger sum of margins) and its least pairwise probability."""
        if not self.pairs:
            return self.classes[0], 1.0
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        margins = [float(w[:-1] @ v + w[-1]) for w in self.w]
        for (a, b), m in zip(self.pairs, margins):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(votes)), key=lambda i: (votes[i], sums[i], -i))
        least = min(m if a == best else -m for (a, b), m in zip(self.pairs, margins) if best in (a, b))
        return self.classes[best], float(1 / (1 + np.exp(-2 * least)))


class HierarchicalModel:
    """The family's model and, for each family, its languages' model."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [FAMILY.get(lang, lang) for lang in langs]
        self.top = OneVersusOne(x, families)
        self.inside = {}
        for family in self.top.classes:
            of = [i for i, f in enumerate(families) if f == family]
            self.inside[family] = OneVersusOne(x[of], [langs[i] for i in of])

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        family, p = self.top.predict(v)
        lang, q = self.inside[family].predict(v)
        return lang, p * q


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, h, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (v := features(text)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([h]), pa.array([v.tobytes()])], names=["lang", "h", "v"]
                )


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE
) -> HierarchicalModel | None:
    """Fitted from the `per_language` documents of each language whose ids and texts hash least; None without any.

    Of repeated rows one counts. Documents without a letter teach nothing. The driver gets some
    `per_language` vectors of each language, however large the table: a first pass counts the
    distinct rows of each language, the second keeps rows whose hash lies below the share wanted.
    """
    known = narrowed(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    known = known.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.shiftrightunsigned(F.xxhash64(F.lit("lid"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 2)
    known = known.select("lang", h.alias("h"), "text")
    # one row a language
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).collect()}
    if not sizes:
        return None
    limit = F.coalesce(*(
        F.when(F.col("lang") == lang, F.lit(int(min(1.0, (_SPARE * per_language + 50) / max(1, n)) * 2**62)))
        for lang, n in sorted(sizes.items())
    ))
    vectors = known.filter(F.col("h") <= limit).mapInArrow(_vectors, "lang string, h long, v binary")
    rows = sorted((r["lang"], r["h"], bytes(r["v"])) for r in vectors.dropDuplicates(["lang", "h"]).collect())
    rows = [r for _, same in groupby(rows, lambda r: r[0]) for r in islice(same, per_language)]
    if not rows:
        return None
    return HierarchicalModel(np.stack([np.frombuffer(v, np.float32) for *_, v in rows]), [lang for lang, *_ in rows])


def predict_languages(
    docs: DataFrame, model: HierarchicalModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, then the columns of `keep`.

    A text that is null or has no letter, and every text if there was nothing to learn from, is
    `und` with score 0. Repeated rows and null ids are predicted like any other; an empty table
    gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = []
                for text in part.column(2).to_pylist():
                    v = features(text) if model else None
                    found.append((UNKNOWN, 0.0) if v is None else model.predict(v))
                langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), langs, scores, *part.columns[3:]],
                    names=["doc_id", "held_out", "lang_pred", "score", *keep],
                )

    rest = [docs[c].alias(f"kept_{k}") for k, c in enumerate(keep)]
    text = docs[text_col].cast("string").alias("text")
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), text, *rest)
    schema = [f"doc_id {rows.schema[0].dataType.simpleString()}", "held_out boolean", "lang_pred string", "score double"]
    schema += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join(schema))
