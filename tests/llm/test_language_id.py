"""Letters by one definition, and predictions against a plain walk through the same weights."""

import sys
import unicodedata
from collections import Counter
from math import exp, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as lid

SF = "/root/testdata/sf0.01"
LETTERLESS = ["²", "½ ①", "Ⅷ", "٣", "_ 12", "́", "Ⓐ", "", " \n", "\U0001f642 42", "퟼", None]


def test_a_letter_is_what_unicode_calls_one():
    one = {}
    for i in range(sys.maxunicode + 1):
        if not 0xD800 <= i < 0xE000:
            one.setdefault(unicodedata.category(chr(i)), []).append(i)
    for category, points in one.items():
        for i in points[:3] + points[-3:]:
            v = lid.features(f"1{chr(i)} _")
            assert (v is not None) == category.startswith("L"), (category, hex(i))
            assert v is None or abs(np.linalg.norm(v) - 1) < 1e-5
    assert all(lid.features(t) is None for t in LETTERLESS)


def test_letterless_texts_are_und(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lid.fit(docs)
    rows = spark.createDataFrame(list(enumerate(LETTERLESS)), "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in lid.predict_languages(rows, model).collect()} == {("und", 0.0)}
    # and they teach nothing, as the only rows of a language
    odd = rows.select("doc_id", "text", F.lit("xx").alias("lang"))
    assert lid.fit(odd) is None
    assert "xx" not in [c for m in lid.fit(docs.select("doc_id", "text", "lang").unionByName(odd)).inside.values() for c in m.classes]


def plain_features(text):
    """The hashed n-grams counted one by one."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = [ord(c) for c in " " + " ".join(runs) + " "]
    counts, m = Counter(), 2**32
    for i, a in enumerate(s):
        h = a * 2654435761 % m
        for k, (mul, out) in enumerate(((2246822519, 3266489917), (668265263, 374761393), (0, 0))):
            counts[(h ^ (h >> 15)) >> 20] += 1
            if k == 2 or i + k + 1 >= len(s):
                break
            h = (h ^ (s[i + k + 1] * mul % m)) * out % m
    size = sqrt(sum(counts.values()))
    return {k: sqrt(n) / size for k, n in counts.items()}


def plain_vote(model, v):
    margins = {p: sum(w[k] * x for k, x in v.items()) + w[-1] for p, w in zip(model.pairs, (w.tolist() for w in model.w))}
    score = {i: (sum((m >= 0) == (i == a) for (a, b), m in margins.items() if i in (a, b)),
                 sum(m if i == a else -m for (a, b), m in margins.items() if i in (a, b))) for i in range(len(model.classes))}
    best = max(score, key=lambda i: (*score[i], -i))
    least = min((m if best == a else -m for (a, b), m in margins.items() if best in (a, b)), default=None)
    return model.classes[best], 1.0 if least is None else 1 / (1 + exp(-2 * least))


def test_predictions_equal_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    model = lid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in lid.predict_languages(docs, model).collect():
        v = plain_features(text[r["doc_id"]]) if text[r["doc_id"]] and any(c.isalpha() for c in text[r["doc_id"]]) else None
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        family, p = plain_vote(model.top, v)
        lang, q = plain_vote(model.inside[family], v)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(p * q, abs=1e-4)


def test_training_rows_are_bounded_and_by_row(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(lid, "HierarchicalModel", lambda x, langs: got.update(n=len(langs), by=Counter(langs)))
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("wort "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("mot").alias("text"), F.lit("fr").alias("lang"))
    lid.fit(rows.unionByName(same), per_language=50)
    assert got["by"] == {"de": 50, "fr": 1}
    lid.fit(rows.unionByName(same).repartition(7), per_language=50)
    assert got["by"] == {"de": 50, "fr": 1}
