"""The registered queries against their SQL, and the pipeline against plain Python."""

import re
import sys
from collections import Counter, defaultdict
from hashlib import md5, sha256
from math import floor

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalog, language_id, mixing, pieces
from tidemark.llm.common import WORD

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), catalog.QUERIES[name], catalog.ORACLES[name], SF) == []


def grams(text):
    w = re.findall(WORD, (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(docs):
    """Component of each id by comparing all pairs."""
    root = {i: i for i in docs}
    sets = {i: grams(t) for i, t in docs.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and 4 * min(n, m) >= 3 * max(n, m):
                c = len(sets[a] & sets[b])
                if 100 * c >= 75 * (n + m - c):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def whole_mix(rows):
    """(id, copies) of whole documents out of (id, source, size, text)."""
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    out = {}
    for s in names:
        if not sizes[s]:
            continue
        epochs, rest, at = floor(target[s]) // sizes[s], floor(target[s]) % sizes[s], 0
        for key, i, n in sorted((md5(f"mix:{i}:{md5(text.encode()).hexdigest()}".encode()).hexdigest(), i, n) for i, t, n, text in rows if t == s):
            part = min(max(rest - at, 0), n)
            out[i] = epochs + (n > 0 and 2 * part >= n)
            at += n
    return out


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language_id.fit(docs)
    texts = {i: r["text"] for i, r in rows.items() if (v := language_id.features(r["text"])) is not None and model.predict(v)}
    texts = {i: texts[i] for i, root in groups(texts).items() if i == root}
    texts = {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}(?=")', r"\1[secret]", t) for i, t in texts.items()}
    copies = whole_mix([(i, rows[i]["source"], len(re.findall(WORD, t)), t) for i, t in texts.items()])
    m = pieces.PieceModel(open(pieces.model_path(), "rb").read())
    want = Counter()
    for i, t in texts.items():
        if copies.get(i):
            want[i, tuple(m.encode(t)[0]), sha256(t.encode()).hexdigest()] += copies[i]
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want


def test_pipeline_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    key = 'token = "9fceb02d0ae598e95dc970b74767f19372d61af8"'
    odd = spark.createDataFrame(
        [
            (None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c", None, "s", 5), (2, "a b c", None, "s", 5), (3, "x " * 50_000, "fr", "s", 9), (4, "\U0001f642 42", "en", None, 3),
            (None, "un deux", "fr", "s", 7), (None, "un deux", "fr", "s", 7), (2, "quite another text", "en", None, 18), (5, "a b c", "en", "t", 5), (6, "² ½ Ⅷ ٣", "en", "s", 7), (7, key, "en", "s", 52),
        ],
        empty.schema,
    )
    for start in (empty, odd):
        d = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = stage(spark, d, SMALL)
            d = spark.createDataFrame(d.collect(), d.schema)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert d.columns == list(corpus_pipeline.COLUMNS)
            texts = sorted((r["doc_id"] or -1, r["text"][:20]) for r in d.collect()) if k < 3 else []
            if k == 1 and start is odd:
                assert texts == [(-1, "un deux"), (-1, "un deux"), (2, "a b c"), (2, "quite another text"), (3, "x " * 10), (7, 'token = "9fceb02d0ae')]
            if k == 2 and start is odd:
                assert (7, 'token = "[secret]"') in texts
        assert (d.count() > 0) == (start is odd)


def test_a_sure_prediction_corrects_the_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 50 == 7, F.lit("fr")).otherwise(F.col("lang")))
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, wrong, SF).collect()}
    changed = [i for i in got if i % 50 == 7 and true[i] not in ("fr", None)]
    assert len(changed) > 8 and sum(got[i] == true[i] for i in changed) >= 0.25 * len(changed)  # French texts that aren't
    assert all(got[i] == true[i] for i in got if i % 50 != 7 and true[i])  # and no other is touched


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for p in (root / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text()
    assert "tidemark.llm" in sys.modules
