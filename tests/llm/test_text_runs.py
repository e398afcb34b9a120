"""Periodic runs and piecewise hashes against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, periodic_runs, piecewise_hash

SMALL = "/root/testdata/sf0.001"
ODD = [(None, None), (None, "un deux"), (1, ""), (2, " \n\t "), (3, "ab cd ef"), (3, "ab cd ef"), (4, "lang wort " * 60_000), (5, "\U0001f642 é▁x \x00 y"), (6, "a " * 9 + "b"), (7, None)]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    return d.withColumns({c: F.lit("clash") for c in ("runs", "h", "digest", "at", "part", "head", "tail", "n_words", "collapsed")}).repartition(3)


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                w = words[i : j + q]
                if not any(all(w[k] == w[k + p] for k in range(len(w) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    first = {}
    return np.array([first.setdefault(w, len(first)) for w in words], np.int32)


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for n in [*range(0, 40), 80, 200, 400]:
        for letters in (1, 2, 3, 30):
            words = [rng.randrange(letters) for _ in range(n)]
            assert periodic_runs.find_runs(numbered(words)) == brute_runs(words)
    for _ in range(400):  # periodic pieces with faults
        words = []
        while len(words) < 150:
            piece = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
            words += (piece * rng.randint(1, 9))[: rng.randint(1, 90)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = 9
        assert periodic_runs.find_runs(numbered(words)) == brute_runs(words)
    for bits in itertools.product((0, 1), repeat=11):
        assert periodic_runs.find_runs(numbered(bits)) == brute_runs(bits)


def test_runs_of_a_grid_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "TRIED", 7)
    words = ["a", "b"] * 20 + ["c"] * 9 + ["a", "b", "c"] * 12
    assert periodic_runs.find_runs(numbered(words)) == brute_runs(words)


def planted(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def digest(i, text):
    words = planted(i, text)
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_by_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    rng = random.Random(2)
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = periodic_runs.digests(periodic_runs.scan_runs(periodic_runs.plant_periods(d)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert got == {i: digest(i, t) for i, t in rows}
    assert sum(r[1] > 0 for r in got.values()) > 30


def test_runs_of_odd_rows(spark, odd):
    got = sorted(((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.scan_runs(odd).collect()), key=str)
    want = [(i or -1, len((t or "").split()), [(0, 120_000, 2)] if i == 4 else [(0, 9, 1)] if i == 6 else [], "lang wort" if i == 4 else "a b" if i == 6 else " ".join((t or "").split())) for i, t in ODD]
    assert got == sorted(want, key=str)
    assert periodic_runs.digests(periodic_runs.scan_runs(periodic_runs.plant_periods(odd))).count() == len(ODD)
    assert periodic_runs.digests(periodic_runs.scan_runs(periodic_runs.plant_periods(odd.limit(0)))).count() == 0


def test_a_very_long_text_of_repeats():
    words = list(range(50_000)) * 2 + [7] * 300_000 + list(range(20)) * 10_000
    runs = periodic_runs.find_runs(numbered(words))
    assert (100_000, 300_000, 1) in runs and (400_000, 200_000, 20) in runs


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_table():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert piecewise_hash.edit_distance(a, b) == plain_distance(a, b)


def plain_cuts(data, size):
    """Where a rolling hash of the last seven bytes ends chunks, byte by byte."""
    out = []
    for i in range(len(data)):
        h = 0
        for back in range(min(i + 1, 7)):
            h += int(piecewise_hash._SPREAD[data[i - back]]) * pow(0x01000193, back, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        if h % size == size - 1:
            out.append(i + 1)
    return out


def plain_fingerprint(text):
    data, size = (text or "").encode(), 3
    while len(plain_cuts(data, size)) >= 64:
        size *= 2
    signed = []
    for s in (size, 2 * size):
        edges = sorted({0, *plain_cuts(data, s), len(data)})
        numbers = [zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:])]
        signed.append("".join(piecewise_hash._DIGITS[x >> k & 63] for x in numbers for k in (0, 6, 12)))
    return f"{size}:{signed[0]}:{signed[1]}"


def test_fingerprints_by_brute_force(spark, monkeypatch):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    rows = [r for r in rows if len(r[1]) < 5000]
    got = {r["doc_id"]: r for r in piecewise_hash.fingerprint_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows[:60], rows[1:]):
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert (r["n_chars"], r["fingerprint"], r["edited_sha256"]) == (len(t), plain_fingerprint(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["edited_fingerprint"] == plain_fingerprint(changed)
    last, first = rows[-1][1], rows[0][1]
    assert got[rows[-1][0]]["edited_sha256"] == hashlib.sha256((last[: len(last) - len(last) // 4] + first[: len(last) // 4]).encode()).hexdigest()
    long = "".join(t for _, t in rows)
    whole = piecewise_hash.fingerprint(long)
    monkeypatch.setattr(piecewise_hash, "_SLICE", 1000)
    assert piecewise_hash.fingerprint(long) == whole


def test_edits_are_like_and_others_are_not(spark):
    rows = catalog.op12_piecewise_hash(spark, "/root/testdata/sf0.01").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = sorted(text)
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    long = [r for r in rows if r["n_chars"] >= 200]
    far = [r for r in long if len(set(text[r["doc_id"]].split()) & set(text[following[r["doc_id"]]].split())) < 0.2 * len(set(text[r["doc_id"]].split()))]
    near = np.array([r["near_edited"] for r in long])  # texts of a few repeated words have few chunks, and so little to compare
    assert (near >= 0.5).mean() > 0.97 and near.mean() > 0.65
    assert len(far) > 100 and max(r["near_next"] for r in far) < 0.3
    prints = {}
    for r in rows:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def test_fingerprints_of_odd_rows(spark, odd):
    got = piecewise_hash.fingerprint_texts(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t or "")) for i, t in ODD)
    one = {r["doc_id"]: r for r in got}
    assert one[1]["fingerprint"] == one[7]["fingerprint"] == "3::" and one[2]["near_next"] == 0
    assert [r["near_next"] for r in got if r["doc_id"] == 3].count(1.0) == 1  # the first of two equal rows
    alone = piecewise_hash.fingerprint_texts(odd.filter("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert piecewise_hash.fingerprint_texts(odd.limit(0)).count() == 0
    same = "x" * 100_000
    assert len(piecewise_hash.fingerprint(same)) < 400 and piecewise_hash.likeness(piecewise_hash.fingerprint(same), piecewise_hash.fingerprint("y" * 100_000)) == 0
