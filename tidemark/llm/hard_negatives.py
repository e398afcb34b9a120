"""Hard negatives by exact integer products, computed bit-plane by bit-plane.

A row's components become whole numbers. For a block of anchors, kept by every task, a batch of
rows is taken apart into the bit-planes of its components, the most significant first. After each
plane the score of a pair lies between the sum so far and what the planes to come can add at most
or take away: an interval that halves each time. A row is dropped once none of the block's anchors
can use it, be its interval below the anchor's best so far or outside the wanted range; what
remains after the last plane has its exact score. Two passes: the first finds each anchor's
positives, the second its negatives in the ranges that those give.

The anchors are a query set against all rows. They go in blocks of bounded size, and for each
block all rows are scanned without a shuffle; a task sends no more than its best rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored

SCALE = 256.0
#: A block holds so many anchors and so many components at most; a task takes so many rows at least.
ANCHORS, COMPONENTS, TASK_ROWS = 16_384, 8 << 20, 50_000
#: Pairs of a block's anchors and rows that are scored at once, and pairs of few ones.
_PAIRS, _FEW = 1 << 22, 1 << 15
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and floor(`SCALE` * x) of the rows that take part, for each length of vectors.

    The numbers are int64, or Python's own where a component is too large for that.
    """
    valid = pc.and_(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()), batch.column(2).is_valid())
    batch = batch.filter(valid)
    if not batch.num_rows:
        return
    ids, labels, lists = (batch.column(c) for c in range(3))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    starts = np.cumsum(sizes) - sizes
    ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = values[starts[at][:, None] + np.arange(size)]
        fine = np.isfinite(x).all(axis=1)
        at, x = at[fine], x[fine]
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            scaled = np.floor(SCALE * x)
        if size and np.abs(scaled).max() >= 2.0**62:
            numbers = np.array([[int(v) * int(SCALE) if abs(v) >= 2.0**53 else int(np.floor(SCALE * v)) for v in row] for row in x], object)
        else:
            numbers = scaled.astype(np.int64)
        yield ids[at], labels[at], numbers


class Block:
    """Anchors of one length of vectors, each with `slots` ranges of wanted scores."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.numbers, self.ids, self.labels, self.vectors, self.low, self.high = numbers, ids, labels, vectors, low, high


class _Best:
    """The first `k` rows of each anchor and slot so far, by score, then id."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.floor = block.low.copy()
        self.rows, self.fresh, self.n_fresh = np.zeros((4, 0), np.int64), [], 0  # anchor, slot, score, id

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for s in range(self.floor.shape[1]):
            good = (scores >= self.floor[anchors, s]) & (scores <= self.block.high[anchors, s])
            if good.any():
                a = anchors[good]
                self.fresh.append(np.stack([a, np.full(len(a), s), scores[good], ids[good]]))
                self.n_fresh += len(a)
        if self.n_fresh > max(50_000, self.rows.shape[1]):
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.fresh], axis=1)
        rows = rows[:, np.lexsort((rows[3], -rows[2], rows[1], rows[0]))]
        first = np.ones(rows.shape[1], bool)
        first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        starts = np.flatnonzero(first)
        place = np.arange(rows.shape[1]) - np.repeat(starts, np.diff([*starts, rows.shape[1]]))
        last = place == self.k - 1
        self.floor[rows[0, last], rows[1, last]] = np.maximum(rows[2, last], self.floor[rows[0, last], rows[1, last]])
        self.rows, self.fresh, self.n_fresh = rows[:, place < self.k], [], 0
        return self.rows


def _exact_type(vectors: np.ndarray, bits: int) -> type:
    """A type in which all sums of products with numbers of so many bits are exact."""
    most = int(max((sum(map(abs, v)) for v in vectors.tolist()), default=0)) << bits + 1
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _score(block: Block, best: _Best, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool) -> None:
    """Adds the pairs of `anchors` (places in the block) with a few rows to `best`, as far as they can qualify."""
    open_ = (block.labels[anchors][:, None] == labels) == same
    open_ &= block.ids[anchors][:, None] != ids
    bits = max(int(x.max()).bit_length(), int(-1 - x.min()).bit_length()) if x.size else 0
    vectors = block.vectors[anchors]
    kind = _exact_type(vectors, bits)
    of = int if kind is object else kind
    m = vectors.astype(kind)
    up, down = np.where(m > 0, m, 0).sum(axis=1), np.where(m < 0, m, 0).sum(axis=1)
    least = best.floor[anchors].min(axis=1).astype(kind if kind is object else np.float64)
    most = block.high[anchors].max(axis=1).astype(kind if kind is object else np.float64)
    rows, cols = np.arange(len(anchors)), np.arange(len(ids))
    sums = np.zeros(open_.shape, kind)
    for k in range(bits, -1, -1):  # the topmost plane is the sign's
        plane = ((x[cols] >> k) & 1).astype(kind)
        sums += (m[rows] @ plane.T) * of(-(1 << k) if k == bits else 1 << k)
        rest = of((1 << k) - 1)
        open_ &= sums + (rest * up[rows])[:, None] >= least[rows][:, None]
        open_ &= sums + (rest * down[rows])[:, None] <= most[rows][:, None]
        n_open = np.count_nonzero(open_)
        if not n_open:
            return
        live, used = open_.any(axis=0), open_.any(axis=1)  # rows and anchors with a pair left
        if live.mean() < 0.8 or used.mean() < 0.8:
            sums, open_ = sums[np.ix_(used, live)], open_[np.ix_(used, live)]
            rows, cols = rows[used], cols[live]
        if k and n_open * 16 < open_.size:
            break
    i, j = np.nonzero(open_)
    for at in range(0, len(i), _FEW):
        a, c = rows[i[at : at + _FEW]], cols[j[at : at + _FEW]]
        total = sums[i[at : at + _FEW], j[at : at + _FEW]]
        for b in range(k - 1, -1, -1):
            total = total + (m[a] * ((x[c] >> b) & 1).astype(kind)).sum(axis=1) * of(1 << b)
            rest = of((1 << b) - 1)
            stay = (total + rest * up[a] >= least[a]) & (total + rest * down[a] <= most[a])
            a, c, total = a[stay], c[stay], total[stay]
        best.add(anchors[a], total.astype(np.int64), ids[c])


def _searcher(blocks, k: int, same: bool):
    """For mapInArrow: block, slot, score and id of each task's first `k` rows an anchor and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {b.vectors.shape[1]: (b, _Best(b, k)) for b in blocks.value}
        for batch in batches:
            for ids, labels, x in whole_numbers(batch):
                if x.shape[1] not in own:
                    continue
                block, best = own[x.shape[1]]
                groups = [(np.flatnonzero(labels == c), np.flatnonzero(block.labels == c)) for c in np.unique(labels)] if same else [(np.arange(len(ids)), np.arange(len(block.ids)))]
                for rows, anchors in groups:
                    step = max(1, _PAIRS // max(1, len(anchors)))
                    for at in range(0, len(rows) if len(anchors) else 0, step):
                        r = rows[at : at + step]
                        _score(block, best, anchors, ids[r], labels[r], x[r], same)
        for block, best in own.values():
            a, slot, score, found = best.settle()
            for at in range(0, len(a), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(block.numbers[a[part]]), pa.array(slot[part], pa.int32()), pa.array(score[part]), pa.array(found[part])], names=["anchor", "slot", "score", "id"])

    return run


def _first(vectors: DataFrame, blocks: list[Block], k: int, same: bool) -> DataFrame:
    """anchor (its number in the block), slot, rank, score, id of the first `k` rows over all tasks."""
    shared = vectors.sparkSession.sparkContext.broadcast(blocks)
    found = vectors.mapInArrow(_searcher(shared, k, same), "anchor long, slot int, score long, id long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(numbers, ids, labels, vectors, ranges) -> list[Block]:
    """Blocks by length of vectors; ranges: low and high of each slot by anchor number."""
    by: dict[int, list[int]] = {}
    for n in numbers:
        by.setdefault(len(vectors[n]), []).append(n)
    out = []
    for size, own in by.items():
        low, high = (np.array([[r[e] for r in ranges(n)] for n in own], np.int64) for e in (0, 1))
        wide = any(abs(v) >= 1 << 62 for n in own for v in vectors[n])
        x = np.array([list(vectors[n]) for n in own], object if wide else np.int64).reshape(len(own), size)
        out.append(Block(np.array(own, np.int64), np.array([ids[n] for n in own], np.int64), np.array([labels[n] for n in own], np.int64), x, low, high))
    return out


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor, positive and negative.

    Components become floor(256 x); a score is the exact integer inner product, higher ones first,
    ties by smaller id. An anchor's positives are the first `n_positives` rows of its label with
    another id; a positive's negatives the first `n_negatives` rows of other labels whose score is
    `low` to `high` percent of the positive's. `is_anchor` is a condition on id_col.

    Rows take no part if id, label or vector is null or a component is null, NaN or infinite.
    Vectors of different lengths aren't compared. Rows that repeat an id are candidates each for
    itself; anchors that repeat id, label and vector are one. Ids and labels are whole numbers; a
    score that no long holds is an error. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].alias("vector"))
    asked = vectors.filter(is_anchor).select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    anchors = stored(asked.dropDuplicates(), "anchors")
    n, wanted = v.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    if n < wanted:
        v = stored(v.repartition(wanted), "vectors")
    else:
        v = v.coalesce(max(wanted, v.count() // TASK_ROWS))
    path = scratch(spark, "negatives")
    spark.createDataFrame([], _MINED).write.parquet(path)
    source = anchors.toLocalIterator()
    while True:
        ids, labels, numbers, size = [], [], [], 0
        while len(ids) < ANCHORS and size < COMPONENTS and (rows := list(islice(source, 1000))):
            columns = ((pa.int64(), "id"), (pa.int64(), "label"), (pa.list_(pa.float64()), "vector"))
            batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for t, c in columns], names=["id", "label", "vector"])
            for i, c, x in whole_numbers(batch):
                ids += i.tolist()
                labels += c.tolist()
                numbers += x.tolist()
                size += x.size
        if not ids:
            return spark.read.schema(_MINED).parquet(path)
        every = range(len(ids))
        positives: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(_first(v, _blocks(every, ids, labels, numbers, lambda n: [(_LEAST, _MOST)]), n_positives, True).collect(), key=lambda r: (r["anchor"], r["rank"])):
            positives.setdefault(r["anchor"], []).append((r["id"], r["score"]))  # n_positives a block's anchor at most
        none = (_MOST, _LEAST)

        def ranges(n: int) -> list[tuple[int, int]]:
            own = [(-(-low * p // 100), high * p // 100) for _, p in positives[n]]
            return [r if r[0] <= r[1] else none for r in own] + [none] * (n_positives - len(own))

        found = _first(v, _blocks(sorted(positives), ids, labels, numbers, ranges), n_negatives, False)
        named = spark.createDataFrame([(n, s, ids[n], i, p) for n, own in positives.items() for s, (i, p) in enumerate(own)], "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        mined = found.join(F.broadcast(named), ["anchor", "slot"])
        mined = mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        mined.write.mode("append").parquet(path)


ORACLE_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10"""
