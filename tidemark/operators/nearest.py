"""Exact nearest vectors by blocked matrix products.

Queries are few beside the vectors, so they travel: a block of bounded size goes to every task, each
batch of vectors becomes a matrix, and one product gives all similarities of the two. A task keeps
the best rows of each query and the least similarity that could still change them; only products
above it are looked at again. No pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block and their components at most, similarities that are computed at once, and decimals that count.
BLOCK, COMPONENTS, AT_ONCE, DIGITS = 20_000, 8 << 20, 1 << 19, 6


def half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """`x` rounded as SQL does: halves go away from zero, where numpy takes the even neighbour."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x)


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vectors; without null ones and those that have no direction."""
    at = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.filter(lists.is_valid())
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        x = values[starts[own][:, None] + np.arange(size)]
        length = np.sqrt((x * x).sum(axis=1))
        some = np.isfinite(length) & (length > 0)
        if some.any():
            yield at[own[some]], x[some] / length[some][:, None]


class Heaps:
    """The `n` best rows of each query so far: by value, then by smaller id."""

    def __init__(self, queries: int, n: int):
        self.n, self.floor = n, np.full(queries, -np.inf)
        self.query, self.value, self.id = np.zeros(0, np.int64), np.zeros(0), None
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """values: a row for each query, a column for each id."""
        q, c = np.nonzero(values >= self.floor[:, None])
        if len(q):
            self.fresh.append((q, values[q, c], ids[c]))
            if sum(len(f[0]) for f in self.fresh) > max(100_000, len(self.query)):
                self.settle()

    def settle(self) -> None:
        rows = self.fresh + ([(self.query, self.value, self.id)] if self.id is not None else [])
        if not rows:
            return
        query, value, own = (np.concatenate([r[k] for r in rows]) for k in range(3))
        order = np.lexsort((own, -value, query))
        query, value, own = query[order], value[order], own[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
        last = place == self.n - 1
        self.floor[query[last]] = value[last]
        self.query, self.value, self.id = (x[place < self.n] for x in (query, value, own))
        self.fresh = []

    def rows(self, numbers: np.ndarray, kind: pa.DataType, value: str) -> Iterator[pa.RecordBatch]:
        """(number, id, value) of all that is kept; a query's number is that at its place in `numbers`."""
        for at in range(0, len(self.query), 100_000):
            part = slice(at, at + 100_000)
            own = pa.array(self.id[part].tolist(), pa.string()).cast(kind) if self.id.dtype.kind == "U" else pa.array(self.id[part]).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[self.query[part]]), own, pa.array(self.value[part])], names=["number", "id", value])


def ids_of(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def _task(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value  # length of vectors -> numbers of queries and their unit vectors
        heaps = {size: Heaps(len(q), n) for size, (q, _) in groups.items()}
        kind = None
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            kind, ids = batch.column(0).type, ids_of(batch.column(0))
            for rows, x in matrices(batch.column(1)):
                if x.shape[1] not in groups:
                    continue
                q = groups[x.shape[1]][1]
                step = max(1, AT_ONCE // len(q))
                for at in range(0, len(rows), step):
                    heaps[x.shape[1]].add(half_away(q @ x[at : at + step].T, DIGITS), ids[rows[at : at + step]])
        for size, h in heaps.items():
            h.settle()
            yield from h.rows(groups[size][0], kind, "sim")

    return run


def nearest(queries: DataFrame, vectors: DataFrame, n: int, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, id, sim): a superset of the `n` nearest vectors of each query by cosine, at most `n` a query and task.

    sim is rounded to `DIGITS` decimals, equal ones go by smaller id. `queries` has query_id and the
    vector, `vectors` id and the vector; null ids and vectors, vectors with null components and
    those of length 0 are near to nothing; vectors of different numbers of components aren't compared.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", F.col(vector).cast("array<double>").alias("v_"))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v_")).alias("d")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["n"] * (size["d"] or 0) // COMPONENTS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    v = vectors.select("id", F.col(vector).alias("v_"))
    kind = vectors.schema["id"].dataType.simpleString()
    found = []
    for b in range(blocks):
        rows = q.filter(part == b).toArrow()  # about `block` rows
        lists = rows.column("v_").combine_chunks()
        groups = {x.shape[1]: (at, x) for at, x in matrices(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists)}
        shared = spark.sparkContext.broadcast(groups)
        names = spark.createDataFrame(rows.select(["query_id"]).append_column("number", pa.array(range(rows.num_rows), pa.int64())))
        hits = v.mapInArrow(_task(shared, n), f"number long, id {kind}, sim double")
        found.append(hits.join(F.broadcast(names), "number").select("query_id", "id", "sim"))
    return reduce(DataFrame.unionByName, found)
