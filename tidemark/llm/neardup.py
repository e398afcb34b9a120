"""Near-duplicate groups: one-permutation MinHash with optimal densification, bands, star-shaped edges.

1. `sketch`: a text's distinct 5-word shingles are hashed to 64 bits; the top bits choose one of
   `BINS` bins and each bin keeps its least hash. An empty bin copies the bin that a random order of
   its own reaches first among the filled ones, so small sets keep independent bins. `BINS` values
   are cut into bands of `ROWS`; a pair at the threshold of 0.75 shares no band of the 32 with
   probability (1 - 0.75^4)^32, about 5 in a million. Each row gets a number, so that rows which
   repeat an id are nodes of their own.
2. Equal sets form a class at once, by a 128-bit digest; only its representative goes on.
3. A bucket (the representatives that share a band) gives edges from its smallest and from its
   largest row to every other member: two a member at most, however large the bucket.
4. Candidate pairs are confirmed on the whole shingle sets, which are computed again for the
   documents in some pair or crowded bucket only.
5. Components come from alternating large-star and small-star steps, each stored as a table.
6. What the stars leave open is settled exactly: a bucket whose other members are still in several
   components is cut into blocks of bounded size, those of its most frequent component apart from
   the rest. Each block of the rest meets each other block in a task of its own, which counts all
   intersections by matrix products and returns no pair but a spanning forest of the new links. So
   no pair that shares a band is lost, and no pair is a row of a table.

Nothing is capped or sampled, and no bucket, class or component is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import narrowed, stored

SHINGLE, BINS, ROWS, SIMILARITY = 5, 128, 4, 75
#: What a block holds: shingles and members, in expectation.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 17, 512
_SLICE, _COLUMNS = 512, 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches all output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    rolled = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        rolled = rolled * _MULTIPLIER + h[k : k + n]
    return np.unique(_mixed(rolled))


def _orders(bins: int) -> np.ndarray:
    """For each bin, all bins in a random order of its own."""
    rng = np.random.default_rng(20240501)
    return np.argsort(rng.random((bins, bins)), axis=1)


def signature(shingles: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The least hash of each bin; empty bins are filled from others. `shingles` is not empty."""
    bins = len(orders)
    shift = 64 - (bins - 1).bit_length()
    edges = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << np.uint64(shift))
    filled = np.diff(edges, append=len(shingles)) > 0
    out = shingles[np.minimum(edges, len(shingles) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = orders[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = values.reshape(-1, rows)
    key = np.arange(1, len(grid) + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mixed(key * _MULTIPLIER + grid[:, k])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _orders(BINS)
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            ids, sizes, keys, bands = part.column(0), [], [], []
            for known, text in zip(ids.is_valid().to_pylist(), part.column(2).to_pylist()):
                s = shingle_set(text)
                sizes.append(len(s))
                linked = known and len(s) > 0
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if linked else None)
                bands.append(band_keys(signature(s, orders)) if linked else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [ids, part.column(1), *columns], names=["doc_id", "text_hash", "n_shingles", "set_key", "bands"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            sets = [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["row", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            links.append(100 * common >= SIMILARITY * (len(a) + len(b) - common))
        keep = pa.array(links, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets in `a` with all in `b`, by products of 0-1 matrices some columns at a time."""
    token, column, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    name = np.cumsum(times > 1) - 1  # a shingle that only one set has adds to no intersection
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    of = times[column] > 1
    row, column = row[of], name[column[of]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(name[-1]) + 1, _COLUMNS):
        here = slice(*np.searchsorted(column, (low, low + _COLUMNS)))
        grid = np.zeros((len(a) + len(b), min(_COLUMNS, int(name[-1]) + 1 - low)), np.float32)
        grid[row[here], column[here] - low] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out.astype(np.int64)


def forest(roots_a: np.ndarray, roots_b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links between different roots that join all that `linked` joins, without a cycle."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x

    out = []
    at = np.nonzero(linked & (roots_a[:, None] != roots_b))
    edges = np.stack([np.minimum(roots_a[at[0]], roots_b[at[1]]), np.maximum(roots_a[at[0]], roots_b[at[1]])], axis=1)
    for u, v in np.unique(edges, axis=0).tolist():
        x, y = find(u), find(v)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((u, v))
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or two blocks (lists of root and shingles): links between the members' roots."""
    for batch in batches:
        for k in range(batch.num_rows):
            blocks = batch.column(0)[k].values
            parts = []
            for n in range(len(blocks)):
                members = blocks[n].values
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.field("shingles")]
                parts.append((members.field("root").to_numpy(), sets, np.array([len(x) for x in sets])))
            (ra, a, na), (rb, b, nb) = parts[0], parts[-1]
            common = overlaps(a, b)
            links = forest(ra, rb, 100 * common >= SIMILARITY * (na[:, None] + nb - common))
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def bucket_members(reps: DataFrame) -> DataFrame:
    """Members (key, row, n_shingles) of each bucket of two rows or more, with its centres lo and hi and its size n."""
    member = reps.select("row", "n_shingles", F.explode("bands").alias("key"))
    end = lambda of, by: F.struct(of("row").alias("row"), by("n_shingles", "row").alias("n_shingles"))
    buckets = member.groupBy("key").agg(end(F.min, F.min_by).alias("lo"), end(F.max, F.max_by).alias("hi"), F.count("*").alias("n"))
    return member.join(buckets.filter(F.col("n") > 1), "key")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Star edges (u < v) of each bucket out of `bucket_members` whose sizes allow the similarity, each once."""
    pairs = members.select("row", "n_shingles", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("c"))
    small, large = F.least("n_shingles", "c.n_shingles"), F.greatest("n_shingles", "c.n_shingles")
    return (
        pairs.filter((F.col("row") != F.col("c.row")) & (100 * small >= SIMILARITY * large))
        .select(F.least("row", "c.row").alias("u"), F.greatest("row", "c.row").alias("v"))
        .distinct()
    )


def confirmed_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar on their whole sets (row, shingles)."""
    left = sets.select(F.col("row").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("row").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(_confirmed, "u long, v long")


def remaining_links(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (u, v) between roots that join all similar members of different components in a bucket.

    `members` (key, row, n_shingles) leaves out those that were compared with all others.
    """
    m = members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    sizes = m.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    split = sizes.groupBy("key").agg(
        F.max(F.struct("n", "root", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")
    ).filter("n > top.n")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_MEMBERS, s / BLOCK_SHINGLES)).cast("int")
    split = split.select(
        "key", F.col("top.root").alias("most"), blocks(F.col("top.n"), F.col("top.s")).alias("n_most"),
        blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("n_rest"),
    )
    draw = lambda n: F.pmod(F.xxhash64("row", "key"), F.col(n)).cast("int")
    # blocks of the rest are numbered from 0, those of the most frequent component after them
    block = F.when(F.col("root") == F.col("most"), F.col("n_rest") + draw("n_most")).otherwise(draw("n_rest"))
    open_ = stored(m.join(split, "key").select("key", "row", "root", "n_rest", "n_most", block.alias("block")), "open")
    whole = open_.join(sets, "row").groupBy("key", "block").agg(
        F.collect_list(F.struct("root", "shingles")).alias("members"), F.first("n_rest").alias("n_rest"), F.first("n_most").alias("n_most")
    )
    others = F.when(F.col("block") < F.col("n_rest"), F.sequence(F.lit(0), F.col("n_rest") + F.col("n_most") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("n_rest") - 1)
    )
    met = whole.select("key", "block", "members", F.explode(others).alias("other"))
    met = met.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = met.agg(F.collect_list("members").alias("blocks"))
    # a block drawn by no member has no row
    met = met.filter((F.size("blocks") == 2) | (F.col("i") == F.col("j"))).select("blocks")
    return met.mapInArrow(_compared, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that isn't the least of its component, out of edges (u, v)."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stored(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_hash, chosen.

    Null, empty and blank texts have no shingles and are linked with nothing; so is a row without
    an id, whose component is null and which is kept. Ids are of any type with an order. Rows that
    repeat an id go each by its own text: with equal texts they share a component, with different
    ones only if those are similar, and two components may then have one component_id. `kept` says
    whether the row's id is the component's least; `chosen` holds for one text of each component
    (its least id's, ties to the least `text_hash`, xxhash64 of the text) and rows that repeat it.
    An empty table gives an empty one; other columns are ignored.
    """
    d = narrowed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    sketches = d.mapInArrow(_sketch, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, bands array<long>")
    sketches = stored(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    linked = sketches.filter("set_key is not null")
    name = F.struct("doc_id", "text_hash")
    copies = linked.groupBy("set_key").agg(F.min("row").alias("rep"), F.max("row").alias("last"), F.min(name).alias("least"))
    copies = stored(copies.filter("rep < last").drop("last"), "copies")
    reps = linked.join(copies, "set_key", "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col("row")))
    members = stored(bucket_members(reps), "buckets")
    pairs = stored(candidate_pairs(members), "pairs")
    # in buckets of up to three, the centres' edges are all pairs
    inner = members.filter((F.col("n") > 3) & (F.col("row") != F.col("lo.row")) & (F.col("row") != F.col("hi.row")))
    inner = inner.select("key", "row", "n_shingles")

    # `wanted` grows with the input, so it is merged at every size
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("row")).unionByName(inner.select("row")).distinct().hint("merge")
    wanted = sketches.select("row", "doc_id", "text_hash").join(wanted, "row", "left_semi").hint("merge")
    sets = d.join(wanted, ["doc_id", "text_hash"]).select("row", "text").mapInArrow(_sets, "row long, shingles binary")
    repeats = linked.join(copies.select("set_key"), "set_key", "left_semi").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeats.isEmpty():
        sets = sets.dropDuplicates(["row"])
    sets = stored(sets, "sets", "none")
    roots = components(confirmed_links(pairs, sets))
    more = stored(remaining_links(inner, sets, roots), "links")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    names = reps.select(F.col("row").alias("node"), F.coalesce("least", name).alias("least"))
    first = nodes.join(names, "node").groupBy("root").agg(F.min("least").alias("first"))
    nodes = stored(nodes.join(first, "root").select(F.col("node").alias("rep"), "first"), "components")
    out = sketches.drop("bands").join(copies, "set_key", "left").withColumn("rep", F.coalesce("rep", "row"))
    out = out.join(nodes, "rep", "left").withColumn("first", F.coalesce("first", "least", name))
    return out.select(
        "doc_id",
        "n_shingles",
        F.col("first.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(True)).alias("kept"),
        "text_hash",
        (F.col("doc_id").isNull() | (name == F.col("first"))).alias("chosen"),
    )


#: Brute force: every pair of documents that shares a shingle, on its whole sets.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN n USING (doc_id)"""
