"""Retrieval: BM25 statistics and search, dense search, fusion, re-ranking, context and memory.

Searches take a table of queries (query_id, ...) and answer all of them in one plan. Ranks are from
0; ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import date_prefix, entities, preview, sentence_trim, tokens
from tidemark.operators import nearest

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, OVER_FETCH, TRUST_WEIGHT = 60, 4, 0.25
BUDGET_TOKENS, CHARS_PER_TOKEN, BUFFER_TURNS = 3000, 4, 4
#: Kinds of documents in the order of a context's sections, with their headings.
SECTIONS = {
    "arxiv_paper": "Quant research (peer-reviewed / pre-print)",
    "onchain_reference": "On-chain & quant reference material",
    "strategy_notes": "Your own strategy notes",
    "blog_or_news": "Blog / news / sentiment (lower trust — treat as narrative, not fact)",
}


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, tokens) of each document: what the sparse index is made of. Written once, no query tokenises again."""
    t = tokens(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), t.alias("tokens")).select("id", F.size("tokens").alias("dl"), "tokens")


def document_frequencies(table: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term stands, summed where the documents are before it is moved."""
    return table.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _raw_weight(n: Column) -> Column:
    return F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def index_totals(table: DataFrame, df: DataFrame) -> tuple[int, float, float]:
    """Documents, their mean length, and the weight of terms that more than half of them have: `EPSILON` of the mean over all."""
    n, length = table.agg(F.count("*"), F.avg("dl")).first()
    mean = df.agg(F.avg(_raw_weight(F.lit(n)))).first()[0]
    return n, length or 0.0, EPSILON * (mean or 0.0)


def term_weights(df: DataFrame, n_docs: int, least: float) -> DataFrame:
    """(term, df, idf): ln(N - df + .5) - ln(df + .5), and `least` in place of negative ones."""
    raw = _raw_weight(F.lit(n_docs))
    return df.select("term", "df", F.when(raw < 0, F.lit(least)).otherwise(raw).alias("idf"))


#: Up to so many terms of queries (some 50 bytes each) are broadcast.
FEW_TERMS = 500_000


def bm25(queries: DataFrame, table: DataFrame, df: DataFrame, n: int, query_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the `n` best documents of each query with a positive score.

    `table` is a `token_table` and `df` its `document_frequencies`, both best stored.

    A token that a query repeats counts as often. Of the documents' tokens only those that some query
    asks for are counted and moved. Every document is scored; `sparse_index` has a search that skips.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col(query_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    n_docs, average, least = index_totals(table, df)
    terms = asked.select("term").distinct()
    # a document is one row, so that its tokens are counted before any is moved
    hits = table.select("id", "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    hits = hits.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    weights = term_weights(df.join(terms, "term", "left_semi"), n_docs, least)
    weighed = asked.join(weights, "term")
    if weighed.count() <= FEW_TERMS:
        weighed = F.broadcast(weighed)  # documents stay where they are, and a frequent term is no task of its own
    hits = hits.join(weighed, "term")
    tf, norm = F.col("tf"), 1 - B + B * F.col("dl") / F.lit(average or 1.0)
    gain = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)
    scores = hits.groupBy("query_id", "id").agg(F.round(F.sum(gain), 6).alias("score"))
    return best(scores.filter("score > 0"), n)


def rounded(x: Column, digits: int) -> Column:
    """`x` rounded as SQL does: Spark's own rounding goes by decimals, and takes what is a little off for a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def best(scores: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The `n` rows of each query with the largest value, with their rank; Spark cuts groups before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank") - 1)


def dense(queries: DataFrame, vectors: DataFrame, n: int, vector: str = "embedding", block: int = nearest.BLOCK) -> DataFrame:
    """(query_id, id, sim, rank): the `n` nearest vectors of each query by exact cosine.

    All vectors are scanned against all queries, block by block, as matrix products (`nearest`).
    Vectors of length 0 are near to nothing.
    """
    return best(nearest.nearest(queries, vectors, n, vector, block), n, "sim")


def _hashed(tokens_: pd.Series, dims: pd.Series) -> pd.Series:
    slots: dict[str, tuple[int, int]] = {}

    def vector(words: list[str], n: int) -> list[float]:
        out = np.zeros(n)
        for w in words:
            if w not in slots:
                digest = md5(w.encode()).hexdigest()
                slots[w] = int(digest[:6], 16), 1 if digest[6] < "8" else -1
            k, sign = slots[w]
            out[k % n] += sign
        size = np.sqrt((out**2).sum())
        return (nearest.half_away(out / size, 6) if size else out).tolist()

    return pd.Series([vector(t, int(n)) for t, n in zip(tokens_, dims)])


def embedded(docs: DataFrame, text_col: str = "text", dims: int = 64) -> DataFrame:
    """Documents with `embedding`, a vector without a model: signed counts of hashed tokens at length 1, zeros without tokens.

    A model's vectors can take its place.
    """
    hashed = F.pandas_udf(_hashed, T.ArrayType(T.DoubleType()))
    return docs.withColumn("embedding", hashed(tokens(F.col(text_col)), F.lit(dims)))


def rrf(dense_hits: DataFrame, sparse_hits: DataFrame, n: int, k: int = RRF_K) -> DataFrame:
    """Both rankings fused: sums of 1 / (k + rank + 1); what only the sparse one found has similarity 0."""
    d = dense_hits.select("query_id", "id", "sim", F.col("rank").alias("dense_rank"))
    s = sparse_hits.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    share = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c) + 1), F.lit(0.0))
    j = d.join(s, ["query_id", "id"], "full_outer").withColumn("rrf", rounded(share("dense_rank") + share("sparse_rank"), 9))
    return best(j.withColumn("sim", F.coalesce("sim", F.lit(0.0))), n, "rrf")


def trusted(hits: DataFrame, meta: DataFrame, weight: float = TRUST_WEIGHT, min_trust: int | None = None, source_type: str | None = None) -> DataFrame:
    """Hits with their document's columns and the blend of similarity and trust; filters hold for every hit.

    A missing or zero trust counts as 1.
    """
    j = hits.join(meta, "id")
    if min_trust is not None:
        j = j.filter(F.col("trust_tier") >= min_trust)
    if source_type is not None:
        j = j.filter(F.col("source_type") == source_type)
    trust = F.coalesce(F.nullif("trust_tier", F.lit(0)), F.lit(1))
    return j.withColumn("combined", rounded((1 - weight) * F.col("sim") + weight * trust / 3.0, 6))


def diverse(hits: DataFrame, k: int, document: str = "doc") -> DataFrame:
    """The `k` best of each query, one of each document first, then the rest by score; slot is the place from 0."""
    per = Window.partitionBy("query_id", document).orderBy(F.desc("combined"), "id")
    d = hits.withColumn("again", (F.row_number().over(per) > 1).cast("int"))
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("again", F.desc("combined"), "id"))
    return d.withColumn("slot", slot).filter(F.col("slot") <= k).withColumn("slot", F.col("slot") - 1)


def attention_order(hits: DataFrame) -> DataFrame:
    """Adds place: the best first, the second last, the third second and so on, so that the weakest are in the middle."""
    w = Window.partitionBy("query_id")
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(F.desc("combined"), "id"))
    # up to two rows keep their order
    place = F.when(n <= 2, r - 1).when(r % 2 == 1, F.floor((r - 1) / 2)).otherwise(n - F.floor(r / 2))
    return hits.withColumn("place", place.cast("long"))


def entry(text: str = "text", paper: str | None = None, published: str | None = None) -> Column:
    """A hit as a line of context: trust, similarity, title, a paper's id and day, and a snippet of whole sentences."""
    snippet = sentence_trim(F.col(text), 600)
    known = lambda c: F.lit("") if c is None else F.coalesce(F.col(c).cast("string"), F.lit(""))
    extra = F.concat(F.lit(" (arXiv:"), known(paper), F.lit(", "), date_prefix(known(published)), F.lit(")"))
    return F.concat(
        F.lit("- [trust="), F.coalesce(F.col("trust_tier").cast("string"), F.lit("?")), F.lit(", sim="), F.format_string("%.2f", "sim"), F.lit('] "'),
        F.coalesce("title", F.lit("untitled")), F.lit('"'), F.when(F.col("source_type") == "arxiv_paper", extra).otherwise(""), F.lit("\n  "), snippet,
    )


def contexts(hits: DataFrame, budget_tokens: int = BUDGET_TOKENS, paper: str | None = None, published: str | None = None) -> DataFrame:
    """One context per query: sections in their order, entries by place, as many as the budget holds.

    An entry that doesn't fit is passed over and later ones are still tried; the first always goes
    in. The hits of a query are few (its k), so the fold runs over one array a query.
    """
    budget = budget_tokens * CHARS_PER_TOKEN
    section = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("source_type")), F.lit(len(SECTIONS)))
    item = F.struct(section.alias("s"), "place", "id", "source_type", entry("text", paper, published).alias("line"))
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    start = F.struct(F.lit(0).alias("used"), none.alias("taken"))

    def take(a: Column, x: Column) -> Column:
        fits = (F.size(a.taken) == 0) | (a.used + F.length(x.line) <= budget)
        return F.struct(
            F.when(fits, a.used + F.length(x.line)).otherwise(a.used).alias("used"), F.when(fits, F.concat(a.taken, F.array(x))).otherwise(a.taken).alias("taken")
        )

    g = g.withColumn("a", F.aggregate("items", start, take))

    def section_text(name: str) -> Column:
        of = F.filter("a.taken", lambda x: x.source_type == name)
        return F.when(F.size(of) > 0, F.concat(F.lit(f"## {SECTIONS[name]}\n"), F.array_join(F.transform(of, lambda x: x.line), "\n")))

    parts = [section_text(name) for name in SECTIONS]
    return g.select(
        "query_id", F.concat_ws("\n\n", *parts).alias("context"), F.size("a.taken").alias("n_included"), (F.size("items") - F.size("a.taken")).alias("n_dropped")
    )


def sources(hits: DataFrame) -> DataFrame:
    """What a reader is shown of each hit."""
    return hits.select("query_id", "place", "id", "title", "source_type", "trust_tier", rounded(F.col("sim"), 3).alias("sim"), sentence_trim(F.col("text"), 400).alias("snippet"))


def memory(turns: DataFrame, key: str, turn: str, n: int = BUFFER_TURNS) -> DataFrame:
    """The last `n` turns of each conversation as text, and how many came before."""
    newest = Window.partitionBy(key).orderBy(F.desc(turn), F.desc("text"))
    d = turns.withColumn("back", F.row_number().over(newest))
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    kept = F.array_sort(F.collect_list(F.when(F.col("back") <= n, F.struct((-F.col("back")).alias("o"), line.alias("line")))))
    return d.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x.line), "\n").alias("buffer"), F.count_if(F.col("back") > n).alias("n_overflow"))


def overflow(turns: DataFrame, key: str, turn: str, n: int = BUFFER_TURNS) -> DataFrame:
    """The turns before the buffer, which a summary should cover."""
    newest = Window.partitionBy(key).orderBy(F.desc(turn), F.desc("text"))
    return turns.withColumn("back_", F.row_number().over(newest)).filter(F.col("back_") > n).drop("back_")


def focus(turns: DataFrame, key: str) -> DataFrame:
    """(key, entities): the distinct mentions in all turns of a conversation, sorted."""
    one = turns.select(key, F.explode(entities(F.col("text"))).alias("e")).distinct()
    return one.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("entities"))


#: The headings of a memory block's parts.
SUMMARY, RECENT, FOCUS = "Prior conversation (summary)", "Recent conversation (verbatim)", "Session focus (signals / topics mentioned so far)"


def memory_block(turns: DataFrame, summaries: DataFrame, key: str, turn: str, n: int = BUFFER_TURNS, most: int = 600, mark: str = " […]") -> DataFrame:
    """(key, block): what a chat is told of itself: the summary (key, summary) of older turns, the last `n`
    turns with long answers cut, and the mentions so far; parts that are empty are left out.

    A user's turn is a question, another's an answer.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(turn), F.desc("text"))
    d = turns.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
    text = F.coalesce("text", F.lit(""))
    line = F.when(F.col("role") == "user", F.concat(F.lit("**Q:** "), text)).otherwise(F.concat(F.lit("**A:** "), preview(text, most, mark)))
    lines = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("line")))).alias("lines"))
    j = lines.join(summaries.select(key, "summary"), key, "left").join(focus(turns, key), key, "left")
    part = lambda head, body: F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(F.lit(f"## {head}\n"), body))
    return j.select(
        key,
        F.concat_ws(
            "\n\n", part(SUMMARY, F.col("summary")), part(RECENT, F.array_join(F.transform("lines", lambda x: x.line), "\n")),
            part(FOCUS, F.array_join("entities", ", ")),
        ).alias("block"),
    )


def corpus(*sources: DataFrame) -> DataFrame:
    """All document sources as one corpus; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
