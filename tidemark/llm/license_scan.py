"""License scans: base phrases, and an exact containment join of text blocks with license templates.

A template matches a block, any `width` words in a row of a text, that holds at least
ceil(`threshold` * size) of its distinct tokens; blocks start at every word. Candidates come from a
join on tokens: with the templates' tokens ordered from rare to frequent over the whole corpus, a
block holding `need` of a template's `size` tokens holds one of its `size - need + 1` rarest, so
only those prefixes are joined, and each text keeps one row a template, that of the rarest one it
has. The length filter drops texts with fewer than `need` of its tokens; the positional filter keeps
only stretches around prefix tokens with enough tokens of the same or a later place in the order.
What remains is counted exactly: an occurrence is the first of its token in the blocks that start
after the one before it, so the count over all starts is a running sum of +1 and -1.

The templates are data, so that hundreds of whole license texts make the plan no larger. Only texts
that pass all filters move through a shuffle, and no token is joined that isn't in a prefix.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import narrowed, stored

#: The pattern of a word after A-Z are lower-cased, and the base phrases.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What stands between words; cutting there costs a fraction of collecting the words one by one.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Labels and license texts or notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)
#: Words of a block: `STRETCH` times the template's, `BLOCK` at least. Templates of more than `LONG` words need a smaller share.
BLOCK, STRETCH, LONG, THRESHOLD, LONG_THRESHOLD = 32, 1.25, 32, 0.9, 0.8


def _tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.translate({c: c + 32 for c in range(65, 91)}))


def template_rows(templates: tuple[tuple[str, str], ...], threshold: float = THRESHOLD, long_threshold: float = LONG_THRESHOLD) -> list[dict]:
    """Label, distinct tokens, size, need and width of each template that has a word."""
    rows = []
    for label, text in templates:
        words = _tokens(text)
        tokens = sorted(set(words))
        share = long_threshold if len(words) > LONG else threshold
        need = max(1, math.ceil(round(share * len(tokens), 9)))
        if words:
            rows.append({"label": label, "tokens": tokens, "size": len(tokens), "need": need, "width": max(BLOCK, math.ceil(STRETCH * len(words)))})
    return rows


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of literals."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def once(x: Column) -> Column:
    """`x` by way of a generator, past which the optimiser neither repeats nor moves it."""
    return F.explode(F.array(x))


def _hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    # lower() maps one other character, the Kelvin sign, to an ASCII letter
    low = F.lower(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u212a"), F.lit("\u00df")))
    words = docs.select("doc_id", once(F.array_remove(F.split(low, GAP, -1), "")).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.cast("int").alias("p"), w.alias("t")))
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(placed, lambda h: h.t.isin(vocabulary)).alias("hits"),
    )


def _phrase_at(hits: str, h: Column, i: Column, words: list[str]) -> Column:
    """Whether the phrase starts at hit `i`: its words are hits, so they follow each other there."""
    found = h.t == words[0]
    for k, w in enumerate(words[1:], 1):
        other = F.get(F.col(hits), i + k)
        found = found & F.coalesce((other.t == w) & (other.p == h.p + k), F.lit(False))
    return found


def candidates(found: DataFrame, prefixes: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Hits (rid, k, need, width, p, t) of texts and templates that pass the filters and that a matching block can hold.

    `prefixes` has a row per template and prefix token: t, its place i in the template's order from 0,
    and the template's k, tokens (in that order), need and width. Hits are grouped by cells of `width`
    words; a block lies in two neighbouring ones. Each hit stands in three groups, so that the work
    on a text grows with its length.
    """
    rows = found.select("rid", "n_words", "hits", once(F.array_distinct("hits.t")).alias("own"))
    rows = rows.select("*", F.explode(F.filter("own", lambda t: t.isin(vocabulary))).alias("t")).join(prefixes, "t")
    # one row a template: that of the rarest prefix token in the text; then the length filter on all its tokens
    rarest = (F.col("i") == 0) | ~F.arrays_overlap(F.slice("tokens", F.lit(1), F.greatest(F.col("i"), F.lit(1))), "own")
    rows = rows.filter((F.col("n_words") >= F.col("need")) & rarest & (F.size(F.array_intersect("tokens", "own")) >= F.col("need")))
    rows = rows.select("rid", "k", "need", "width", "tokens", F.explode("hits").alias("h"))
    place = F.array_position("tokens", F.col("h.t")).cast("int")
    rows = rows.select("rid", "k", "need", "width", F.size("tokens").alias("size"), "h", place.alias("place")).filter("place > 0")
    cell = F.floor(F.col("h.p") / F.col("width")).cast("int")
    near = rows.withColumn("cell", cell).withColumn("c", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    mine = F.col("c") == F.col("cell")
    cells = near.groupBy("rid", "k", "need", "width", "c").agg(
        F.min(F.when(mine & (F.col("place") <= F.col("size") - F.col("need") + 1), F.col("place"))).alias("first"),
        F.collect_set("place").alias("around"),
        F.collect_list(F.when(mine, F.col("h"))).alias("hits"),
    )
    # the positional filter: around a prefix token, enough tokens of its place in the order or a later one
    later = F.size(F.filter("around", lambda i: i >= F.col("first")))
    cells = cells.withColumn("open", F.coalesce(later >= F.col("need"), F.lit(False)))
    w = Window.partitionBy("rid", "k").orderBy("c")
    beside = lambda f, d: F.coalesce(f("open").over(w) & (f("c").over(w) == F.col("c") + d), F.lit(False))
    cells = cells.withColumn("near", F.col("open") | beside(F.lag, -1) | beside(F.lead, 1)).filter("near")
    return cells.select("rid", "k", "need", "width", F.inline("hits"))


def best_blocks(hits: DataFrame) -> DataFrame:
    """For each text and template (rid, k) of `candidates` with a match: the most tokens `n` in a block, and its first start."""
    before = F.lag("p").over(Window.partitionBy("rid", "k", "t").orderBy("p"))
    # the token's first occurrence in the blocks that start here
    low = F.greatest(before + 1, F.col("p") - F.col("width") + 1, F.lit(0))
    turn = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    steps = hits.withColumn("low", low).select(
        "rid", "k", "need", F.inline(F.array(turn(F.col("low"), 1), turn(F.col("p") + 1, -1)))
    )
    count = F.sum("d").over(Window.partitionBy("rid", "k").orderBy("at"))
    most = steps.withColumn("n", count).groupBy("rid", "k", "need").agg(F.max(F.struct("n", (-F.col("at")).alias("back"))).alias("best"))
    most = most.filter(F.col("best.n") >= F.col("need"))
    return most.select("rid", "k", F.col("best.n").alias("n"), (-F.col("best.back")).alias("start"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    long_threshold: float = LONG_THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Null and empty texts have no words, no labels and score 0. Repeated rows and null ids are
    scanned like any other, an empty table gives an empty one, and other columns are ignored.
    score is 1 where a base phrase stands, else the best containment that reaches the threshold,
    else 0. matches lists label, start and width (in words, from 0) of the first best block of each
    template that matches, and how many of its tokens it holds of how many; a template without a
    word matches nothing. Texts of any length are scanned whole, in time that grows with their words.
    """
    spark = docs.sparkSession
    base = [(phrase.split(), label) for phrase, label in BASE_PHRASES.items()]
    rows = template_rows(templates, threshold, long_threshold)
    vocabulary = sorted({w for words, _ in base for w in words} | {t for r in rows for t in r["tokens"]})
    found = _hits(narrowed(docs, id_col, text_col), vocabulary).withColumn("rid", F.monotonically_increasing_id())
    found = stored(found, "license-hits")

    # one row per vocabulary token at most
    counted = found.select(F.explode("hits.t").alias("t")).groupBy("t").count().collect()
    frequency = {r["t"]: r["count"] for r in counted}
    for k, r in enumerate(rows):
        r |= {"k": k, "tokens": sorted(r["tokens"], key=lambda t: (frequency.get(t, 0), t))}
    prefix_rows = [r | {"t": t, "i": i} for r in rows for i, t in enumerate(r["tokens"][: r["size"] - r["need"] + 1])]
    prefixes = _small(spark, prefix_rows, "t: string, i: int, k: int, tokens: array<string>, need: int, width: int")
    labels = _small(spark, rows, "k: int, label: string, size: int, width: int")
    if sum(len(r["tokens"]) for r in prefix_rows) <= 1_000_000:  # some 20 MB; beyond it Spark chooses the join
        prefixes, labels = F.broadcast(prefixes), F.broadcast(labels)
    best = best_blocks(candidates(found, prefixes, sorted({r["t"] for r in prefix_rows}))).join(labels, "k")
    match = F.struct("label", F.col("start").cast("long").alias("start"), F.col("width").cast("long").alias("width"), F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"))
    best = best.groupBy("rid").agg(F.array_sort(F.collect_list(match)).alias("matches"))

    kind = lambda h, i: F.lit(None).cast("string")
    for words, label in base:
        kind = lambda h, i, f=kind, w=words, x=label: F.when(_phrase_at("hits", h, i, w), x).otherwise(f(h, i))
    starts = F.filter(
        F.transform("hits", lambda h, i: F.struct(h.p.alias("p"), kind(h, i).alias("label"))),
        lambda s: s.label.isNotNull(),
    )
    step = found.select("rid", "doc_id", "n_words", starts.alias("starts")).join(best, "rid", "left")
    none = F.array().cast("array<struct<label:string,start:bigint,width:bigint,n:bigint,size:bigint>>")
    step = step.withColumn("matches", F.coalesce("matches", none))
    base_labels = F.array_distinct(F.col("starts.label"))
    share = F.array_max(F.transform("matches", lambda m: m.n / m["size"]))
    return step.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts.p").cast("long").alias("first_word"),
        F.array_max("starts.p").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("matches.label"))), ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).cast("double").alias("score"),
        "matches",
    )


def _oracle() -> str:
    base = "\n  UNION ALL ".join(
        f"SELECT '{label}' AS label, {words!r} AS words" for phrase, label in BASE_PHRASES.items() for words in [phrase.split()]
    )
    rows = ", ".join(
        f"({k}, '{r['label']}', '{t}', {r['size']}, {r['need']}, {r['width']})" for k, r in enumerate(template_rows(TEMPLATES)) for t in r["tokens"]
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{TOKEN}') AS ws FROM documents),
phrases AS ({base}),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w), phrases
  WHERE ws[i + 1:i + len(words)] = words),
b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS ls FROM places GROUP BY 1),
templates(k, label, t, size, need, width) AS (VALUES {rows}),
tok AS (SELECT doc_id, i, k, label, t, size, need, width FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS t FROM w) JOIN templates USING (t)),
d AS (SELECT doc_id, k FROM tok GROUP BY 1, 2 HAVING count(DISTINCT t) >= max(need)),
x AS (SELECT tok.* FROM tok JOIN d USING (doc_id, k)),
m AS (SELECT a.doc_id, a.label, count(DISTINCT c.t) AS n, max(a.size) AS size FROM x a JOIN x c ON c.doc_id = a.doc_id AND c.k = a.k
  AND c.i >= a.i AND c.i < a.i + a.width GROUP BY a.doc_id, a.k, a.label, a.i HAVING count(DISTINCT c.t) >= max(a.need)),
s AS (SELECT doc_id, list(DISTINCT label) AS ls, max(n / size) AS best FROM m GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word,
  CAST(hi AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(s.ls, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)"""


ORACLE_SQL = _oracle()
