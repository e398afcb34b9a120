"""Text functions: tokens, identifiers, sentences, entities, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of Unicode letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+"
GAP = r"[^\p{L}\p{N}_]+"
#: The vocabulary that retrieval follows through a chat.
ENTITIES = (
    r"exchange\s+(?:net)?flow", "SOPR", "MVRV", "NUPL", r"funding\s+rate", "whale?", r"open\s+interest", "RSI", "Bollinger", "MACD",
    r"miner\s+outflow", r"realized\s+price", r"exchange\s+reserve", "liquidation", r"fear\s+and\s+greed", "volatility", "momentum",
    "support", "resistance",
)


def tokens(text: Column) -> Column:
    """The tokens of a text in lower case; it is cut at what is none, which costs a fraction of collecting matches."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def identifier(*parts: Column, most: int = 200) -> Column:
    """Parts joined by underscores, with anything but letters, digits, `_.-` replaced, cut to `most` characters."""
    return F.substring(F.regexp_replace(F.concat_ws("_", *parts), r"[^A-Za-z0-9_.-]+", "_"), 1, most)


def entities(text: Column, patterns: tuple[str, ...] = ENTITIES) -> Column:
    """Distinct mentions in lower case, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:" + "|".join(patterns) + r")\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def preview(text: Column, n: int, mark: str = " […]") -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit(mark))).otherwise(text)


def server_preview(text: Column, n: int = 500) -> Column:
    """The other form of a preview: cut where it is, with another mark."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(" [...]"))).otherwise(text)


def date_prefix(moment: Column) -> Column:
    """The day of an ISO time: its first ten characters."""
    return F.substring(moment, 1, 10)


def sentence_trim(text: Column, most: int = 500) -> Column:
    """Whole sentences up to `most` characters; a longer first sentence is cut there."""
    flat = squeezed(text)
    first = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def take(a: Column, s: Column) -> Column:
        longer = F.when(a.out == "", s).otherwise(F.concat(a.out, F.lit(" "), s))
        fits = a.open & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(a.out).alias("out"), fits.alias("open"))

    kept = F.aggregate(F.split(flat, r"(?<=[.!?])\s+"), first, take).out
    cut = F.when(kept != "", kept).otherwise(F.rtrim(F.substring(flat, 1, most)))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit(" […]")))


def default_title(*choices: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit("untitled"))


def streamed_content(line: Column) -> Column:
    """The text a recorded line of a chat stream adds; null for other lines and the end mark."""
    body = F.regexp_extract(line, r"^data:\s*(\{.*\})\s*$", 1)
    return F.get_json_object(F.nullif(body, F.lit("")), "$.choices[0].delta.content")
