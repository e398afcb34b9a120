"""What the catalogues share: a registry, rounding, and common table expressions of the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of their terms in the last bits; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else c for c, t in df.dtypes))


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


TICKS = """ticks AS (SELECT event_id, event_type AS symbol, value AS price, user_id, ts, epoch_us(ts) // 1000 AS t,
  CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS quantity FROM events)"""


def candles_cte(width: int = 3_600_000, keys: str = "symbol, ", name: str = "candles") -> str:
    at = "{'a': ts, 'b': event_id}"
    return f"""{name} AS (SELECT {keys}t // {width} * {width} AS open_time, arg_min(price, {at}) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, {at}) AS close, sum(quantity) AS volume, count(*) AS trade_count FROM ticks GROUP BY ALL)"""


GRID = """grid AS (SELECT s.symbol, s.open_time, open, high, low, close, volume, trade_count, c.symbol IS NOT NULL AS is_real
  FROM (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, 3600000)) AS open_time FROM candles GROUP BY symbol) s
  LEFT JOIN candles c ON c.symbol = s.symbol AND c.open_time = s.open_time)"""
#: With the CTE `grid`: each symbol's candles on its complete hourly grid.
HOURLY = f"WITH RECURSIVE {TICKS}, {candles_cte()}, {GRID}"
#: The window of a series in time.
W = "PARTITION BY symbol ORDER BY open_time"


def full(agg: str, x: str, n: int) -> str:
    """A rolling aggregate over n rows that needs n values."""
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def z(x: str, n: int) -> str:
    return f"(({x}) - ({full('avg', x, n)})) / nullif({full('stddev_samp', x, n)}, 0)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def ewm_cte(src: str, x: str, alpha: float, out: str, adjust: bool = False) -> str:
    """CTE `out` (symbol, rn, y, nobs): the weighted mean of src.x by its recursion; src needs symbol and open_time."""
    a, new = f"CAST({1 - alpha!r} AS DOUBLE)", "CAST(1 AS DOUBLE)" if adjust else f"CAST({alpha!r} AS DOUBLE)"
    weight = f"r.w * {a} + 1" if adjust else "CAST(1 AS DOUBLE)"
    return f"""{out}_s AS MATERIALIZED (SELECT symbol, CAST({x} AS DOUBLE) AS x, row_number() OVER ({W}) AS rn FROM {src}),
{out} AS (SELECT symbol, rn, x AS y, CAST(1 AS DOUBLE) AS w, CAST(x IS NOT NULL AS BIGINT) AS nobs FROM {out}_s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, CASE WHEN s.x IS NULL THEN r.y WHEN r.nobs = 0 THEN s.x ELSE (r.w * {a} * r.y + {new} * s.x) / (r.w * {a} + {new}) END,
    CASE WHEN s.x IS NULL THEN r.w * {a} WHEN r.nobs = 0 THEN CAST(1 AS DOUBLE) ELSE {weight} END, r.nobs + CAST(s.x IS NOT NULL AS BIGINT)
  FROM {out} r JOIN {out}_s s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""
