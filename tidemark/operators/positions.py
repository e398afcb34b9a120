"""Stateful trading rules: the live risk rules and the portfolio, each a fold along a series.

Their state depends on every step before, so each series is folded in order: rows are dealt out by
symbol, sorted, and read batch by batch with the state carried along. No series has to fit in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP_LOSS, TAKE_PROFIT, DAILY_BUYS, QUANTITY = 0.02, 0.03, 5, 0.001
DAY_MS = 86_400_000
TRADE = "symbol string, open_time long, side string, quantity double, price double, rsi double, pnl double, reason string"


def folded(df: DataFrame, columns: list[str], start: Callable, schema: str, types: list[pa.DataType]) -> DataFrame:
    """The rows that a fold of each symbol's rows gives, in order of open_time.

    `start` makes the fold of a symbol: an object with step(*values of `columns`) and end(), both
    giving rows. A batch at a time is in memory, and one fold.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, fold = None, None
        for batch in batches:
            rows: list[tuple] = []
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or key != symbol:
                    rows += fold.end() if fold else []
                    symbol, fold = key, start(key)
                rows += fold.step(*values)
            if rows:
                yield made(rows)
        if fold and (rows := list(fold.end())):
            yield made(rows)

    dealt = df.select("symbol", *columns).repartition("symbol").sortWithinPartitions("symbol", "open_time")
    return dealt.mapInArrow(run, schema)


def local_day(time_ms: str, zone: str = "UTC"):
    """The number of the calendar day of a time in `zone`, on which daily counters start anew."""
    return F.unix_date(F.to_date(F.from_utc_timestamp(F.timestamp_millis(time_ms), zone)))


@dataclass
class Position:
    """One symbol's position: what it paid, and the buys of the day."""

    entry: float | None = None
    day: int = -1
    buys: int = 0

    def step(self, time_ms: int, price: float | None, rsi: float | None, oversold: float = 30, overbought: float = 70, day: int | None = None) -> list[tuple]:
        """Trades (side, price, rsi, pnl, reason) of a step: risk comes first, then the signal. `day` is UTC's if not given."""
        out: list[tuple] = []
        if price is None or math.isnan(price):
            return out
        if rsi is not None and math.isnan(rsi):
            rsi = None
        day = time_ms // DAY_MS if day is None else day
        if day != self.day:
            self.day, self.buys = day, 0
        if self.entry is not None:
            moved = (price - self.entry) / self.entry
            if moved <= -STOP_LOSS or moved >= TAKE_PROFIT:
                out.append(self._sell(price, None, "STOP_LOSS" if moved <= -STOP_LOSS else "TAKE_PROFIT"))
        if rsi is not None and rsi < oversold and self.entry is None and self.buys < DAILY_BUYS:
            self.entry, self.buys = price, self.buys + 1
            out.append(("BUY", price, rsi, 0.0, "RSI_SIGNAL"))
        elif rsi is not None and rsi > overbought and self.entry is not None:
            out.append(self._sell(price, rsi, "RSI_SIGNAL"))
        return out

    def _sell(self, price: float, rsi: float | None, reason: str) -> tuple:
        pnl, self.entry = round((price - self.entry) * QUANTITY, 4), None
        return ("SELL", price, rsi, pnl, reason)


TRADE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]


def risk_fold(steps: DataFrame, oversold: float = 30, overbought: float = 70, zone: str = "UTC") -> DataFrame:
    """The trade log of each symbol's steps (symbol, open_time, close, rsi) in order of time; days are those of `zone`."""

    class Fold:
        def __init__(self, symbol: str):
            self.symbol, self.position = symbol, Position()

        def step(self, time_ms: int, price: float | None, rsi: float | None, day: int) -> list[tuple]:
            done = self.position.step(time_ms, price, rsi, oversold, overbought, day)
            return [(self.symbol, time_ms, side, QUANTITY, p, r, pnl, reason) for side, p, r, pnl, reason in done]

        def end(self) -> list[tuple]:
            return []

    d = steps.withColumn("day", local_day("open_time", zone))
    return folded(d, ["open_time", "close", "rsi", "day"], Fold, TRADE, TRADE_TYPES)


@dataclass
class Walk:
    """One position at a time along a series of bars.

    Entry is at the signal's close; from the next bar on the stop comes before the target, and
    `max_bars` later, or at the last bar, the close ends it. A bar that ends a trade can begin another.
    """

    upper: float
    lower: float
    max_bars: int
    paid: float | None = None
    age: int = 0

    def bar(self, close: float, high: float, low: float, entry: bool, last: bool) -> tuple[float, float, int, str] | None:
        """What the bar ends: price paid, price got, bars held, reason."""
        done = None
        if self.paid is not None:
            self.age += 1
            if low <= self.paid * (1 - self.lower):
                done = (self.paid * (1 - self.lower), "stop")
            elif high >= self.paid * (1 + self.upper):
                done = (self.paid * (1 + self.upper), "target")
            elif self.age >= self.max_bars or last:
                done = (self.paid if math.isnan(close) else close, "time")
        out = done and (self.paid, done[0], self.age, done[1])
        if done:
            self.paid, self.age = None, 0
        if self.paid is None and entry and not last and not math.isnan(close):
            self.paid, self.age = close, 0
        return out


PORTFOLIO = (
    "symbol string, n_trades long, n_wins long, win_rate double, total_return double, max_drawdown double, sharpe double, "
    "sortino double, calmar double, avg_bars double, best double, worst double"
)
PORTFOLIO_TYPES = [pa.string(), pa.int64(), pa.int64()] + [pa.float64()] * 9


@dataclass
class Account:
    """Running figures of a portfolio's returns, bar by bar."""

    bars: int = 0
    level: float = 0.0  # logarithm of the equity
    peak: float = -math.inf
    fall: float = 0.0
    mean: float = 0.0
    spread: float = 0.0  # sum of squared distances from the mean
    below: float = 0.0  # sum of squared losses
    trades: list[float] = field(default_factory=lambda: [0, 0, 0, -math.inf, math.inf])  # number, wins, bars, best, worst

    def add(self, ret: float, held: int | None) -> None:
        self.bars += 1
        self.level += math.log1p(ret)
        self.peak = max(self.peak, self.level)
        self.fall = min(self.fall, math.expm1(self.level - self.peak))
        step = ret - self.mean
        self.mean += step / self.bars
        self.spread += step * (ret - self.mean)
        self.below += min(ret, 0.0) ** 2
        if held is not None:
            n, wins, bars, best, worst = self.trades
            self.trades = [n + 1, wins + (ret > 0), bars + held, max(best, ret), min(worst, ret)]

    def row(self, symbol: str, bars_a_year: int) -> tuple:
        n, wins, bars, best, worst = self.trades
        total, year = math.expm1(self.level), bars_a_year**0.5
        sd = (self.spread / (self.bars - 1)) ** 0.5 if self.bars > 1 else 0.0
        down = (self.below / self.bars) ** 0.5
        return (
            symbol, n, wins, wins / n if n else None, total, self.fall, self.mean / sd * year if sd else None, self.mean / down * year if down else None,
            total / -self.fall if self.fall else None, bars / n if n else None, best if n else None, worst if n else None,
        )


def portfolio(
    df: DataFrame, upper: float, lower: float, max_bars: int, fee: float = 0.001, slippage: float = 0.0003, bars_a_year: int = 8760
) -> DataFrame:
    """A portfolio per symbol of rows (symbol, open_time, close, high, low, entry): all capital in one position at a time.

    Half the fee and the slippage are paid on each side. Returns count at a trade's exit; Sharpe
    and Sortino are over all bars' returns, a year's worth; null where undefined.
    """

    class Fold:
        def __init__(self, symbol: str):
            self.symbol, self.walk, self.account, self.bar = symbol, Walk(upper, lower, max_bars), Account(), None

        def _take(self, last: bool) -> None:
            done = self.walk.bar(*self.bar, last)
            if done is None:
                return self.account.add(0.0, None)
            paid, got, held, _ = done
            self.account.add(got * (1 - slippage) * (1 - fee / 2) / (paid * (1 + slippage) * (1 + fee / 2)) - 1, held)

        def step(self, time_ms: int, *bar) -> list[tuple]:
            if self.bar is not None:
                self._take(False)  # now it is known that it wasn't the last
            *prices, entry = bar
            self.bar = (*(math.nan if p is None else p for p in prices), bool(entry))
            return []

        def end(self) -> list[tuple]:
            self._take(True)
            return [self.account.row(self.symbol, bars_a_year)]

    return folded(df, ["open_time", "close", "high", "low", "entry"], Fold, PORTFOLIO, PORTFOLIO_TYPES)
