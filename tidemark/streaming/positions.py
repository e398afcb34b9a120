"""The live risk rules as a stream of candles with typed state and timers.

A symbol's state is its position, the day's buys, the means of its RSI and the candles whose turn
hasn't come; nothing else is kept, however long the stream. Candles wait until the watermark passes
them and are then taken in order of time, so late and disordered ones within the watermark change
nothing. The daily counter goes by a timer at the end of its day, and a symbol that has been
silent and holds nothing is forgotten by another.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_EVEN, Decimal
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.positions import DAILY_BUYS, QUANTITY, TRADE, Position

#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def day_end(time_ms: int, zone: str = "UTC") -> int:
    """When the calendar day of a time ends in `zone`."""
    local = datetime.fromtimestamp(time_ms / 1000, timezone.utc).astimezone(ZoneInfo(zone))
    following = datetime.combine(local.date() + timedelta(days=1), datetime.min.time(), ZoneInfo(zone))
    return int(following.timestamp() * 1000)


def next_means(state: tuple | None, close: float, period: int) -> tuple[tuple, float | None]:
    """(closes, last close, mean gain, mean loss) after one more close, and Wilder's RSI once there are enough."""
    if state is None:
        return (1, close, 0.0, 0.0), None
    n, last, gain, loss = state
    up, down = max(close - last, 0.0), max(last - close, 0.0)
    if n <= period:  # the first means are plain
        gain, loss = gain + up / period, loss + down / period
    else:
        gain, loss = (gain * (period - 1) + up) / period, (loss * (period - 1) + down) / period
    rsi = None
    if n >= period:
        exact = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        rsi = float(Decimal(repr(exact)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))
    return (n + 1, close, gain, loss), rsi


class RiskRules(StatefulProcessor):
    def __init__(self, oversold: float, overbought: float, period: int, zone: str, forget_ms: int | None):
        self.oversold, self.overbought, self.period, self.zone, self.forget_ms = oversold, overbought, period, zone, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entry double")
        self.today = handle.getValueState("today", "until long, buys int")
        self.means = handle.getValueState("means", "n long, close double, gain double, loss double")
        self.seen = handle.getValueState("seen", "time long")
        self.waiting = handle.getMapState("waiting", "time long", "close double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r.open_time > passed or passed <= 0:
                self.waiting.updateValue((r.open_time,), (r.close,))
                self.handle.registerTimer(r.open_time)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        today = self.today.get()
        if today is not None and today[0] <= now:
            self.today.clear()
        if self.waiting.containsKey((now,)):
            close = self.waiting.getValue((now,))[0]
            self.waiting.removeKey((now,))
            yield from self._step(key[0], now, close)
        seen = self.seen.get()
        if self.forget_ms is not None and seen is not None and seen[0] + self.forget_ms <= now and not self.held.exists():
            self.means.clear()
            self.seen.clear()

    def _step(self, symbol: str, now: int, close: float | None) -> Iterator[Row]:
        if close is None or close != close:
            return
        means, rsi = next_means(self.means.get(), close, self.period)
        self.means.update(means)
        held, today = self.held.get(), self.today.get()
        p = Position(held[0] if held else None, 0, today[1] if today else 0)
        for side, price, at, pnl, reason in p.step(now, close, rsi, self.oversold, self.overbought, day=0):
            yield Row(symbol=symbol, open_time=now, side=side, quantity=QUANTITY, price=price, rsi=at, pnl=pnl, reason=reason)
        if p.entry is None:
            self.held.clear()
        else:
            self.held.update((p.entry,))
        if p.buys > (today[1] if today else 0):
            until = day_end(now, self.zone)
            self.today.update((until, p.buys))
            self.handle.registerTimer(until)
        if self.forget_ms is not None:
            self.seen.update((now,))
            self.handle.registerTimer(now + self.forget_ms)


def risk_log(
    candles: DataFrame, oversold: float = 30, overbought: float = 70, period: int = 14, zone: str = "UTC", late: str = "0 seconds", forget_ms: int | None = None
) -> DataFrame:
    """The trade log of a stream of candles (symbol, open_time, close): what `risk_fold` gives for those the watermark has passed.

    At most `DAILY_BUYS` buys a calendar day of `zone`. A candle that comes after the watermark has
    passed its time is left out; of two with one time the later one counts. With `forget_ms`, the
    means of a symbol without a position start anew after so long a silence. Needs the state store `ROCKS`.
    """
    c = candles.select("symbol", "open_time", "close", F.timestamp_millis("open_time").alias("time")).withWatermark("time", late)
    rules = RiskRules(oversold, overbought, period, zone, forget_ms)
    return c.groupBy("symbol").transformWithState(rules, TRADE, "append", "EventTime")


__all__ = ["DAILY_BUYS", "ROCKS", "RiskRules", "day_end", "next_means", "risk_log"]
