"""The risk rules as timed state, over many batches, restarts, late rows and silence."""

import math
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import positions as P
from tidemark.streaming import live, positions

H, DAY = 3_600_000, 86_400_000
SCHEMA = "symbol string, open_time long, close double"


def series(symbols, n, seed=1, step=H):
    rng = random.Random(seed)
    out = []
    for s in symbols:
        price = 100.0
        for t in range(1, n + 1):
            price = round(price * (1 + rng.gauss(0, 0.012)), 3)
            out.append((s, t * step, price))
    return sorted(out, key=lambda r: r[1])


def write(spark, rows, folder, parts):
    """Files of whole hours, as nothing is late here."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, **more):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return positions.risk_log(s, 45, 55, **more)


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def batch(spark, given, zone="UTC"):
    d = X.wilder_rsi(spark.createDataFrame(given, SCHEMA))
    last = max(r[1] for r in given)
    return [r for r in rows(P.risk_fold(d, 45, 55, zone)) if r[1] <= last]


def test_stream_equals_the_fold_over_many_batches_and_a_restart(spark, tmp_path):
    given = series("abc", 240)
    write(spark, given[:300], f"{tmp_path}/in", 5)
    first = live.run_to_table(stream(spark, f"{tmp_path}/in"), "append", f"{tmp_path}/out", positions.ROCKS).count()
    write(spark, given[300:], f"{tmp_path}/in", 7)  # another run goes on from the checkpoint
    got = rows(live.run_to_table(stream(spark, f"{tmp_path}/in"), "append", f"{tmp_path}/out", positions.ROCKS))
    want = batch(spark, given)
    assert got == want and 0 < first < len(got) and {r[7] for r in got} == {"RSI_SIGNAL", "STOP_LOSS", "TAKE_PROFIT"}


def test_disorder_within_the_watermark_changes_nothing(spark, tmp_path):
    given = series("ab", 120, seed=4)
    rng = random.Random(5)
    near = sorted(given, key=lambda r: r[1] + rng.randint(0, 3 * H))
    write(spark, near, f"{tmp_path}/in", 6)
    got = rows(live.run_to_table(stream(spark, f"{tmp_path}/in", late="6 hours"), "append", f"{tmp_path}/out", positions.ROCKS))
    cut = max(r[1] for r in given) - 6 * H
    assert got == [r for r in batch(spark, given) if r[1] <= cut] != []


def test_days_end_by_a_timer(spark, tmp_path):
    # five buys a day at most: prices that trigger a buy and a profit each hour
    rng = random.Random(9)
    given, price = [], 100.0
    for t in range(1, 241):
        price = price * (0.96 if t % 2 else 1.035)
        given.append(("a", t * 900_000, round(price, 4)))
    write(spark, given, f"{tmp_path}/in", 4)
    for zone in ("UTC", "Asia/Tokyo"):
        got = rows(live.run_to_table(stream(spark, f"{tmp_path}/in", zone=zone), "append", f"{tmp_path}/{zone[:3]}", positions.ROCKS))
        assert got == batch(spark, given, zone)
        days = {}
        for r in got:
            if r[2] == "BUY":
                day = int((r[1] + ZoneInfo(zone).utcoffset(__import__("datetime").datetime(1970, 1, 5)).total_seconds() * 1000) // DAY)
                days[day] = days.get(day, 0) + 1
        assert len(days) > 1 and max(days.values()) == P.DAILY_BUYS
    assert rng


def test_state_stays_small_and_silent_symbols_are_forgotten(spark, tmp_path):
    given = series(["a"], 40) + [("b", 41 * H, 5.0)] + [("a", 1000 * H + t * H, 50.0 + t) for t in range(4)] + [("b", 2000 * H, 6.0), ("b", 2001 * H, 6.0)]
    write(spark, given, f"{tmp_path}/in", len(given) // 4)
    live.run_to_table(stream(spark, f"{tmp_path}/in", forget_ms=100 * H), "append", f"{tmp_path}/out", positions.ROCKS)
    state = lambda name, **o: spark.read.format("statestore").options(stateVarName=name, **o).load(f"{tmp_path}/out/checkpoint")
    means = {r["key"][0]: r["value"]["n"] for r in state("means").collect()}
    assert means.get("a", 0) <= 4 and means["b"] <= 2  # the means from before the silence are gone
    assert state("waiting", flattenCollectionTypes="true").count() <= 2


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_day_end(zone):
    from datetime import datetime

    for text in ("2024-03-31T00:30", "2024-10-27T12:00", "2024-06-01T23:59", "2024-01-01T00:00"):
        now = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone))
        end = datetime.fromtimestamp(positions.day_end(int(now.timestamp() * 1000), zone) / 1000, ZoneInfo(zone))
        assert (end.hour, end.minute) == (0, 0) and end.date().toordinal() == now.date().toordinal() + 1


def test_means_equal_the_batch(spark):
    given = series(["a"], 60, seed=8)
    state, got = None, {}
    for _, t, close in given:
        state, got[t] = positions.next_means(state, close, 14)
    want = {r["open_time"]: r["rsi"] for r in X.wilder_rsi(spark.createDataFrame(given, SCHEMA)).collect()}
    assert got == want and sum(v is not None for v in got.values()) == 46
    assert positions.next_means((14, 1.0, 0.0, 0.0), 2.0, 14)[1] == 100.0 and not math.isnan(state[2])
    assert F is not None
