"""Turning points, pivot lines, wave comparisons, trading days, and ticks to orders as a stream."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import calendar as C
from tickloom.operators import machines as M
from tickloom.operators import turns as T
from tickloom.streaming import trading as TD

T0 = dt.datetime(2024, 1, 1)


def at(i):
    return T0 + dt.timedelta(minutes=i)


def test_turning_points_latest_tie(spark):
    rows = [("a", at(i), float(c), w, d) for i, (c, w, d) in enumerate([(1, 0, 1), (5, 0, 1), (5, 0, 1), (2, 1, -1), (3, 1, -1), (9, 2, 1)])]
    got = T.turning_points(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, wave long, direction int")).orderBy("wave").collect()
    assert [(x["wave"], x["ts"], x["price"]) for x in got] == [(0, at(2), 5), (1, at(3), 2)]


def test_pivot_line_by_hand(spark):
    """A session of two pivots, one of one pivot with a live end, one shut row that breaks it."""
    pivots = [None, 10, None, None, 4, None, None, 8, None, None, None]
    session = [1] * 6 + [2] * 5
    rows = [("a", at(i), s, p, 20.0, True) for i, (p, s) in enumerate(zip(pivots, session, strict=True))]
    rows += [("b", at(0), 1, 6.0, 1.0, True), ("b", at(1), 1, None, 0.0, False), ("b", at(2), 1, None, 0.0, True), ("c", at(0), 1, None, 1.0, True)]
    schema = "symbol string, ts timestamp_ntz, session int, pivot double, live double, o boolean"
    rows = [(k, t, s, None if p is None else float(p), v, o) for k, t, s, p, v, o in rows]
    got = T.pivot_line(spark.createDataFrame(rows, schema), open_="o").orderBy("symbol", "ts").collect()
    assert [x["line"] for x in got] == pytest.approx([None, 10, 8, 6, 4, None, None, 8, 12, 16, 20, 6, None, None, None])
    shut = T.pivot_line(spark.createDataFrame(rows, schema)).where("symbol = 'b'").orderBy("ts").collect()
    assert [x["line"] for x in shut] == [6, 3, 0]


def brute_flags(waves, policy):
    vols, ers, up, down, out = [0.0] * 4, [0.0] * 4, (0.0, 0.0), (0.0, 0.0), []
    for d, v, s in waves:
        er = v / s if s > 0 else 0.0
        large = [int(0.0 not in q and x > sum(q) / 4 * 1.5) for q, x in ((vols, v), (ers, er))]
        same, other = (up, down) if d == 1 else (down, up)
        out.append((*large, *(1 if v > q[0] else -1 for q in (same, other)), *(1 if er > q[1] else -1 for q in (same, other))))
        up, down = ((v, er), down) if d == 1 else (up, (v, er))
        push = other if policy == "inverted" else (v, er)
        vols, ers = [*vols[1:], push[0]], [*ers[1:], push[1]]
    return out


@pytest.mark.parametrize("policy", ["current", "same", "inverted"])
def test_wave_flags(spark, policy):
    r = np.random.default_rng(2)
    waves = [(int(r.choice([1, -1])), float(r.integers(0, 9)), float(r.integers(0, 4))) for _ in range(60)]
    df = spark.createDataFrame([("a", i, *w) for i, w in enumerate(waves)], "symbol string, wave long, direction int, vol double, disp double")
    got = T.wave_flags(df, policy).orderBy("wave").select("large_wave", "large_er", "vs_same", "vs_other", "er_vs_same", "er_vs_other").collect()
    assert list(map(tuple, got)) == brute_flags(waves, policy)


def test_trading_days(spark):
    """The exchange's own calendar of 2021 to 2024."""
    shut = """2021-01-01 2021-01-18 2021-02-15 2021-04-02 2021-05-31 2021-07-05 2021-09-06 2021-11-25 2021-12-24
    2022-01-17 2022-02-21 2022-04-15 2022-05-30 2022-06-20 2022-07-04 2022-09-05 2022-11-24 2022-12-26
    2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25
    2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25""".split()
    got = {str(x["day"]) for x in C.trading_days(spark, "2021-01-01", "2024-12-31").collect()}
    every = {str(dt.date(2021, 1, 1) + dt.timedelta(days=i)) for i in range(1461)}
    assert every - got - set(shut) == {d for d in every if dt.date.fromisoformat(d).weekday() > 4} and not got & set(shut)
    easters = spark.createDataFrame([(y,) for y in (1954, 1981, 2000, 2016, 2038, 2049)], "y int").select(C.easter(F.col("y")).cast("string").alias("d")).collect()
    assert [x["d"] for x in easters] == ["1954-04-18", "1981-04-19", "2000-04-23", "2016-03-27", "2038-04-25", "2049-04-18"]


def test_completed(spark):
    days = C.trading_days(spark, "2024-03-27", "2024-04-02")
    panel = spark.createDataFrame([("a", dt.date(2024, 3, 28), 3), ("a", dt.date(2024, 3, 29), 9), ("b", dt.date(2024, 4, 1), None)], "symbol string, day date, n int")
    got = C.completed(panel, days, ["n"]).orderBy("symbol", "day").collect()
    assert [(x["symbol"], x["day"].day, x["n"]) for x in got] == [("a", 27, 0), ("a", 28, 3), ("a", 1, 0), ("a", 2, 0), ("b", 27, 0), ("b", 28, 0), ("b", 1, 0), ("b", 2, 0)]


def tick_rows(n=900):
    r = np.random.default_rng(6)
    return [("ab"[i % 2], T0 + dt.timedelta(minutes=int(i * 7)), i, float(round(100 + 40 * np.sin(i / 30) + r.normal(0, 8), 2)), 1.0, float(r.integers(-2, 3))) for i in range(n)]


@pytest.mark.parametrize("rows", [10**6, 100])
def test_stream_of_orders_equals_the_batch_over_restarts(spark, tmp_path, monkeypatch, rows):
    """Files arrive while the query is stopped; it goes on with its open bars, closes and positions."""
    monkeypatch.setattr(M, "SLICE", rows)
    schema = "symbol string, ts timestamp, seq long, price double, size double, signed double"
    data, args = tick_rows(), {"size": 12.0, "n": 6, "least": 4, "band": 0.05, "limit": 50.0}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    os.makedirs(tmp_path / "in")
    try:
        for k, cut in enumerate((slice(0, 200), slice(200, 520), slice(520, 900))):
            spark.createDataFrame(data[cut], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            q = TD.stream_traded(stream, **args).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(180) is not False
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, TD.traded(spark.createDataFrame(data, schema.replace("timestamp", "timestamp_ntz")), **args).collect()))
    assert len(got) == len(want) > 40 and any(x[8] for x in want)
    assert [x[:2] + x[4:6] + x[8:] for x in got] == [x[:2] + x[4:6] + x[8:] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want]) and [x[6:8] for x in got] == [pytest.approx(x[6:8]) for x in want]
