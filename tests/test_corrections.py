"""Cases by hand for baselines, curves, reports, sessions and sliced scans."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import evaluation as E
from tickloom.operators import machines as M
from tickloom.operators import recurrence as R
from tickloom.operators import scans as S
from tickloom.operators import trades as T
from tickloom.streaming import sessions as SS

T0 = dt.datetime(2024, 1, 1)


def closes(spark, values, symbol="a"):
    rows = [(symbol, T0 + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


def test_sessions(spark):
    got = spark.range(24).select(T.session(F.col("id")).alias("s")).collect()
    assert [x["s"] for x in got] == ["asia"] * 6 + ["europe_am"] * 6 + ["europe_pm"] * 3 + ["us_am"] * 5 + ["us_pm"] * 4


def test_baselines_by_hand(spark):
    """Oracle: long, short, flat, with a half point of cost a unit of change."""
    got = T.baselines(closes(spark, [100, 110, 99, 99]), cost=0.5).first()
    oracle = (1 + 0.1 - 0.5 / 110) * (1 + 0.1 - 2 * 0.5 / 99) * (1 - 0.5 / 99)
    assert got["n"] == 3 and got["hold_log"] == pytest.approx(math.log(0.99)) and got["oracle_log"] == pytest.approx(math.log(oracle))
    assert got["sma_log"] == 0 and got["sma_sign"] == got["oracle_sign"] == 1


@pytest.mark.parametrize("centred", [True, False])
def test_crossover(spark, centred):
    x = np.random.default_rng(1).normal(100, 5, 90)
    mode = {True: lambda n: np.convolve(x, np.ones(n) / n, "same"), False: lambda n: np.convolve(x, np.ones(n) / n)[: len(x)]}[centred]
    want = np.where(mode(4) > mode(9), 1, -1)
    want[:9] = 0
    frame = closes(spark, x)
    got = frame.select("ts", T.crossover(frame, 4, 9, centred).alias("s")).orderBy("ts").collect()
    assert [x["s"] for x in got] == want.tolist()


def test_growth_of_losses_beyond_all(spark):
    size, sign = T.growth(F.col("x"))
    frame = spark.createDataFrame([(-3.0,), (0.5,), (1.0,)], "x double")
    got = frame.agg(size.alias("l"), sign.alias("s")).first()
    assert got["s"] == -1 and got["l"] == pytest.approx(math.log(6))
    assert frame.union(spark.createDataFrame([(-1.0,)], "x double")).agg(sign.alias("s")).first()["s"] == 0


def test_beat_is_since_each_start(spark):
    rows = [("a", 1, 10.0, 100.0), ("a", 2, 9.0, 95.0), ("a", 3, 12.0, 110.0), ("b", 1, 5.0, 1.0), ("b", 2, 4.0, 1.0)]
    got = {x["k"]: x for x in T.beat(spark.createDataFrame(rows, "k string, t int, v double, w double"), "k", "t", "v", "w").collect()}
    assert got["a"]["alpha"] == pytest.approx(10) and (got["a"]["first_beat"], got["a"]["rows_beating"]) == (2, 1) and got["a"]["pct_beating"] == pytest.approx(100 / 3)
    assert got["b"]["first_beat"] == -1 and got["b"]["alpha"] == pytest.approx(-20)


def test_report_drawdown_starts_at_the_first_value(spark):
    rows = [("a", i, r) for i, r in enumerate([-0.5, 0.1, -0.2, 0.3, -0.1])]
    got = E.report(spark.createDataFrame(rows, "symbol string, ts int, r double")).first()
    assert got["max_drawdown"] == pytest.approx(-0.2) and got["calmar"] == pytest.approx(-0.08 * 252 / 0.2)
    up = E.report(spark.createDataFrame([("a", i, 0.1 + i / 100) for i in range(5)], "symbol string, ts int, r double")).first()
    assert up["sortino"] == up["calmar"] == up["max_drawdown"] == 0


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 40)
    monkeypatch.setattr(R, "CHUNK", 16)


def many_ticks(spark, n=400):
    r = np.random.default_rng(4)
    rows = [("ab"[i % 2], T0 + dt.timedelta(seconds=int(i // 3)), i, float(round(100 + 30 * math.sin(i / 9) + r.normal(), 2)), float(r.integers(0, 4)), float(r.integers(-3, 4))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double, size double, signed double")


def test_sliced_scans_equal_whole_ones(spark, small_slices, monkeypatch):
    """State passes from slice to slice: range bars, zigzag, managed orders, affine recurrences."""
    ticks = many_ticks(spark)
    bars = ticks.groupBy("symbol", "ts").agg(F.max_by("price", "seq").alias("close"))
    orders = bars.select("symbol", "ts", (F.col("close").cast("int") % 5 - 2).alias("target"), F.col("close").alias("price"))
    forms = [lambda: B.range_bars(ticks, 10.0), lambda: S.waves(bars, 15.0), lambda: SS.managed(orders, 2, 100.0), lambda: R.ema(bars, "close", 9, "e"), lambda: R.affine_scan(bars.withColumn("a", F.lit(0.5)), "a", "close", "y", descending=True)]
    sliced = [sorted(map(tuple, f().collect())) for f in forms]
    monkeypatch.setattr(M, "SLICE", 10**6)
    for got, f in zip(sliced, forms, strict=True):
        want = sorted(map(tuple, f().collect()))
        assert len(got) == len(want) > 0
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_range_bars_equal_the_streams_step(spark):
    ticks = many_ticks(spark).where("symbol = 'a'").orderBy("ts", "seq").collect()
    state, want = B.RangeBarState(10.0), []
    for x in ticks:
        bar = state.step(x["ts"], x["price"], x["size"], x["signed"])
        if bar:
            want.append(bar)
    got = [tuple(x)[1:] for x in B.range_bars(many_ticks(spark), 10.0).where("symbol = 'a'").orderBy("bar_no").collect()]
    assert len(got) == len(want) > 5 and all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want, strict=True))


def test_ranged_rows_by_hand(spark, small_slices):
    """One row of 25 points ends two bars of 10 upwards; the next falls and ends one downwards."""
    rows = [("a", T0, 0, 100.0, 104.0, 100.0, 104.0, 5.0, 2.0, 3), ("a", T0 + dt.timedelta(seconds=60), 1, 104.0, 125.0, 104.0, 125.0, 7.0, -1.0, 4), ("a", T0 + dt.timedelta(seconds=90), 2, 125.0, 125.0, 104.0, 104.0, 1.0, 1.0, 1)]
    got = B.ranged_rows(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, open double, high double, low double, close double, volume double, delta double, num_trades long"), 10.0).orderBy("bar_no").collect()
    assert [(x["open"], x["high"], x["low"], x["close"], x["volume"], x["delta"], x["num_trades"], x["duration_seconds"]) for x in got] == [
        (100, 110, 100, 110, 12, 1, 7, 60),
        (110, 120, 110, 120, 1, 0, 0, 0.1),
        (120, 125, 115, 115, 1, 1, 1, 30),
        (115, 115, 105, 105, 1, 0, 0, 0.1),
    ]


def brute_machine(codes, table, start=0):
    s, out = start, []
    for c in codes:
        before = s
        s = table[c][s] if c is not None else s
        out.append((before, s))
    return out


def test_machine_scan(spark, small_slices):
    r = np.random.default_rng(7)
    table = r.integers(0, 5, (6, 5)).tolist()
    codes = {k: [None if r.random() < 0.05 else int(r.integers(0, 6)) for _ in range(n)] for k, n in (("a", 300), ("b", 1), ("c", 90))}
    rows = [(k, i, c) for k, v in codes.items() for i, c in enumerate(v)]
    got = M.machine_scan(spark.createDataFrame(rows, "symbol string, ts int, c int"), "c", table, start=2).orderBy("symbol", "ts").collect()
    want = [x for k in sorted(codes) for x in brute_machine(codes[k], table, 2)]
    assert [(x["before_state"], x["state"]) for x in got] == want


def test_slices_of_text(spark, small_slices):
    """Months as text: they sort as text, and slices follow."""
    rows = [("a", f"{2000 + i // 12}-{i % 12 + 1:02}", float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts string, x double").repartition(3)
    assert 1 < len(M.slice_cuts(df, "ts")) < 6
    got = R.affine_scan(df.withColumn("a", F.lit(0.5)), "a", "x", "y").orderBy("ts").collect()
    y, want = 0.0, []
    for _, _, x in rows:
        y = 0.5 * y + x
        want.append(y)
    assert [g["y"] for g in got] == pytest.approx(want)
