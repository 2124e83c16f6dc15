"""Stock indicators against pandas, trades by profits against the row-by-row rule."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import indicators as N
from tickloom.operators import machines as M
from tickloom.operators import recurrence as R
from tickloom.operators import windows as W


@pytest.mark.parametrize("rows", [10**6, 40])
def test_indicators(spark, monkeypatch, rows):
    monkeypatch.setattr(M, "SLICE", rows)
    monkeypatch.setattr(R, "CHUNK", 16)
    r = np.random.default_rng(9)
    c = 50 + r.normal(0, 1, 120).cumsum()
    x = pd.DataFrame({"symbol": "a", "ts": [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)], "high": c + r.uniform(0, 2, 120), "low": c - r.uniform(0, 2, 120), "close": c})
    got = N.indicators(spark.createDataFrame(x)).orderBy("ts").toPandas()
    mean = lambda s, n: s.ewm(alpha=1 / n, adjust=True).mean()
    change = x.close.diff().fillna(0)
    rs = mean(change.clip(lower=0), 30) / mean(-change.clip(upper=0), 30)
    up, down = x.high.diff().fillna(0), -x.low.diff().fillna(0)
    true = pd.concat([x.high - x.low, (x.high - x.close.shift()).abs(), (x.low - x.close.shift()).abs()], axis=1).max(axis=1)
    plus, minus = (mean(a.where((a > b) & (a > 0), 0), 30) / mean(true, 30) for a, b in ((up, down), (down, up)))
    tp = (x.high + x.low + x.close) / 3
    off = tp.rolling(30, min_periods=1).apply(lambda v: np.abs(v - v.mean()).mean())
    want = {
        "macd": x.close.ewm(span=12, adjust=True).mean() - x.close.ewm(span=26, adjust=True).mean(),
        "boll_ub": x.close.rolling(20, min_periods=1).mean() + 2 * x.close.rolling(20, min_periods=1).std(),
        "rsi_30": 100 - 100 / (1 + rs),
        "dx_30": (plus - minus).abs() / (plus + minus) * 100,
        "cci_30": (tp - tp.rolling(30, min_periods=1).mean()) / (0.015 * off),
        "close_60_sma": x.close.rolling(60, min_periods=1).mean(),
    }
    for name, series in want.items():
        assert got[name].to_numpy()[5:] == pytest.approx(series.to_numpy()[5:]), name


def test_deviation_about(spark):
    rows = [("a", dt.datetime(2024, 1, 1 + i), float(x), m) for i, (x, m) in enumerate([(1, None), (5, 2.0), (7, 3.0), (4, None)])]
    got = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, m double").select("ts", N.deviation_about(W.F.col("x"), W.F.col("m"), 3).alias("d")).orderBy("ts").collect()
    assert [g["d"] for g in got] == pytest.approx([None, None, 0.5 + 1e-10, 0.5 + 1e-10])


def brute_trades(events):
    out, entry = [], None
    for bar, action, change, price, pnl, before in events:
        if entry is None:
            entry = (bar, action, price)
        elif pnl != 0:
            out.append((entry[0], bar, "LONG" if entry[1] == "BUY" else "SHORT", entry[2], price, pnl, bar - entry[0]))
            entry = (bar, action, price) if before + change != 0 else None
        else:
            entry = (bar, action, price)
    return out


def test_entry_exits(spark):
    r = random.Random(2)
    rows = {k: [(i, r.choice(["BUY", "SELL"]), r.choice([-1, 0, 1]), float(i), float(r.choice([0, 0, 3, -2])), r.choice([0, 1])) for i in range(n)] for k, n in (("a", 300), ("b", 1), ("c", 9))}
    df = spark.createDataFrame([(k, *e) for k, v in rows.items() for e in v], "symbol string, bar long, action string, change int, price double, pnl double, before int")
    got = sorted(map(tuple, N.entry_exits(df).collect()))
    assert got == [(k, *t) for k in sorted(rows) for t in brute_trades(rows[k])] and len(got) > 50
