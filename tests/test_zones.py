"""Zones, rectangles and position signals against row-by-row versions, whole and in slices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import machines as M
from tickloom.operators import recurrence as R
from tickloom.operators import zones as Z

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(params=[10**6, 30])
def sliced(request, monkeypatch):
    monkeypatch.setattr(M, "SLICE", request.param)
    monkeypatch.setattr(R, "CHUNK", min(4096, request.param // 3))


def frame(spark, columns, symbols=2):
    n = len(next(iter(columns.values()))) // symbols
    rows = [("ab"[i // n], T0 + dt.timedelta(minutes=i), *[None if v[i] is None else v[i].item() for v in columns.values()]) for i in range(n * symbols)]
    kinds = {float: "double", int: "int", bool: "boolean"}
    return n, spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, " + ", ".join(f"{k} {kinds[type(v[0].item())]}" for k, v in columns.items()))


def brute_zones(v, d, s, skip, most, least):
    out, i, n = [], skip, len(v)
    while i < n:
        for kind, starts, on in (("absorption", v[i] >= 1.5 and abs(d[i]) < 0.2, lambda x: x >= 1.5 * 0.6), ("vacuum", v[i] <= 0.6 and s[i] > 1.1, lambda x: x <= 0.6 * 1.3)):
            if starts:
                j = i + 1
                while j < n and j - i < most and on(v[j]):
                    j += 1
                if j - i >= least:
                    out.append((i, j - 1, kind))
                    i = j - 1
                    break
        i += 1
    return out


@pytest.mark.parametrize(("most", "least"), [(4, 2), (40, 1)])
def test_zones(spark, sliced, most, least):
    r = np.random.default_rng(3)
    x = {"vol_ratio": np.abs(r.normal(0.9, 0.6, 240)).round(2), "delta_pct": r.normal(0, 0.2, 240), "speed_ratio": r.uniform(0.5, 2, 240), "open": r.normal(0, 1, 240), "close": r.normal(0, 1, 240), "high": r.normal(5, 1, 240), "low": r.normal(-5, 1, 240), "volume": r.uniform(1, 9, 240), "delta": r.normal(0, 3, 240)}
    n, df = frame(spark, x)
    got = sorted((z["symbol"], z["start"], z["stop"], z["kind"], z["side"], round(z["price_high"], 6), round(z["strength"], 6)) for z in Z.zones(df, skip=5, most=most, least=least).collect())
    want = []
    for k, s in enumerate("ab"):
        part = {c: v[k * n : (k + 1) * n] for c, v in x.items()}
        for i, j, kind in brute_zones(part["vol_ratio"], part["delta_pct"], part["speed_ratio"], 5, most, least):
            cut = slice(i, j + 1)
            way, ratio = np.where(part["close"][cut] >= part["open"][cut], 1, -1).mean(), part["vol_ratio"][cut].mean()
            side = (1 if way < 0 else -1) if kind == "absorption" else 1 if way > 0 else -1
            want.append((s, i, j, kind, side, round(part["high"][cut].max() + (1 if kind == "absorption" else 0), 6), round(min(1, ratio / 3 if kind == "absorption" else 1 - ratio), 6)))
    assert got == want and len(want) > 10


def brute_boxes(f, most):
    out, start, n = [], None, len(f)
    for i in range(n):
        if start is None:
            if f[i]:
                start = i
        elif not f[i] or i - start >= most:
            if not f[i] and i + 1 < n and f[i + 1] and i - start < most:
                continue
            out.append((start, i - 1 if not f[i] else i))
            start = None
    return out + ([(start, n - 1)] if start is not None else [])


@pytest.mark.parametrize("most", [3, 25])
def test_boxes(spark, sliced, most):
    r = np.random.default_rng(5)
    x = {"f": np.concatenate([r.random(100) < 0.6, np.ones(40, bool), r.random(60) < 0.3])}
    n, df = frame(spark, x)
    got = Z.boxed(df, "f", most).where("box_start IS NOT NULL").groupBy("symbol", "box_start").agg(F.max("_i").alias("stop")).collect()
    assert sorted(map(tuple, got)) == [(s, *b) for k, s in enumerate("ab") for b in brute_boxes(x["f"][k * n : (k + 1) * n], most)]


def brute_signals(x, cooldown, confirm):
    s, since, out = 0, 0, []
    for i in range(len(x["phase"])):
        since += 1
        recent = x["effort"][max(0, i - 2) : i + 1]
        green, purple = (recent > 0).sum(), (recent < 0).sum()
        sp, ut, sc, bc, p, to = x["spring"][i], x["upthrust"][i], x["selling_climax"][i], x["buying_climax"][i], x["phase"][i], s
        if since >= cooldown:
            if s == 0:
                if (sp or sc) and green >= confirm and p in (0, 1):
                    to = 1
                elif (ut or bc) and purple >= confirm and p in (0, 3):
                    to = -1
            elif s == 1:
                to = -1 if ut else 0 if bc or (p == 3 and purple >= confirm) or purple >= 3 else 1
            else:
                to = 1 if sp else 0 if sc or (p == 1 and green >= confirm) or green >= 3 else -1
        if to != s:
            s, since = to, 0
        out.append(s)
    return out


@pytest.mark.parametrize(("cooldown", "confirm"), [(5, 2), (1, 1)])
def test_position_signals(spark, sliced, cooldown, confirm):
    r = np.random.default_rng(11)
    x = {c: (r.random(400) < 0.15).astype(int) for c in ("spring", "selling_climax", "upthrust", "buying_climax")} | {"phase": r.integers(0, 5, 400), "effort": r.normal(0, 1, 400).round(0)}
    n, df = frame(spark, x)
    got = Z.position_signals(df, cooldown=cooldown, confirm=confirm).orderBy("symbol", "ts").collect()
    want = [s for k in range(2) for s in brute_signals({c: v[k * n : (k + 1) * n] for c, v in x.items()}, cooldown, confirm)]
    assert [g["signal"] for g in got] == want and {1, -1, 0} == set(want)
    changed = [g["cause"] is not None for g in got if g["symbol"] == "a"]
    assert changed == [a != b for a, b in zip(want[:n], [0, *want[: n - 1]], strict=True)]


def test_signals_of_null_flags(spark):
    rows = [("a", T0 + dt.timedelta(minutes=i), None, None, None, None, None, None) for i in range(8)]
    got = Z.position_signals(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, spring int, selling_climax int, upthrust int, buying_climax int, phase int, effort double")).collect()
    assert {g["signal"] for g in got} == {0}


def test_expanding_means(spark, sliced):
    x = np.random.default_rng(1).uniform(1, 5, 100)
    n, df = frame(spark, {"x": x}, 1)
    got = [r["y"] for r in Z.headed_emas(df, [("x", 10, "y")], "expanding").orderBy("ts").collect()]
    want = [x[: i + 1].mean() for i in range(10)]
    for v in x[10:]:
        want.append(v * 2 / 11 + want[-1] * 9 / 11)
    assert got == pytest.approx(want)
