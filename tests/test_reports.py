"""Waves by hand, evaluation goldens, file sources and sinks, session streams."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalar
from tickloom.operators import evaluation, recurrence, reports, waves
from tickloom.plans import registry
from tickloom.sources import files
from tickloom.streaming import sessions

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def bars_of(spark, closes, volumes=None, deltas=None):
    n = len(closes)
    rows = [("A", START + dt.timedelta(hours=i), c, c + 1.0, c - 1.0, c, float((volumes or [1.0] * n)[i]), (deltas or [0.0] * n)[i]) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, delta double")


def test_waves_by_hand(spark):
    """Waves (0, 5, 20), (8, 2), (15, 30), (12) with reversals of 10."""
    b = bars_of(spark, [0, 5, 20, 8, 2, 15, 30, 12], [1.0, 2, 3, 4, 5, 6, 7, 8], [1.0] * 8)
    got = {r["ts"].hour: r for r in waves.wave_features(b, 10.0).collect()}
    assert [got[i]["wave"] for i in range(8)] == [0, 0, 0, 1, 1, 2, 2, 3]
    assert [got[i]["wave_direction"] for i in (2, 4, 6, 7)] == [1, -1, 1, -1]
    r = got[6]
    want = {"wave_progress": 0.1, "wave_vol_vs_same": 13 / 6, "wave_vol_vs_prev": 13 / 9, "wave_disp_vs_same": 15 / 20, "wave_disp_vs_prev": 15 / 6, "wave_er_vs_same": (13 / 15) / (6 / 20), "wave_er_vs_prev": (13 / 15) / (9 / 6), "wave_delta_ratio": 2 / 13, "wave_delta_vs_same": 2 / 13 - 3 / 6, "yellow_bar": 1.0, "large_wave_score": 1.0, "demand_score_3wave": 1.0}
    assert {k: r[k] for k in want} == pytest.approx(want)
    assert got[0]["yellow_bar"] == 0.0 and got[3]["wave_vol_vs_prev"] == pytest.approx(4 / 6) and got[3]["wave_vol_vs_same"] == 1.0


def test_wave_scores_of_many_waves(spark):
    """Eight completed waves of rising volume: the trends are those of the last four a side."""
    b = bars_of(spark, [0, 20, 0, 20, 0, 20, 0, 20, 0, 20], [float(v) for v in range(1, 11)])
    r = waves.wave_features(b, 10.0).orderBy(F.desc("ts")).first()
    # Waves: 0 has volumes 1 + 2; then 3, 4, ..., 9, and the running one 10 (direction up).
    assert r["wave"] == 8 and r["wave_direction"] == 1
    assert r["demand_score_3wave"] == pytest.approx((8 + 6 + 4) / (9 + 7 + 5))
    assert r["wave_vol_trend_down"] == pytest.approx(math.tanh(2 / 6), abs=1e-7)
    assert r["wave_vol_trend_up"] == pytest.approx(math.tanh((1.5 * 8 + 0.5 * 6 - 0.5 * 4 - 1.5 * 3) / 5 / 5.25), abs=1e-7)
    assert r["large_wave_score"] == pytest.approx(10 / ((9 + 8 + 7 + 6) / 4))


def test_all_features_are_58(spark):
    b = bars_of(spark, [0, 20, 5]).withColumn("duration_seconds", F.lit(60.0))
    got = waves.all_features(b, 10.0)
    assert len(got.columns) == 3 + 58 and len(set(got.columns)) == 61
    assert all(v is not None and math.isfinite(v) for r in got.collect() for v in r[2:])
    assert waves.all_features(b.limit(0), 10.0).count() == 0


def test_probabilities(spark):
    row = spark.range(1).select(*[scalar.normal_cdf(F.lit(z)).alias(str(z)) for z in (-3.0, 0.0, 1.6448536269514722, 7.9)]).first()
    assert list(row) == pytest.approx([0.0013498980316300933, 0.5, 0.95, 1.0], abs=1e-12)
    psr = scalar.psr_of(F.lit(1.585 / 12**0.5), F.lit(24), F.lit(-2.448), F.lit(10.164))
    dsr = scalar.psr_of(F.lit(2.5 / 250**0.5), F.lit(1250), F.lit(-3.0), F.lit(10.0), math.sqrt(0.5 / 250) * scalar.expected_max(100))
    a, b, c = spark.range(1).select(psr, dsr, scalar.psr_of(F.lit(1.0), F.lit(9), F.lit(9.0), F.lit(3.0), 0.0, 0.5)).first()
    assert (a, b, c) == pytest.approx((0.91323430688486018, 0.90039683444939034, 0.5))
    assert scalar.expected_max_small(1) == 0.0 and scalar.expected_max_small(3) == pytest.approx(0.6744897501960817)


def test_nulls_stay_null(spark):
    x = spark.createDataFrame([(None,), (3.0,)], "x double").select(scalar.clip(F.col("x"), -1.0, 1.0).alias("c"), scalar.normal_cdf(F.col("x")).alias("p")).collect()
    assert tuple(x[0]) == (None, None) and x[1]["c"] == 1.0


def test_deflated_variants(spark):
    rows = [(s, float(x)) for s, xs in {"a": (0.1, 0.2, 0.0, 0.3), "b": (0.1, -0.2, 0.1, 0.1), "c": (0.1, 0.2, 0.0, 0.3)}.items() for x in xs]
    df = spark.createDataFrame(rows, "symbol string, r double")
    for variant in ("trials", "runner", "approx"):
        r = evaluation.deflated(df, variant).first()
        assert r["best"] == "a" and r["n"] == 3 and 0 <= r["dsr"] <= 1
    assert evaluation.screened(df.union(spark.createDataFrame([("d", 1.0), ("d", 1.0)], df.schema))).where("symbol = 'd'").count() == 0


def test_overfitting_summary(spark):
    rows = [(1.0, 0.5, -1.0), (2.0, -0.5, 1.0), (3.0, -1.5, -2.0), (4.0, -2.5, -0.5)]
    r = evaluation.overfitting(spark.createDataFrame(rows, "is_sr double, oos_sr double, logit double")).first()
    assert (r["pbo"], r["slope"], r["intercept"], r["p_below"], r["band"]) == pytest.approx((0.75, -1.0, 1.5, 0.75, 3))


def test_recurrence_keeps_callers_columns(spark):
    df = spark.createDataFrame([("A", i, 1.0, 10.0 + i, 20.0 + i) for i in range(5)], "symbol string, ts int, x double, _c double, _n double")
    got = recurrence.ema(df, "x", 3, "y").orderBy("ts").collect()
    assert [(r["_c"], r["_n"], r["y"]) for r in got] == [(10.0 + i, 20.0 + i, 1.0) for i in range(5)]


def test_turbulence_over_blocks(spark):
    """Three assets, one of them unknown at first, against a plain computation row by row."""
    rng, n = np.random.default_rng(3), 7
    p = np.exp(np.cumsum(rng.normal(0, 0.02, (40, 3)), axis=0))
    p[:12, 2] = np.nan
    df = spark.createDataFrame([(START + dt.timedelta(days=i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(p)], "ts timestamp, a double, b double, c double")
    got = [r["turbulence"] for r in evaluation.turbulence(df, ["a", "b", "c"], n).orderBy("ts").collect()]
    moves, want, seen = np.vstack([np.full((1, 3), np.nan), p[1:] / p[:-1] - 1]), [], 0
    for i in range(40):
        value = 0.0
        if i >= n:
            past = moves[i - n : i]
            past = past[np.isnan(past).sum(axis=0).min() :]
            ok = ~np.isnan(past).any(axis=0)
            away = moves[i, ok] - past[:, ok].mean(axis=0)
            value = max(0.0, float(away @ np.linalg.pinv(np.cov(past[:, ok], rowvar=False)) @ away))
            seen += value > 0
        want.append(value if seen > 2 else 0.0)
    assert got == pytest.approx(want)


def test_gumbel_draws(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("g"), "id", F.when(F.col("id") < 1500, 3.0).when(F.col("id") < 2990, 1.0).otherwise(0.0).alias("w"))
    got = reports.gumbel_top(df, "w", 2, "id", key=["g"])
    assert got.count() == 600 and got.where("w = 0").count() == 0 and got.distinct().count() == 600
    share = got.where("w = 3").count() / 600
    assert 0.62 < share < 0.82
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reports.gumbel_top(df.repartition(7), "w", 2, "id", key=["g"]).collect()))
    assert reports.gumbel_top(df, "w", 5, "id").count() == 5


def test_padding(spark):
    r = spark.createDataFrame([([1.0, 2.0], [])], "a array<double>, b array<double>").select(reports.padded(F.col("a"), F.lit(4)), reports.padded(F.col("a"), F.lit(1)), reports.padded(F.col("b"), F.lit(2))).first()
    assert list(r) == [[1.0, 2.0, 2.0, 2.0], [1.0, 2.0], []]


def test_arrays(spark, tmp_path):
    np.savez_compressed(tmp_path / "x.npz", close=np.arange(6.0).reshape(3, 2), flag=np.array([True, False]), names=np.array(["a", "b"]), odd=np.array([{}], dtype=object))
    np.save(tmp_path / "y.npy", np.float32([1.5, -2]))
    got = sorted((r["file"][-5:], r["name"], r["i"], r["j"], r["value"]) for r in files.arrays(spark, str(tmp_path)).collect())
    assert got == [("x.npz", "close", i, j, float(2 * i + j)) for i in range(3) for j in range(2)] + [("x.npz", "flag", 0, 0, 1.0), ("x.npz", "flag", 1, 0, 0.0), ("y.npy", "", 0, 0, 1.5), ("y.npy", "", 1, 0, -2.0)]


def test_catalogue_and_tables(spark, tmp_path):
    for split, names in {"split_0": ["actor__000100_12.5.pt", "actor__200_-3.pt", "actor__300.pt", "act.pth", "actor__x.pt"], "split_1": ["act.pth"]}.items():
        (tmp_path / split).mkdir()
        for n in names:
            (tmp_path / split / n).write_text("x")
        (tmp_path / split / "results.csv").write_text("step,sharpe\n1,0.5\n2,\n")
    got = sorted((r["folder"], r["step"], r["score"]) for r in files.catalogue(spark, str(tmp_path)).collect())
    assert got == [("split_0", 100, 12.5), ("split_0", 200, -3.0), ("split_0", 300, None), ("split_0", 301, None), ("split_1", 1, None)]
    t = files.result_tables(spark, f"{tmp_path}/*/results.csv", "step int, sharpe double")
    assert sorted((r["split"], r["step"], r["sharpe"]) for r in t.collect()) == [(0, 1, 0.5), (0, 2, None), (1, 1, 0.5), (1, 2, None)]
    (tmp_path / "m.json").write_text(json.dumps({"n": 3, "paths": [1, 2]}, indent=1))
    assert files.metadata(spark, str(tmp_path / "m.json")).first()["paths"] == [1, 2]


def test_text_formats(spark, tmp_path):
    (tmp_path / "k.txt").write_text("2 50\n10 60\n20 100\n")
    (tmp_path / "c.txt").write_text("5 2\n1 2 3\n\n4 5\n")
    assert sorted(r[1:] for r in map(tuple, files.knapsack(spark, str(tmp_path / "k.txt")).collect())) == [(50, 0, 10, 60), (50, 1, 20, 100)]
    assert sorted((r["total"], r["items"]) for r in files.covers(spark, str(tmp_path / "c.txt")).collect()) == [(5, [1, 2, 3]), (5, [4, 5])]
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, -1.0)], "src long, dst long, w double")
    files.write_edges(edges, str(tmp_path / "g"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))).split("\n")
    assert lines[0] == "3 2" and sorted(lines[1:]) == ["", "1 2 3", "2 3 -1"]
    pages = spark.createDataFrame([(1, "<table><tr><th>a<th> b </tr><tr><td>1&amp;<b>2</b></td></tr></table><table><tr><td>x"), (2, None), (3, "no")], "id long, html string")
    assert sorted(map(tuple, files.html_rows(pages, "id", "html").collect())) == [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["1&2"]), (1, 1, 2, ["x"])]
    history = spark.range(10).withColumnRenamed("id", "step")
    assert sorted(r["step"] for r in files.ring(history, 3).collect()) == [7, 8, 9]


def test_bit_codec(spark):
    """Against whole-number arithmetic, with lengths about the borders of digits and lines."""
    rng = np.random.default_rng(1)
    texts = ["", "0", "1", "000001", "0000001", *["".join(map(str, rng.integers(0, 2, n))) for n in (64, 384, 385, 390, 720, 721, 1500)], "0" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "bits string").withColumn("text", files.encode_bits(F.col("bits")))
    for bits, text, back in df.withColumn("back", files.decode_bits(F.col("text"), F.length("bits"))).collect():
        assert back == bits
        n, value = -(-len(bits) // 6), int(bits or "0", 2)
        digits = "".join(files.DIGITS[value >> 6 * k & 63] for k in reversed(range(n)))
        lines = "\n".join(digits[i : i + 120] for i in range(0, len(digits), 120))
        assert text == ("\n" + lines if n > 64 else lines)


def streamed(spark, tmp_path, df, f, name):
    """A stream of four files, in time order, one a micro-batch."""
    rows = df.orderBy("ts").toPandas()
    for k in range(4):
        part = rows.iloc[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = f(s).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(str, spark.table(name).collect()))


@pytest.mark.parametrize("name", ["windows", "session_sum", "managed"])
def test_session_streams_equal_batch(spark, tmp_path, name):
    b = registry.hourly_signed(spark, SF).select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"), F.col("delta").cast("double").alias("delta"))
    o = b.select("symbol", "ts", F.signum("delta").alias("target"), F.col("close").alias("price"))
    source, batch, stream = {
        "windows": (b, lambda d: sessions.windows(d, 6, 3), lambda d: sessions.stream_windows(d, 6, 3)),
        "session_sum": (b, sessions.session_sum, sessions.stream_session_sum),
        "managed": (o, lambda d: sessions.managed(d, 1, 800.0), lambda d: sessions.stream_managed(d, 1, 800.0)),
    }[name]
    want = sorted(map(str, batch(source).collect()))
    assert len(want) > 100 and streamed(spark, tmp_path, source, stream, f"s_{name}") == want


def test_halt_lasts_for_the_day(spark):
    at = [START + dt.timedelta(hours=h) for h in (0, 1, 2, 3, 24, 25)]
    rows = [("A", t, x, p) for t, x, p in zip(at, (1, 0, 1, 0, 3, 0), (100.0, 90.0, 50.0, 60.0, 10.0, 12.0), strict=True)]
    got = sessions.managed(spark.createDataFrame(rows, "symbol string, ts timestamp, target int, price double"), 1, 150.0).orderBy("ts").collect()
    assert [(r["position"], r["realised"], r["halted"]) for r in got] == [(1, 0.0, False), (0, -210.0, True), (0, 0.0, True), (0, 0.0, True), (1, 0.0, False), (0, 30.0, False)]


def test_scores_wait_for_six_waves(spark):
    """Five completed waves: one side has three, the other two, so that both scores are 1."""
    r = waves.wave_features(bars_of(spark, [0, 20, 0, 20, 0, 20, 0]), 10.0).orderBy(F.desc("ts")).collect()
    assert [x["wave"] for x in r[:2]] == [5, 4]
    assert (r[0]["demand_score_3wave"], r[0]["supply_score_3wave"], r[0]["large_wave_score"], r[1]["large_wave_score"]) == (1.0, 1.0, 1.0, pytest.approx(1 / 1.25))


def test_tick_slices(spark, tmp_path):
    """A slice by time, in batch and replayed in small micro-batches; times without a scan."""
    from tickloom.sources.scid import EPOCH, RECORD, ScidDataSource, span

    r = np.zeros(500, RECORD)
    at = np.arange(500) // 2 * 1_000_000  # two records a second
    r["time"], r["close"], r["volume"] = at + 1_704_067_200_000_000 + EPOCH, np.arange(500), 1
    path = str(tmp_path / "NQ.scid")
    with open(path, "wb") as f:
        f.write(b"SCID" + np.array([56, RECORD.itemsize], "<u4").tobytes() + np.array([1], "<u2").tobytes() + bytes(42) + r.tobytes())
    spark.dataSource.register(ScidDataSource)
    utc = dt.timezone.utc
    assert span(path) == (dt.datetime(2024, 1, 1, tzinfo=utc), dt.datetime(2024, 1, 1, 0, 4, 9, tzinfo=utc))
    cut = {"from": "2024-01-01T00:00:10", "to": "2024-01-01T00:01:40"}
    got = spark.read.format("scid").options(**cut, partitionRecords=50).load(path)
    assert [x["seq"] for x in got.orderBy("seq").collect()] == list(range(20, 200))
    assert spark.read.format("scid").options(**{"from": "2025-01-01"}).load(path).count() == 0
    assert spark.read.format("scid").options(**cut, tail=5).load(path).agg(F.min("seq")).first()[0] == 195
    stream = spark.readStream.format("scid").options(**cut, maxRecords=70).load(path)
    q = stream.writeStream.format("memory").queryName("slice").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x["seq"] for x in spark.table("slice").collect()) == list(range(20, 200))
    found = files.tick_files(spark, str(tmp_path), "nq").first()
    assert found["exact"] and found["length"] == 56 + 500 * RECORD.itemsize
    assert files.load_bars(spark, path, "NQ", points=40.0).count() > 5 and files.load_bars(spark, path, "NQ", every="1 minute").count() == 5


def test_moving_average_kinds(spark):
    """All kinds keep a constant column constant once they are warm."""
    from tickloom.operators import features

    b = bars_of(spark, [7] * 40)
    for kind in features.AVERAGES:
        got = features.moving_average(b, kind, "close", 5, "y").orderBy(F.desc("ts")).limit(20).collect()
        assert [r["y"] for r in got] == pytest.approx([7.0] * 20), kind
    with pytest.raises(ValueError):
        features.moving_average(b, "other", "close", 5, "y")


def test_all_features_equal_their_blocks(spark):
    b = registry.hourly_signed(spark, SF).withColumn("duration_seconds", F.col("num_trades") * 60.0)
    whole = waves.all_features(b, 100.0).orderBy("symbol", "ts").toPandas()
    waved = waves.wave_features(b, 100.0)
    for names, block in ((waves.WAVE, waved), (waves.EVENT, waves.event_scores(waved)), (waves.CONTEXT, waves.context(waved)), (waves.MICRO, waves.microstructure(b))):
        part = block.select("symbol", "ts", *names).orderBy("symbol", "ts").toPandas()
        assert len(part) == len(whole) > 100
        np.testing.assert_allclose(whole[names].to_numpy(), part[names].to_numpy(float), rtol=1e-6, atol=1e-6)
