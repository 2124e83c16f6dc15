"""Registered queries of effort metrics, zones, rectangles and position signals. The SQL runs
the row-by-row rules as recursive tables, not as machines or run lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import evaluation as E
from tickloom.operators import features as X
from tickloom.operators import windows as W
from tickloom.operators import zones as Z

from .analytics import fit, frame, mean
from .registry import EFFORT, SBARS, O, hourly_signed, out, query

EMAS = {"vol_ema": ("v", 20), "delta_ema": ("ad", 14), "delta_pct_ema": ("delta_pct", 14), "speed_ema": ("speed", 14), "price_ema": ("close", 20)}
LATER = {"effort_ema": ("effort_index", 20), "absorption_ema": ("absorption_score", 20)}


def means(name: str, of: str, series: dict, head: bool) -> str:
    """Recursive table of exponential means that start from the mean of the first n rows."""
    step = lambda k, y: f"CASE WHEN a.i <= {series[k][1]} THEN a.m_{k} ELSE a.{series[k][0]} * (2::DOUBLE / {series[k][1] + 1}) + (1 - 2::DOUBLE / {series[k][1] + 1}) * {y} END AS {k}"
    seeds = ", ".join(f"avg({x}) OVER {frame(n)} AS m_{k}" for k, (x, n) in series.items())
    shown = ", ".join(f"CASE WHEN i >= {1 if head else n} THEN y.{k} END AS {k}" for k, (_, n) in series.items())
    return f"""{name}_a AS MATERIALIZED (SELECT *, {seeds} FROM {of}),
    {name}_y AS (SELECT symbol, i, {", ".join(f"m_{k} AS {k}" for k in series)} FROM {name}_a WHERE i = 1
      UNION ALL SELECT a.symbol, a.i, {", ".join(step(k, f"y.{k}") for k in series)} FROM {name}_y y JOIN {name}_a a ON a.symbol = y.symbol AND a.i = y.i + 1),
    {name} AS MATERIALIZED (SELECT a.*, {shown.replace("WHEN i", "WHEN a.i")} FROM {name}_a a JOIN {name}_y y ON a.symbol = y.symbol AND a.i = y.i)"""


def placed(x: str, head: bool) -> str:
    flat = f"CASE WHEN max({x}) OVER {frame(100)} - min({x}) OVER {frame(100)} > 1e-10 THEN ({x} - min({x}) OVER {frame(100)}) / (max({x}) OVER {frame(100)} - min({x}) OVER {frame(100)}) ELSE 0.5 END"
    return flat if head else f"CASE WHEN i < 100 THEN 0 ELSE {flat} END"


def metrics(head: bool) -> str:
    return f"""{SBARS}, mi AS (SELECT *, volume::DOUBLE AS v, abs(delta)::DOUBLE AS ad, CASE WHEN volume > 0 THEN delta / volume ELSE 0 END::DOUBLE AS delta_pct,
      1 / (num_trades * 60.0::DOUBLE) AS speed, row_number() OVER {O} AS i FROM bars),
    {means("me", "mi", EMAS, head)},
    mr AS (SELECT *, CASE WHEN vol_ema > 0 THEN v / vol_ema ELSE 1 END AS vol_ratio, CASE WHEN speed_ema > 0 THEN speed / speed_ema ELSE 1 END AS speed_ratio FROM me),
    md AS (SELECT *, CASE WHEN ad > 0 THEN vol_ratio / (abs(delta_pct) + 0.01) ELSE 0 END AS delta_divergence,
      vol_ratio * (1 - abs(delta_pct)) * CASE WHEN speed_ratio > 0 THEN 1 / (speed_ratio + 0.1) ELSE 1 END AS absorption_score FROM mr),
    mx AS (SELECT *, 0.5 * {placed("vol_ratio", head)} + 0.25 * {placed("delta_divergence", head)} + 0.25 * {placed("speed_ratio", head)} AS effort_index FROM md),
    {means("mf", "mx", LATER, head)},
    mm AS MATERIALIZED (SELECT *, effort_ema + 1.5 * sd AS effort_upper, effort_ema - 1.5 * sd AS effort_lower
      FROM (SELECT *, CASE WHEN i >= {1 if head else 20} THEN stddev_pop(effort_index) OVER {frame(20)} END AS sd FROM mf))"""


def measured(spark, sf, head="strict"):
    b = hourly_signed(spark, sf).withColumn("duration_seconds", F.col("num_trades") * 60.0)
    return Z.effort_metrics(b, head=head)


def listed(head: bool) -> str:
    return f"WITH RECURSIVE {metrics(head)} SELECT symbol, ts, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in Z.METRICS)} FROM mm"


def shown(df):
    return df.select("symbol", "ts", *[(F.round(c, 5) + 0.0).alias(c) for c in Z.METRICS])


@query("effort_metrics", listed(False))
def effort_metrics(spark, sf):
    return shown(measured(spark, sf))


@query("effort_metrics_expanding", listed(True))
def effort_metrics_expanding(spark, sf):
    return shown(measured(spark, sf, "expanding"))


# One row at a time: a zone that has started (z) goes on (g counts its rows) or the row may start one.
ZONES = f"""{metrics(False)}, zi AS MATERIALIZED (SELECT *, i - 1 AS k, CASE WHEN close >= open THEN 1 ELSE -1 END AS way FROM mm),
 zl AS (SELECT *, vol_ratio >= 1.5 AND abs(delta_pct) < 0.2 AS heavy, vol_ratio <= 0.6 AND speed_ratio > 1.1 AS light,
   lead(vol_ratio, 1, 1.1) OVER {O} >= 1.5 * 0.6 AND k < count(*) OVER (PARTITION BY symbol) - 1 AS on_heavy,
   lead(vol_ratio, 1, 1.1) OVER {O} <= 0.6 * 1.3 AS on_light, vol_ratio >= 1.5 * 0.6 AS goes_heavy, vol_ratio <= 0.6 * 1.3 AS goes_light FROM zi),
 zs AS (SELECT *, CASE WHEN k < 20 THEN '' WHEN heavy AND on_heavy THEN 'absorption' WHEN light AND on_light THEN 'vacuum' ELSE '' END AS opens FROM zl),
 zm AS MATERIALIZED (SELECT * FROM zs),
 zr AS (SELECT symbol, k, opens AS kind, CASE WHEN opens <> '' THEN k END AS start FROM zm WHERE k = 0
   UNION ALL SELECT m.symbol, m.k, CASE WHEN goes THEN r.kind ELSE m.opens END, CASE WHEN goes THEN r.start WHEN m.opens <> '' THEN m.k END
   FROM (SELECT r.symbol, r.k, r.kind, r.start, r.kind <> '' AND r.k + 1 - r.start < 40 AND CASE r.kind WHEN 'absorption' THEN x.goes_heavy ELSE x.goes_light END AS goes
     FROM zr r JOIN zm x ON x.symbol = r.symbol AND x.k = r.k + 1) r JOIN zm m ON m.symbol = r.symbol AND m.k = r.k + 1),
 zz AS (SELECT i.*, r.kind, r.start FROM zi i JOIN zr r ON r.symbol = i.symbol AND r.k = i.k WHERE r.start IS NOT NULL),
 za AS (SELECT symbol, start, kind, max(k) AS stop, max(high) AS h, min(low) AS l, avg(way) AS w, avg(vol_ratio) AS r, sum(volume)::DOUBLE AS volume, avg(delta) AS delta FROM zz GROUP BY ALL),
 zones AS (SELECT symbol, start::INT AS start, stop::INT AS stop, kind, CASE WHEN kind = 'absorption' THEN CASE WHEN w < 0 THEN 1 ELSE -1 END WHEN w > 0 THEN 1 ELSE -1 END::INT AS side,
   h + CASE kind WHEN 'absorption' THEN 1 ELSE 0 END AS price_high, l - CASE kind WHEN 'absorption' THEN 1 ELSE 0 END AS price_low,
   least(1, CASE kind WHEN 'absorption' THEN r / 3 ELSE 1 - r END) AS strength, volume, delta FROM za)"""


@query("effort_zones", f"WITH RECURSIVE {ZONES} SELECT symbol, start, stop, kind, side, price_high, price_low, round(strength, 5) AS strength, volume, round(delta, 5) AS delta FROM zones")
def effort_zones(spark, sf):
    got = Z.zones(measured(spark, sf))
    return out(got, *got.columns, digits=5)


@query(
    "zone_signals",
    f"""WITH RECURSIVE {ZONES}, g AS (SELECT z.*, n.side, n.strength, row_number() OVER (PARTITION BY z.symbol, z.start ORDER BY z.k) AS q FROM zz z JOIN zones n ON n.symbol = z.symbol AND n.start = z.start
      WHERE CASE WHEN n.side = 1 THEN z.delta_pct > z.delta_pct_ema AND (z.price_ema IS NULL OR z.close >= z.price_ema) ELSE z.delta_pct < z.delta_pct_ema AND (z.price_ema IS NULL OR z.close <= z.price_ema) END)
    SELECT symbol, ts, close, start::INT AS start, side AS signal, round(strength, 5) AS strength FROM g WHERE q = 1""",
)
def zone_signals(spark, sf):
    got = Z.zone_signals(measured(spark, sf))
    return out(got, *got.columns, digits=5)


# Bars with absorption, swing events over five rows, phase over thirty, effort and quality.
W5 = frame(5)
STATE = f"""{EFFORT}, sa AS (SELECT *, (volume / av >= 1.5 AND er_ratio <= 0.5)::INT AS absorption, row_number() OVER {O} AS i, sum(delta) OVER {O}::DOUBLE AS c FROM r),
 sb AS (SELECT *, CASE WHEN absorption = 1 THEN sign(delta) ELSE 0 END::INT AS side, min(low) OVER {W5} AS lo0, max(high) OVER {W5} AS hi0, avg(volume) OVER {W5} AS v5, lag(close) OVER {O} AS pc FROM sa),
 sc AS (SELECT *, lag(lo0) OVER {O} AS lo, lag(hi0) OVER {O} AS hi, i > 6 AND high > low AS ok, volume >= v5 * 1.2 AS big FROM sb),
 sd AS (SELECT *, coalesce(ok AND low < lo AND close > lo AND delta > 0, false) AS spring, coalesce(ok AND high > hi AND close < hi AND delta < 0, false) AS upthrust,
   coalesce(ok AND big AND close < pc AND (close - low) / (high - low) < 0.5 AND delta > 0, false) AS selling, coalesce(ok AND big AND close > pc AND (high - close) / (high - low) < 0.5 AND delta < 0, false) AS buying FROM sc),
 sp AS (SELECT *, round({fit("close", 30)} / {mean("close", 30)}, 12) AS p, round({fit("c", 30)}, 12) AS q, sum((side = 1)::INT) OVER {frame(30)} AS ba, sum((side = -1)::INT) OVER {frame(30)} AS sl FROM sd),
 sq AS MATERIALIZED (SELECT *, CASE WHEN i <= 30 THEN 0 WHEN p < 0.0002 AND q > 0 AND ba > sl THEN 1 WHEN p > 0.0005 AND q > 0 THEN 2 WHEN p > -0.0002 AND q < 0 AND sl > ba THEN 3 WHEN p < -0.0005 AND q < 0 THEN 4 ELSE 0 END::INT AS phase FROM sp),
 sy AS (SELECT symbol, i, c AS f, c AS s FROM sq WHERE i = 1 UNION ALL
   SELECT k.symbol, k.i, y.f + (k.c - y.f) * 2 / 15.0::DOUBLE, y.s + (k.c - y.s) * 2 / 43.0::DOUBLE FROM sy y JOIN sq k ON k.symbol = y.symbol AND k.i = y.i + 1),
 sz AS (SELECT sq.*, y.f - y.s AS g FROM sq JOIN sy y USING (symbol, i)),
 sh AS (SELECT *, avg(abs(g)) FILTER (WHERE i > 14) OVER (PARTITION BY symbol) + 1e-9 AS scale FROM sz),
 se AS (SELECT *, 0.6::DOUBLE * tanh(g / scale) + 0.4::DOUBLE * least(greatest(delta / {mean("volume", 14)}, -1), 1) AS effort FROM sh),
 st AS MATERIALIZED (SELECT *, sum((effort > 0)::INT) OVER {frame(3)} AS green, sum((effort < 0)::INT) OVER {frame(3)} AS purple,
   20 * (spring OR selling)::INT + 20 * ((spring OR selling) AND volume >= 2 * av)::INT + 15 * (max(side) OVER {frame(4)} = 1)::INT + 15 * (phase = 1)::INT + 15 * (effort > 0.15)::INT + 15 * coalesce(c - lag(c, 5) OVER {O} > 0, false)::INT AS bull,
   20 * (upthrust OR buying)::INT + 20 * ((upthrust OR buying) AND volume >= 2 * av)::INT + 15 * (min(side) OVER {frame(4)} = -1)::INT + 15 * (phase = 3)::INT + 15 * (effort < -0.15)::INT + 15 * coalesce(c - lag(c, 5) OVER {O} < 0, false)::INT AS bear FROM se)"""


def state(spark, sf):
    b = W.swing_events(W.absorption(hourly_signed(spark, sf)), 5, 1.2, 0.5)
    return E.effort_score(X.phase(b, 30))


@query("signal_quality", f"WITH RECURSIVE {STATE} SELECT symbol, ts, bull::INT AS bull_quality, bear::INT AS bear_quality FROM st")
def signal_quality(spark, sf):
    return Z.quality(state(spark, sf)).select("symbol", "ts", "bull_quality", "bear_quality")


def walked(least: int) -> str:
    """The position rules one row at a time."""
    return f"""WITH RECURSIVE {STATE}, w AS (SELECT symbol, i, 0 AS s, 1 AS n, NULL::VARCHAR AS cause FROM st WHERE i = 1
      UNION ALL SELECT symbol, i, to_, CASE WHEN to_ <> s THEN 0 ELSE n END, CASE WHEN to_ <> s THEN why END FROM (
        SELECT x.symbol, x.i, w.s, w.n + 1 AS n, CASE
            WHEN w.n + 1 < 5 THEN w.s
            WHEN w.s = 0 AND bull >= {least} AND (spring OR selling) AND green >= 2 AND phase IN (0, 1) THEN 1
            WHEN w.s = 0 AND bear >= {least} AND (upthrust OR buying) AND purple >= 2 AND phase IN (0, 3) THEN -1
            WHEN w.s = 1 AND upthrust THEN -1 WHEN w.s = 1 AND (buying OR (phase = 3 AND purple >= 2) OR purple >= 3) THEN 0
            WHEN w.s = -1 AND spring THEN 1 WHEN w.s = -1 AND (selling OR (phase = 1 AND green >= 2) OR green >= 3) THEN 0
            ELSE w.s END AS to_,
          CASE WHEN w.s = 0 AND bull >= {least} AND (spring OR selling) AND green >= 2 AND phase IN (0, 1) THEN CASE WHEN spring THEN 'spring' ELSE 'selling_climax' END
            WHEN w.s = 0 THEN CASE WHEN upthrust THEN 'upthrust' ELSE 'buying_climax' END
            WHEN w.s = 1 THEN CASE WHEN upthrust THEN 'upthrust' WHEN buying THEN 'buying_climax' WHEN phase = 3 AND purple >= 2 THEN 'phase' ELSE 'effort' END
            ELSE CASE WHEN spring THEN 'spring' WHEN selling THEN 'selling_climax' WHEN phase = 1 AND green >= 2 THEN 'phase' ELSE 'effort' END END AS why
        FROM w JOIN st x ON x.symbol = w.symbol AND x.i = w.i + 1))
    SELECT symbol, ts, s::INT AS signal, cause FROM w JOIN st USING (symbol, i)"""


@query("position_signals", walked(0))
def position_signals(spark, sf):
    return Z.position_signals(state(spark, sf)).select("symbol", "ts", "signal", "cause")


@query("gated_signals", walked(55))
def gated_signals(spark, sf):
    return Z.position_signals(Z.quality(state(spark, sf)), least_quality=55).select("symbol", "ts", "signal", "cause")


@query(
    "rectangles",
    f"""WITH RECURSIVE {STATE}, c AS (SELECT *, (abs(close - open) <= median(abs(close - open)) OVER {frame(14)} OR absorption = 1 OR er_ratio <= 1) AS f FROM st),
    l AS MATERIALIZED (SELECT *, coalesce(lead(f) OVER {O}, false) AS nf FROM c),
    x AS (SELECT symbol, i, CASE WHEN f THEN i END AS start, CASE WHEN f THEN i END AS box FROM l WHERE i = 1
      UNION ALL SELECT n.symbol, n.i, CASE WHEN x.start IS NULL THEN CASE WHEN f THEN n.i END WHEN NOT f AND nf AND n.i - x.start < 25 THEN x.start WHEN NOT f OR n.i - x.start >= 25 THEN NULL ELSE x.start END,
        CASE WHEN x.start IS NULL THEN CASE WHEN f THEN n.i END WHEN f OR (nf AND n.i - x.start < 25) THEN x.start END
      FROM x JOIN l n ON n.symbol = x.symbol AND n.i = x.i + 1)
    SELECT symbol, (box - 1)::INT AS start, (max(i) - 1)::INT AS stop, round(min(least(open, close)) - 0.2 * avg(least(open, close) - low), 5) AS low,
      round(max(greatest(open, close)) + 0.2 * avg(high - greatest(open, close)), 5) AS high, CASE WHEN sum((effort > 0)::INT) > sum((effort < 0)::INT) THEN 1 ELSE -1 END::INT AS direction, round(avg(abs(effort)), 5) AS strength
    FROM x JOIN l USING (symbol, i) WHERE box IS NOT NULL GROUP BY symbol, box HAVING count(*) >= 3""",
)
def rectangles(spark, sf):
    got = Z.rectangles(state(spark, sf))
    return out(got, *got.columns, digits=5)
