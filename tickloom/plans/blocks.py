"""Registered queries of the wave, event and context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import scans as S
from tickloom.operators import waves as V
from tickloom.operators import windows as W

from .analytics import div, fit, frame, mean
from .registry import BARS, SBARS, O, hourly, hourly_signed, out, query

POINTS = 100
UP = "(PARTITION BY symbol, wave ORDER BY ts)"
some = "greatest({}, 1e-8)".format


def unit(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


def most(x: str) -> str:
    return f"least(greatest({x}, 0), 5)"


def trend(c: str, ks: tuple[int, ...]) -> str:
    a, b, y, z = (f"{c}{k}" for k in ks)
    return f"tanh((1.5 * {z} + 0.5 * {y} - 0.5 * {b} - 1.5 * {a}) / (5 + 1e-8::DOUBLE) / {some(f'(({a} + {b} + {y} + {z}) / 4)')})"


def pick(c: str, side: int) -> str:
    return f"coalesce(CASE WHEN d = {side} THEN {trend(c, (8, 6, 4, 2))} ELSE {trend(c, (7, 5, 3, 1))} END, 0)"


def against(k: int, x: str, base: str) -> str:
    return most(f"CASE WHEN v{k} > 1e-8 THEN ({x}) / {base} ELSE 1 END")


LAGS = ", ".join(f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY wave) AS {c}{k}" for c in "vs" for k in range(1, 9))
#: z numbers the waves, c holds the running wave, g its comparison with those before it.
WAVES = f"""RECURSIVE {SBARS}, i AS (SELECT *, row_number() OVER {O} AS n, coalesce(abs(close - lag(close) OVER {O}), 0) AS m FROM bars),
z AS (SELECT symbol, n, 1 AS d, close AS e, 0 AS wave FROM i WHERE n = 1
  UNION ALL SELECT symbol, n, CASE WHEN turn THEN -d ELSE d END, CASE WHEN turn OR d * (close - e) >= 0 THEN close ELSE e END, wave + turn::INT
  FROM (SELECT i.symbol, i.n, i.close, z.d, z.e, z.wave, z.d * (z.e - i.close) >= {POINTS} AS turn FROM z JOIN i ON i.symbol = z.symbol AND i.n = z.n + 1)),
c AS (SELECT i.*, d, wave, sum(volume) OVER {UP} AS wv, sum(delta) OVER {UP} AS wd, row_number() OVER {UP} AS wb,
  abs(e - first_value(close) OVER {UP}) AS s FROM i JOIN z USING (symbol, n)),
tot AS (SELECT symbol, wave, max(d) AS d, sum(volume) AS v, arg_max(s, n) AS s, sum(delta) / {some("sum(volume)")} AS q, count(*) AS bars, min(ts) AS start FROM c GROUP BY symbol, wave),
lg AS (SELECT symbol, wave, {LAGS}, lag(q, 2) OVER (PARTITION BY symbol ORDER BY wave) AS q2 FROM tot),
h AS (SELECT c.*, lg.* EXCLUDE (symbol, wave), wv / {some("c.s")} AS er, wd / {some("wv")} AS q FROM c JOIN lg ON lg.symbol = c.symbol AND lg.wave = c.wave),
h2 AS (SELECT *, CASE d WHEN 1 THEN v2 + v4 + v6 ELSE v1 + v3 + v5 END / 3 AS bought, CASE d WHEN 1 THEN v1 + v3 + v5 ELSE v2 + v4 + v6 END / 3 AS sold FROM h),
g AS (SELECT *, d::DOUBLE AS wave_direction, {most("wb / 20.0::DOUBLE")} AS wave_progress, {most(f"s / {some(f'({mean('m', 20)} * 20)')}")} AS wave_displacement_norm,
  {most(div("wv", mean("wv", 50)))} AS wave_vol_cumulative_norm, least(greatest(q, -1), 1) AS wave_delta_ratio,
  {against(2, "wv", "v2")} AS wave_vol_vs_same, {against(1, "wv", "v1")} AS wave_vol_vs_prev,
  {against(2, "s", some("s2"))} AS wave_disp_vs_same, {against(1, "s", some("s1"))} AS wave_disp_vs_prev,
  {against(2, "er", some(f"(v2 / {some('s2')})"))} AS wave_er_vs_same, {against(1, "er", some(f"(v1 / {some('s1')})"))} AS wave_er_vs_prev,
  CASE WHEN v2 > 1e-8 THEN least(greatest(q - q2, -2), 2) ELSE 0 END AS wave_delta_vs_same,
  {most(f"CASE WHEN v6 IS NULL THEN 1 ELSE bought / {some('sold')} END")} AS demand_score_3wave, {most(f"CASE WHEN v6 IS NULL THEN 1 ELSE sold / {some('bought')} END")} AS supply_score_3wave,
  {pick("v", 1)} AS wave_vol_trend_up, {pick("v", -1)} AS wave_vol_trend_down, {pick("s", 1)} AS wave_shortening_up, {pick("s", -1)} AS wave_shortening_down,
  CASE WHEN v2 > 1e-8 THEN least(wv / v2, 1) ELSE 0 END AS yellow_bar, {most(f"CASE WHEN v4 IS NULL THEN 1 ELSE wv / {some('((v1 + v2 + v3 + v4) / 4)')} END")} AS large_wave_score FROM h2)"""


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


def picked(df, names):
    """Doubles rounded, without negative zeros."""
    return df.select("symbol", "ts", *[(F.round(c, 6) + 0.0).alias(c) for c in names])


def waved(spark, sf):
    return V.wave_features(hourly_signed(spark, sf), float(POINTS))


@query("wave_table", f"WITH {WAVES} SELECT symbol, wave::BIGINT AS wave, d::INT AS direction, start, bars, v AS vol, round(s, 6) AS disp FROM tot")
def wave_table(spark, sf):
    df = V.wave_values(V.waves(hourly_signed(spark, sf), float(POINTS)))
    return out(V.wave_table(df), "symbol", "wave", "direction", "start", "bars", "vol", "disp")


@query("wave_features", f"WITH {WAVES} SELECT symbol, ts, {rounded(V.WAVE)} FROM g")
def wave_features(spark, sf):
    return picked(waved(spark, sf), V.WAVE)


def since(flag: str) -> str:
    return f"(n - 1 - coalesce(last_value(CASE WHEN {flag} THEN n - 1 END IGNORE NULLS) OVER {O}, -500))"


SPAN = some("(high - low)")
RUN21 = "(PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING)"
SCORES = f"""{WAVES},
e0 AS (SELECT *, min(low) OVER {RUN21} AS l0, max(high) OVER {RUN21} AS h0, {div("m", some("volume"))} AS eb, {div("volume", mean("volume", 20))} AS heavy,
  {div("close - low", SPAN)} AS place, least(greatest({div("delta", some("volume"))}, -1), 1) AS flow FROM g),
e1 AS (SELECT *, coalesce(lag(l0) OVER {O}, l0) AS lo, coalesce(lag(h0) OVER {O}, h0) AS hi, 0.5 + 0.5 * {unit("flow")} AS buy, 0.5 + 0.5 * {unit("-flow")} AS sell,
  {unit("(heavy - 1) / 2")} AS spike, {div("eb", mean("eb", 20))} AS ebr FROM e0),
e2 AS (SELECT *, {unit(f"{unit(div('lo - low', SPAN))} * place * buy")} AS spring_score, {unit(f"{unit(div('high - hi', SPAN))} * place * sell")} AS upthrust_score,
  {unit("spike * (1 - place) * buy")} AS sc_score, {unit("spike * place * sell")} AS bc_score,
  {unit("(heavy - 1) / 0.5::DOUBLE")} * {unit("1 - ebr / 0.5::DOUBLE")} AS absorption_score FROM e1),
e3 AS (SELECT *, {since("spring_score > 0.3")} AS sp, {since("upthrust_score > 0.3")} AS ut, {since("sc_score > 0.3 OR bc_score > 0.3")} AS cl FROM e2),
e AS (SELECT *, CASE WHEN absorption_score > 0.3 THEN sign(delta) ELSE 0 END::DOUBLE AS absorption_direction,
  {unit("large_wave_score - 1")} * {unit("1 - wave_displacement_norm")} AS stopping_action_score,
  1 / (1 + sp / 20.0::DOUBLE) AS bars_since_spring, 1 / (1 + ut / 20.0::DOUBLE) AS bars_since_upthrust, 1 / (1 + cl / 20.0::DOUBLE) AS bars_since_climax,
  sum(absorption_score) OVER {frame(10)} / 10 AS cumulative_absorption,
  {unit(f"0.3::DOUBLE / (1 + cl / 100.0::DOUBLE) + 0.4::DOUBLE / (1 + sp / 50.0::DOUBLE) + 0.3::DOUBLE * {unit('demand_score_3wave - 1')}")} AS event_sequence_bull,
  {unit(f"0.3::DOUBLE / (1 + cl / 100.0::DOUBLE) + 0.4::DOUBLE / (1 + ut / 50.0::DOUBLE) + 0.3::DOUBLE * {unit('supply_score_3wave - 1')}")} AS event_sequence_bear FROM e3)"""


@query("event_scores", f"WITH {SCORES} SELECT symbol, ts, {rounded(V.EVENT)} FROM e")
def event_scores(spark, sf):
    return picked(V.event_scores(waved(spark, sf)), V.EVENT)


def mix(a: str, b: str, w: str) -> str:
    return unit(f"0.4::DOUBLE * {a} + 0.3::DOUBLE * {b} + 0.3::DOUBLE * {w}")


PLACES = f"""{WAVES.replace("row_number() OVER " + O + " AS n,", "row_number() OVER " + O + " AS n, row_number() OVER " + O + " AS i, sum(delta) OVER " + O + " AS cvd,")},
r1 AS (SELECT *, greatest({mean("m", 20)}, 1e-8) AS a, max(high) OVER {frame(50)} AS rh, min(low) OVER {frame(50)} AS rl, stddev_pop(close) OVER (PARTITION BY symbol) AS sd,
  {div(fit("close", 50), mean("close", 50))} AS p, tanh({div(fit("cvd", 50), mean("volume", 50))}) AS f, {fit("close", 80)} AS slow, {mean("m", 50)} * 50 AS wide FROM g),
r2 AS (SELECT *, coalesce((close > lag(rh) OVER {O} + 1.5 * a OR close < lag(rl) OVER {O} - 1.5 * a)::INT, 0) AS re FROM r1),
r3 AS (SELECT *, sum(re) OVER {O} AS island, CASE WHEN rh - rl > 1e-8 THEN rh - rl END AS span, 1 - {unit("abs(p) * 2000")} AS flat FROM r2),
r4 AS (SELECT *, count(*) OVER k AS br, sum(coalesce(((close - rl) / span < 0.15)::INT, 0)) OVER k AS st, sum(coalesce(((rh - close) / span < 0.15)::INT, 0)) OVER k AS rt
  FROM r3 WINDOW k AS (PARTITION BY symbol, island ORDER BY ts))"""


@query(
    "context_features",
    f"""WITH {PLACES}, y AS (SELECT symbol, ts, {unit(div("close - rl", some("(rh - rl)")))} AS pct_in_range, {most(div("rh - rl", some("wide")))} AS range_width_norm,
      1 / (1 + br / 100.0::DOUBLE) AS bars_in_range, {unit("st / 5.0::DOUBLE")} AS support_test_count, {unit("rt / 5.0::DOUBLE")} AS resistance_test_count,
      {mix("flat", unit("f"), unit("demand_score_3wave - 1"))} AS phase_accum_score, {mix(unit("p * 2000"), unit("f"), unit("wave_vol_trend_up"))} AS phase_markup_score,
      {mix("flat", unit("-f"), unit("supply_score_3wave - 1"))} AS phase_distrib_score, {mix(unit("-p * 2000"), unit("-f"), unit("wave_vol_trend_down"))} AS phase_markdown_score,
      tanh(slow / (sd / 80 + 1e-8)) AS trend_4x FROM r4) SELECT symbol, ts, {rounded(V.CONTEXT)} FROM y""",
)
def context_features(spark, sf):
    return picked(V.context(waved(spark, sf)), V.CONTEXT)


@query("all_features")
def all_features(spark, sf):
    """The 58 features in one frame; each block has SQL of its own."""
    b = hourly_signed(spark, sf).withColumn("duration_seconds", F.col("num_trades") * 60.0)
    return V.all_features(b, float(POINTS))


def zigzag(rows: str, key: str, limit: str) -> str:
    """Recursive zigzag of rows i (key, n, ts, close) that starts upwards."""
    return f"""z AS (SELECT {key}, n, ts, close, 1 AS d, close AS e, 0 AS wave FROM {rows} WHERE n = 1
      UNION ALL SELECT {key}, n, ts, close, CASE WHEN turn THEN -d ELSE d END, CASE WHEN turn OR d * (close - e) >= 0 THEN close ELSE e END, wave + turn::INT
      FROM (SELECT i.*, z.d, z.e, z.wave, z.d * (z.e - i.close) > 0 AND z.d * (z.e - i.close) >= {limit} AS turn
        FROM z JOIN {rows} i ON {" AND ".join(f"i.{k} = z.{k}" for k in key.split(", "))} AND i.n = z.n + 1))"""


@query(
    "percent_waves",
    f"""WITH RECURSIVE {BARS}, i AS (SELECT symbol, ts, close, row_number() OVER {O} AS n FROM bars), {zigzag("i", "symbol", "z.e * 50.0::DOUBLE / 100")}
    SELECT symbol, ts, close, wave::BIGINT AS wave, d::INT AS direction FROM z""",
)
def percent_waves(spark, sf):
    return S.waves(hourly(spark, sf), 50.0, percent=True).select("symbol", "ts", "close", "wave", "direction")


@query(
    "session_waves",
    f"""WITH RECURSIVE {BARS}, i AS (SELECT symbol, ts::DATE AS day, ts, close, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS n FROM bars), {zigzag("i", "symbol, day", "100")},
    m AS (SELECT symbol, day, max(wave) + 1 AS w FROM z GROUP BY 1, 2),
    o AS (SELECT symbol, day, coalesce(sum(w) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM m)
    SELECT symbol, ts, close, (wave + o.at)::BIGINT AS wave, d::INT AS direction FROM z JOIN o USING (symbol, day)""",
)
def session_waves(spark, sf):
    b = hourly(spark, sf).withColumn("day", F.to_date("ts"))
    return S.session_waves(b, 100.0, "day").select("symbol", "ts", "close", "wave", "direction")
