"""Registered queries of bars from rows, turning points, pivot lines, wave comparisons, trading
days and the way from ticks to orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import calendar as C
from tickloom.operators import scans as S
from tickloom.operators import turns as T
from tickloom.operators import waves as V
from tickloom.streaming import trading as TD

from .blocks import POINTS, WAVES, zigzag
from .registry import BARS, SBARS, O, hourly, hourly_signed, out, query, read, ticks


@query(
    "ohlc_range_bars",
    f"""WITH RECURSIVE {SBARS}, i AS (SELECT *, row_number() OVER {O} AS i, epoch_us(ts) AS us FROM bars),
    s AS (SELECT symbol, i, open AS o, high AS h, low AS l, close AS c, volume::DOUBLE AS v, delta::DOUBLE AS d, num_trades::BIGINT AS n, us AS start, us, 0 AS no, false AS made, 0.0::DOUBLE AS bo, 0.0::DOUBLE AS bh, 0.0::DOUBLE AS bl, 0.0::DOUBLE AS bc, 0.0::DOUBLE AS bv, 0.0::DOUBLE AS bd, 0::BIGINT AS bn, us AS bs FROM i WHERE i = 1
      UNION ALL SELECT symbol, i, CASE WHEN made THEN bc ELSE o END, CASE WHEN made THEN greatest(c, bc) ELSE h END, CASE WHEN made THEN least(c, bc) ELSE l END, c,
        CASE WHEN made THEN 0 ELSE v END, CASE WHEN made THEN 0 ELSE d END, CASE WHEN made THEN 0 ELSE n END, CASE WHEN made THEN us ELSE start END, us, no + made::INT, made,
        o, CASE WHEN c >= o THEN l + 100 ELSE h END, CASE WHEN c >= o THEN l ELSE h - 100 END, bc, v, d, n, start
      FROM (SELECT *, CASE WHEN c >= o THEN l + 100 ELSE h - 100 END AS bc FROM (
        SELECT s.symbol, s.i, s.o, s.h, s.l, s.c, s.v, s.d, s.n, s.start, s.us, s.no, true AS made FROM s WHERE h - l >= 100
        UNION ALL SELECT i.symbol, i.i, s.o, greatest(s.h, i.high), least(s.l, i.low), i.close, s.v + i.volume, s.d + i.delta, s.n + i.num_trades, s.start, i.us, s.no, false FROM s JOIN i ON i.symbol = s.symbol AND i.i = s.i + 1 WHERE s.h - s.l < 100)))
    SELECT symbol, (no - 1)::BIGINT AS bar_no, make_timestamp(us) AS ts, round(bo, 2) AS open, round(bh, 2) AS high, round(bl, 2) AS low, round(bc, 2) AS close, greatest(bv, 1) AS volume, bd AS delta, bn AS num_trades, greatest(0.1, (us - bs) / 1e6) AS duration_seconds FROM s WHERE made""",
)
def ohlc_range_bars(spark, sf):
    rows = hourly_signed(spark, sf).withColumn("seq", F.lit(0).cast("bigint"))
    return B.ranged_rows(rows, 100.0)


TURNS = f"""{BARS}, i AS (SELECT symbol, ts, close, row_number() OVER {O} AS n FROM bars), {zigzag("i", "symbol", "100")},
 tp AS (SELECT symbol, wave, d, ts, close, row_number() OVER (PARTITION BY symbol, wave ORDER BY close * d DESC, ts DESC) AS q, max(wave) OVER (PARTITION BY symbol) AS w FROM z),
 turns AS (SELECT symbol, wave, ts, close AS price, d FROM tp WHERE q = 1 AND wave < w)"""


@query("turning_points", f"WITH RECURSIVE {TURNS} SELECT symbol, wave::BIGINT AS wave, ts, price, d::INT AS direction FROM turns")
def turning_points(spark, sf):
    return T.turning_points(S.waves(hourly(spark, sf), 100.0))


@query(
    "pivot_line",
    f"""WITH RECURSIVE {TURNS}, bb AS (SELECT b.symbol, b.ts, b.ts::DATE AS day, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS k, b.close, t.price AS p, hour(b.ts) BETWEEN 2 AND 21 AS o FROM bars b LEFT JOIN turns t ON t.symbol = b.symbol AND t.ts = b.ts),
    pv AS (SELECT symbol, day, k, p, lead(k) OVER (PARTITION BY symbol ORDER BY k) AS k2, lead(p) OVER (PARTITION BY symbol ORDER BY k) AS p2, lead(day) OVER (PARTITION BY symbol ORDER BY k) AS d2 FROM bb WHERE p IS NOT NULL),
    le AS (SELECT symbol, max(k) AS k, arg_max(close, k) AS c, arg_max(day, k) AS d, arg_max(o, k) AS o FROM bb GROUP BY symbol),
    sg AS (SELECT symbol, day, k, p, k2, p2 FROM pv WHERE d2 = day UNION ALL SELECT pv.symbol, day, pv.k, p, le.k, le.c FROM pv JOIN le ON le.symbol = pv.symbol WHERE k2 IS NULL AND le.d = day AND le.o AND le.k > pv.k),
    ln AS (SELECT b.symbol, b.k, sg.p + (b.k - sg.k) / (sg.k2 - sg.k)::DOUBLE * (sg.p2 - sg.p) AS line FROM sg JOIN bb b ON b.symbol = sg.symbol AND b.k > sg.k AND b.k <= sg.k2 AND b.p IS NULL
      WHERE NOT EXISTS (SELECT 1 FROM bb x WHERE x.symbol = b.symbol AND x.k > sg.k AND x.k <= b.k AND NOT x.o))
    SELECT b.symbol, b.ts, round(coalesce(b.p, ln.line), 5) AS line FROM bb b LEFT JOIN ln ON ln.symbol = b.symbol AND ln.k = b.k""",
)
def pivot_line(spark, sf):
    """Sessions are days; lines are drawn from two to half past nine in the evening."""
    b = hourly(spark, sf)
    turns = T.turning_points(S.waves(b, 100.0)).select("symbol", "ts", F.col("price").alias("pivot"))
    b = b.join(turns, ["symbol", "ts"], "left").withColumn("session", F.to_date("ts")).withColumn("open_now", F.hour("ts").between(2, 21))
    return out(T.pivot_line(b, live="close", open_="open_now"), "symbol", "ts", "line", digits=5)


def flags(policy: str) -> str:
    push = {"inverted": "other"}.get(policy, "")
    four = lambda x: " + ".join(f"lag({x}) OVER w{k}" if k == 1 else f"lag({x}, {k}) OVER w1" for k in range(1, 5))
    large = lambda x, p: f"(coalesce(least({', '.join(f'lag({p}, {k}) OVER w1' for k in range(1, 5))}) > 0 AND lag({p}, 4) OVER w1 IS NOT NULL AND {x} > ({four(p)}) / 4 * 1.5, false))::INT"
    return f"""WITH {WAVES}, e AS (SELECT symbol, wave, d, v::DOUBLE AS v, CASE WHEN s > 0 THEN v / s ELSE 0 END AS er FROM tot),
    k AS (SELECT *, coalesce(lag(v, 2) OVER w1, 0) AS vs, coalesce(lag(er, 2) OVER w1, 0) AS es, coalesce(lag(v) OVER w1, 0) AS vother, coalesce(lag(er) OVER w1, 0) AS erother FROM e WINDOW w1 AS (PARTITION BY symbol ORDER BY wave))
    SELECT symbol, wave::BIGINT AS wave, d::INT AS direction, v AS vol, round(er, 5) AS er, {large("v", "v" + push)} AS large_wave, {large("er", "er" + push)} AS large_er,
      CASE WHEN v > vs THEN 1 ELSE -1 END::INT AS vs_same, CASE WHEN v > vother THEN 1 ELSE -1 END::INT AS vs_other, CASE WHEN er > es THEN 1 ELSE -1 END::INT AS er_vs_same, CASE WHEN er > erother THEN 1 ELSE -1 END::INT AS er_vs_other
    FROM k WINDOW w1 AS (PARTITION BY symbol ORDER BY wave)"""


def flagged(policy: str):
    def run(spark, sf):
        table = V.wave_table(V.wave_values(V.waves(hourly_signed(spark, sf), float(POINTS)))).withColumn("vol", F.col("vol").cast("double"))
        return out(T.wave_flags(table, policy), "symbol", "wave", "direction", "vol", "er", "large_wave", "large_er", "vs_same", "vs_other", "er_vs_same", "er_vs_other", digits=5)

    return run


for _policy in ("current", "same", "inverted"):
    query(f"wave_flags_{_policy}", flags(_policy))(flagged(_policy))

# Holidays by other means than the library's: the week day's date range, and Easter by Gauss.
DAYS = """r AS (SELECT min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS z FROM lineitem),
 d AS (SELECT unnest(generate_series(a, z, INTERVAL '1 day'))::DATE AS day FROM r),
 f AS (SELECT day, year(day) AS y, month(day) AS m, day(day) AS n, isodow(day) AS w FROM d),
 g AS (SELECT *, y % 19 AS ga, (19 * (y % 19) + 24) % 30 AS gd FROM f), h AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * gd + 5) % 7 AS ge FROM g),
 easter AS (SELECT *, make_date(y, 3, 22) + (CASE WHEN gd = 29 AND ge = 6 THEN 28 WHEN gd = 28 AND ge = 6 AND ga > 10 THEN 27 ELSE gd END + ge)::INT AS sunday FROM h),
 days AS (SELECT day FROM easter WHERE w < 6 AND NOT (
   (m = 1 AND n = 1) OR (m = 1 AND n = 2 AND w = 1) OR (y >= 1998 AND m = 1 AND w = 1 AND n BETWEEN 15 AND 21) OR (m = 2 AND w = 1 AND n BETWEEN 15 AND 21) OR day = sunday - 2
   OR (m = 5 AND w = 1 AND n >= 25) OR (y >= 2022 AND m = 6 AND (n = 19 OR (n = 18 AND w = 5) OR (n = 20 AND w = 1))) OR (m = 7 AND (n = 4 OR (n = 3 AND w = 5) OR (n = 5 AND w = 1)))
   OR (m = 9 AND w = 1 AND n <= 7) OR (m = 11 AND w = 4 AND n BETWEEN 22 AND 28) OR (m = 12 AND (n = 25 OR (n = 24 AND w = 5) OR (n = 26 AND w = 1)))
   OR day IN ('2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14')))"""


def days_of_lineitem(spark, sf):
    ends = read(spark, sf, "lineitem").agg(F.min("l_shipdate").cast("date").cast("string").alias("a"), F.max("l_shipdate").cast("date").cast("string").alias("z")).first()
    return C.trading_days(spark, ends["a"], ends["z"])


@query("trading_days", f"WITH {DAYS}, s AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1) SELECT day::VARCHAR AS day, coalesce(n, 0) AS n FROM days LEFT JOIN s USING (day)")
def trading_days(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days_of_lineitem(spark, sf).join(rows, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "completed_days",
    f"""WITH {DAYS}, k AS (SELECT DISTINCT l_shipmode AS symbol FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
    s AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS day, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT symbol, day::VARCHAR AS day, coalesce(quantity, 0)::DOUBLE AS quantity, coalesce(n, 0) AS n FROM k CROSS JOIN days LEFT JOIN s USING (symbol, day)""",
)
def completed_days(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    return C.completed(rows, days_of_lineitem(spark, sf), ["quantity", "n"]).withColumn("day", F.col("day").cast("string"))


@query(
    "ticks_to_orders",
    f"""WITH RECURSIVE {SBARS}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM sg WHERE price > 0),
    st AS (SELECT symbol, n, ts, price AS o, price AS h, price AS l, 0 AS bar, false AS done, price AS c FROM i WHERE n = 1
      UNION ALL SELECT symbol, n, ts, o, h, l, bar, h - l >= 100, CASE WHEN h - l >= 100 THEN least(greatest(p, o - 100), o + 100) END FROM (
        SELECT i.symbol, i.n, i.ts, i.price AS p, CASE WHEN st.done THEN st.c ELSE st.o END AS o, greatest(CASE WHEN st.done THEN st.c ELSE st.h END, i.price) AS h,
          least(CASE WHEN st.done THEN st.c ELSE st.l END, i.price) AS l, st.bar + st.done::INT AS bar FROM st JOIN i ON i.symbol = st.symbol AND i.n = st.n + 1)),
    rb AS MATERIALIZED (SELECT symbol, bar, ts, ts::DATE AS day, c, avg(c) OVER (PARTITION BY symbol ORDER BY bar ROWS 11 PRECEDING) AS m FROM st WHERE done),
    tg AS MATERIALIZED (SELECT *, CASE WHEN c > m * 1.05 THEN 1 WHEN c < m * 0.95 THEN -1 ELSE 0 END AS target FROM rb WHERE bar >= 11),
    s AS (SELECT symbol, bar, target AS position, c AS entry, 0.0::DOUBLE AS realised, 0.0::DOUBLE AS daily, false AS halted, day FROM tg WHERE bar = 11
      UNION ALL SELECT symbol, bar, CASE WHEN h THEN p ELSE target END, CASE WHEN NOT h AND target <> p AND target <> 0 THEN c ELSE e END, g, d0 + g, h OR d0 + g < -1000, day
      FROM (SELECT *, CASE WHEN NOT h AND abs(target) < abs(p) THEN (c - e) * p * 20 - 10 ELSE 0 END AS g
        FROM (SELECT x.*, s.position AS p, s.entry AS e, CASE WHEN s.day = x.day THEN s.daily ELSE 0 END AS d0, s.day = x.day AND s.halted AS h FROM s JOIN tg x ON x.symbol = s.symbol AND x.bar = s.bar + 1)))
    SELECT symbol, bar::BIGINT AS bar_no, ts, c AS close, target::INT AS target, position::INT AS position, round(realised, 5) AS realised, round(daily, 4) AS daily, halted FROM s JOIN tg USING (symbol, bar)""",
)
def ticks_to_orders(spark, sf):
    got = TD.traded(B.tick_rule(ticks(spark, sf)), 100.0, n=12, least=12, band=0.05, most=1, limit=1000.0)
    return got.withColumn("realised", F.round("realised", 5)).withColumn("daily", F.round("daily", 4))
