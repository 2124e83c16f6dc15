"""Registered queries of stock indicators and of trades by their profits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import indicators as N
from tickloom.operators import windows as W

from .analytics import frame
from .registry import BARS, O, hourly, out, query, read

MEANS = {"f": ("close", "2 / 13.0::DOUBLE"), "s": ("close", "2 / 27.0::DOUBLE"), "r": ("rise", "1 / 30.0::DOUBLE"), "l": ("fall", "1 / 30.0::DOUBLE"), "p": ("up", "1 / 30.0::DOUBLE"), "m": ("down", "1 / 30.0::DOUBLE"), "t": ("tr", "1 / 30.0::DOUBLE")}


@query(
    "stock_indicators",
    f"""WITH RECURSIVE {BARS}, b0 AS (SELECT *, row_number() OVER {O} AS i, coalesce(close - lag(close) OVER {O}, 0) AS ch, coalesce(high - lag(high) OVER {O}, 0) AS u, coalesce(lag(low) OVER {O} - low, 0) AS d,
      greatest(high - low, coalesce(abs(high - lag(close) OVER {O}), 0), coalesce(abs(low - lag(close) OVER {O}), 0)) AS tr, (high + low + close) / 3 AS tp FROM bars),
    b1 AS MATERIALIZED (SELECT *, greatest(ch, 0) AS rise, greatest(-ch, 0) AS fall, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS down FROM b0),
    y AS (SELECT symbol, i, {", ".join(f"{x}::DOUBLE AS n_{k}, 1.0::DOUBLE AS d_{k}" for k, (x, _) in MEANS.items())} FROM b1 WHERE i = 1
      UNION ALL SELECT b.symbol, b.i, {", ".join(f"y.n_{k} * (1 - {a}) + b.{x}, y.d_{k} * (1 - {a}) + 1" for k, (x, a) in MEANS.items())} FROM y JOIN b1 b ON b.symbol = y.symbol AND b.i = y.i + 1),
    m AS (SELECT b.*, {", ".join(f"n_{k} / d_{k} AS {k}" for k in MEANS)}, list(tp) OVER {frame(30)} AS w, avg(tp) OVER {frame(30)} AS mid,
      avg(close) OVER {frame(20)} AS c20, stddev_samp(close) OVER {frame(20)} AS sd, avg(close) OVER {frame(30)} AS c30, avg(close) OVER {frame(60)} AS c60 FROM b1 b JOIN y USING (symbol, i)),
    q AS (SELECT *, list_sum(list_transform(w, lambda x: abs(x - mid))) / len(w) AS off FROM m)
    SELECT symbol, ts, round(f - s, 5) AS macd, round(c20 + 2 * sd, 5) AS boll_ub, round(c20 - 2 * sd, 5) AS boll_lb, round(CASE WHEN l = 0 THEN CASE WHEN r > 0 THEN 100 END ELSE 100 - 100 / (1 + r / l) END, 5) AS rsi_30,
      round(CASE WHEN off <> 0 THEN (tp - mid) / (0.015 * off) END, 4) AS cci_30, round(CASE WHEN t <> 0 AND p + m <> 0 THEN 100 * abs(p - m) / (p + m) END, 5) AS dx_30, round(c30, 8) AS close_30_sma, round(c60, 8) AS close_60_sma FROM q""",
)
def stock_indicators(spark, sf):
    got = N.indicators(hourly(spark, sf))
    return got.select("symbol", "ts", *[F.round(c, 4 if c == "cci_30" else 8 if c.endswith("sma") else 5).alias(c) for c in N.INDICATORS])


@query(
    "deviation_about_mean",
    f"""WITH {BARS}, m AS (SELECT *, row_number() OVER {O} AS i, CASE WHEN count(*) OVER {frame(10)} = 10 THEN avg(close) OVER {frame(10)} END AS m FROM bars)
    SELECT symbol, ts, round(CASE WHEN i >= 20 THEN coalesce(stddev_pop(close - m) OVER {frame(20)}, 0) + 1e-10 END, 5) AS sd FROM m""",
)
def deviation_about_mean(spark, sf):
    b = hourly(spark, sf).withColumn("m", W.rolling_mean(F.col("close"), 10, strict=True))
    return out(b.withColumn("sd", N.deviation_about(F.col("close"), F.col("m"), 20)), "symbol", "ts", "sd", digits=5)


@query(
    "entry_exits",
    """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id AS symbol, event_id AS bar, CASE WHEN event_type IN ('click', 'view') THEN 'BUY' ELSE 'SELL' END AS action, (event_id % 3)::INT - 1 AS change, (event_id % 2)::INT AS before,
      value AS price, CASE WHEN event_type = 'purchase' OR event_id % 4 = 0 THEN value - 200 ELSE 0 END AS pnl, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    s AS (SELECT symbol, i, bar AS eb, action AS ea, price AS ep, true AS held, NULL::BIGINT AS fb, NULL::VARCHAR AS fa, NULL::DOUBLE AS fp FROM ev WHERE i = 1
      UNION ALL SELECT e.symbol, e.i, e.bar, e.action, e.price, NOT (s.held AND e.pnl <> 0 AND e.before + e.change = 0), CASE WHEN s.held AND e.pnl <> 0 THEN s.eb END, CASE WHEN s.held AND e.pnl <> 0 THEN s.ea END, CASE WHEN s.held AND e.pnl <> 0 THEN s.ep END
      FROM s JOIN ev e ON e.symbol = s.symbol AND e.i = s.i + 1)
    SELECT s.symbol, fb AS entry_bar, bar AS exit_bar, CASE fa WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END AS direction, fp AS entry_price, price AS exit_price, round(pnl, 5) AS pnl, bar - fb AS hold_bars FROM s JOIN ev USING (symbol, i) WHERE fb IS NOT NULL""",
)
def entry_exits(spark, sf):
    e, k = read(spark, sf, "events"), F.col("event_id")
    action = F.when(F.col("event_type").isin("click", "view"), "BUY").otherwise("SELL")
    pnl = F.when((F.col("event_type") == "purchase") | (k % 4 == 0), F.col("value") - 200).otherwise(0.0)
    ev = e.select(F.col("user_id").alias("symbol"), k.alias("bar"), action.alias("action"), (k % 3 - 1).alias("change"), F.col("value").alias("price"), pnl.alias("pnl"), (k % 2).alias("before"))
    return N.entry_exits(ev).withColumn("pnl", F.round("pnl", 5))
