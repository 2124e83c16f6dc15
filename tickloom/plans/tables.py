"""Registered queries of result tables, codecs, sessions and managed orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import reports as R
from tickloom.operators import windows as W
from tickloom.sources import files
from tickloom.streaming import sessions as SS

from .analytics import frame
from .registry import BARS, EDGES, RET, SBARS, O, edges, hourly, hourly_signed, out, query, read, returns

#: The digits in order: numbers, capitals, small letters, _ and $.
CODE = "'0123456789' || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || 'abcdefghijklmnopqrstuvwxyz' || '_$'"
BITS = "b AS (SELECT user_id, string_agg(CASE event_type WHEN 'click' THEN '1' ELSE '0' END, '' ORDER BY event_id) AS bits FROM events GROUP BY user_id)"


def user_bits(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_type") == "click", "1").otherwise("0").alias("b")))).alias("l"))
    return e.select("user_id", F.array_join("l.b", "").alias("bits"))


@query(
    "bit_codec",
    f"""WITH {BITS}, p AS (SELECT *, ceil(length(bits) / 6)::INT AS n, lpad(bits, ceil(length(bits) / 6)::INT * 6, '0') AS p FROM b),
    d AS (SELECT *, list_transform(range(0, n), lambda i: list_sum(list_transform(range(0, 6), lambda j: substr(p, i * 6 + j + 1, 1)::INT * (1 << (5 - j)))))
      AS v FROM p),
    x AS (SELECT user_id, list_aggregate(list_transform(v, lambda x: substr(({CODE}), x::INT + 1, 1)), 'string_agg', '') AS text, bits FROM d),
    k AS (SELECT *, list_aggregate(list_transform(string_split(text, ''), lambda c: lpad(bin(instr(({CODE}), c) - 1), 6, '0')), 'string_agg', '') AS back FROM x)
    SELECT user_id, text, substr(back, length(back) - length(bits) + 1) AS decoded FROM k""",
)
def bit_codec(spark, sf):
    b = user_bits(spark, sf).withColumn("text", files.encode_bits(F.col("bits"), wrap=False))
    return b.select("user_id", "text", files.decode_bits(F.col("text"), F.length("bits")).alias("decoded"))


@query("session_delta", f"WITH {SBARS} SELECT symbol, ts, ts::DATE::VARCHAR AS session, sum(delta) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS total FROM bars")
def session_delta(spark, sf):
    return SS.session_sum(hourly_signed(spark, sf)).withColumn("session", F.col("session").cast("string"))


@query("buffered_windows", f"WITH {BARS}, w AS (SELECT symbol, ts, list(close) OVER {frame(8)} AS l, row_number() OVER {O} AS i FROM bars) SELECT symbol, ts, len(l) AS n, round(list_sum(l), 4) AS total, l[1] AS oldest FROM w WHERE i >= 5")
def buffered_windows(spark, sf):
    w = SS.windows(hourly(spark, sf), 8, 5)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return w.select("symbol", "ts", F.size("window").cast("long").alias("n"), F.round(total, 4).alias("total"), F.element_at("window", 1).alias("oldest"))


@query(
    "managed_orders",
    f"""WITH RECURSIVE {SBARS}, i AS (SELECT symbol, ts, ts::DATE AS day, sign(delta)::INT AS target, close AS price, row_number() OVER {O} AS i FROM bars),
    s AS (SELECT symbol, i, ts, day, target, target AS position, price AS entry, 0.0::DOUBLE AS realised, 0.0::DOUBLE AS daily, false AS halted FROM i WHERE i = 1
      UNION ALL SELECT symbol, i, ts, day, target, CASE WHEN h THEN p ELSE target END, CASE WHEN NOT h AND target <> p AND target <> 0 THEN price ELSE e END, g, d0 + g, h OR d0 + g < -1000
      FROM (SELECT *, CASE WHEN NOT h AND abs(target) < abs(p) THEN (price - e) * p * 20 - 10 ELSE 0 END AS g
        FROM (SELECT i.*, s.position AS p, s.entry AS e, CASE WHEN s.day = i.day THEN s.daily ELSE 0 END AS d0, s.day = i.day AND s.halted AS h
          FROM s JOIN i ON i.symbol = s.symbol AND i.i = s.i + 1)))
    SELECT symbol, ts, target, position, round(realised, 5) AS realised, round(daily, 4) AS daily, halted FROM s""",
)
def managed_orders(spark, sf):
    o = hourly_signed(spark, sf).select("symbol", "ts", F.signum("delta").alias("target"), F.col("close").alias("price"))
    got = SS.managed(o, 1, 1000.0)
    return got.withColumn("realised", F.round("realised", 5)).withColumn("daily", F.round("daily", 4))


@query(
    "method_table",
    """WITH p AS (SELECT o_orderpriority AS i, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY 1),
    u AS (SELECT * FROM p UNION ALL SELECT 'Average', avg(F), avg(O) FROM p) SELECT i, round(F, 4) AS F, round(O, 4) AS O, round((O - F) / abs(F), 6) AS "O_gap" FROM u""",
)
def method_table(spark, sf):
    got = R.method_table(read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "i"), "i", "o_orderstatus", "o_totalprice", ["F", "O"], "F")
    return got.select("i", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"), F.round("O_gap", 6).alias("O_gap"))


@query(
    "metric_mismatches",
    f"""WITH {RET}, g AS (SELECT symbol, ts[:4] AS split, sum(r) AS a, avg(r) / stddev_samp(r) AS b FROM ret GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY a DESC NULLS LAST, symbol) AS i, row_number() OVER (PARTITION BY split ORDER BY b DESC NULLS LAST, symbol) AS j FROM g)
    SELECT split, max(CASE WHEN i = 1 THEN symbol END) AS best_a, max(CASE WHEN j = 1 AND b IS NOT NULL THEN symbol END) AS best_b,
      coalesce(max(CASE WHEN i = 1 THEN symbol END) = max(CASE WHEN j = 1 AND b IS NOT NULL THEN symbol END), false) AS matched FROM k GROUP BY split""",
)
def metric_mismatches(spark, sf):
    g = returns(spark, sf).groupBy("symbol", F.substring("ts", 1, 4).alias("split")).agg(F.sum("r").alias("a"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("b"))
    return R.mismatches(g, "split", "symbol", "a", "b")


@query("objective_spread", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1, 2")
def objective_spread(spark, sf):
    return out(R.spread(read(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"), "o_orderpriority", "o_orderstatus", "n", "mean", "sd", digits=4)


@query(
    "joined_curves",
    f"WITH {BARS} SELECT ts, a.close AS click, b.close AS purchase, c.close AS signup FROM (SELECT * FROM bars WHERE symbol = 'click') a JOIN (SELECT * FROM bars WHERE symbol = 'purchase') b USING (ts) JOIN (SELECT * FROM bars WHERE symbol = 'signup') c USING (ts)",
)
def joined_curves(spark, sf):
    b = hourly(spark, sf)
    return R.joined_curves([b.where(F.col("symbol") == s).select("ts", F.col("close").alias(s)) for s in ("click", "purchase", "signup")], "ts")


@query(
    "reindexed",
    f"WITH {BARS} SELECT a.ts, b.close, b.ts IS NULL AS missing FROM (SELECT ts FROM bars WHERE symbol = 'click') a LEFT JOIN (SELECT * FROM bars WHERE symbol = 'purchase') b ON a.ts = b.ts",
)
def reindexed(spark, sf):
    b = hourly(spark, sf)
    return R.reindexed(b.where("symbol = 'purchase'").select("ts", "close"), b.where("symbol = 'click'"), "ts")


@query(
    "resampled",
    f"""WITH {BARS}, k AS (SELECT symbol, close AS v, row_number() OVER {O} - 1 AS k, lead(close) OVER {O} AS nx, count(*) OVER (PARTITION BY symbol) AS m FROM bars),
    g AS (SELECT DISTINCT symbol, i, i * (m - 1) / 49.0::DOUBLE AS pos FROM k, range(50) r(i))
    SELECT g.symbol, i::INT AS i, round(v + (pos - k) * (coalesce(nx, v) - v), 5) AS close FROM g JOIN k ON k.symbol = g.symbol AND k.k = floor(pos)""",
)
def resampled(spark, sf):
    b = hourly(spark, sf)
    return out(R.resampled(b, b.select("symbol").distinct().withColumn("n", F.lit(50)), "close"), "symbol", "i", "close", digits=5)


@query(
    "window_vectors",
    f"""WITH {BARS}, w AS (SELECT symbol, ts, list(close) OVER {frame(6)} AS l FROM bars)
    SELECT symbol, ts, round(list_sum(list_transform(l, lambda x, i: x * (i + 6 - len(l)))), 4) AS weighted, CASE WHEN len(l) < 6 THEN 0 ELSE l[1] END AS oldest FROM w""",
)
def window_vectors(spark, sf):
    b = hourly(spark, sf).select("symbol", "ts", R.window_vector(F.col("close"), 6).alias("v"))
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return b.select("symbol", "ts", F.round(total, 4).alias("weighted"), F.element_at("v", 1).alias("oldest"))


@query(
    "chained_segments",
    f"""WITH {RET}, g AS (SELECT ts AS segment, sum(ln(1 + r)) AS g FROM ret GROUP BY 1)
    SELECT segment, round(exp(g) - 1, 5) AS growth, round(sum(g) OVER (ORDER BY segment), 5) AS log_chained FROM g""",
)
def chained_segments(spark, sf):
    got = R.chained(returns(spark, sf), "r", "ts", "ts")
    return got.select(F.col("ts").alias("segment"), F.round("growth", 5).alias("growth"), F.round("log_chained", 5).alias("log_chained"))


@query(
    "kept_better",
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT k, greatest(a.v, b.v) AS v, CASE WHEN a.v >= b.v OR b.v IS NULL THEN 'F' ELSE 'O' END AS s FROM a FULL JOIN b USING (k)""",
)
def kept_better(spark, sf):
    o = read(spark, sf, "orders")
    one = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("s", F.lit(s))
    return R.kept_better(one("F"), one("O"), "k", "v")


@query(
    "closeness",
    f"""WITH {EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), s AS (SELECT min(src) AS a FROM e),
    n0 AS (SELECT a AS source, a AS node FROM s), n1 AS (SELECT DISTINCT source, b AS node FROM n0 JOIN u ON a = node),
    n2 AS (SELECT DISTINCT source, b AS node FROM n1 JOIN u ON a = node),
    al AS (SELECT *, 0 AS k FROM n0 UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2)
    SELECT source, node, CASE min(k) WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS closeness FROM al GROUP BY source, node""",
)
def closeness(spark, sf):
    e = edges(spark, sf)
    return R.closeness(e, e.agg(F.min("src").alias("node")), 2)
