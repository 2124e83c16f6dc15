"""Registered queries over the supplied tables: name -> (spark, sf_dir) -> DataFrame, and
name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import graph as G
from tickloom.operators import joins as J
from tickloom.operators import labels as L
from tickloom.operators import recurrence as R
from tickloom.operators import scans as S
from tickloom.operators import splits as P
from tickloom.operators import stats as ST
from tickloom.operators import tables as T
from tickloom.operators import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark, sf) -> DataFrame:
    """events as ticks: price = value, size 1, symbol = event_type."""
    e = read(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def hourly(spark, sf) -> DataFrame:
    return B.time_bars(ticks(spark, sf))


def hourly_signed(spark, sf) -> DataFrame:
    """Hourly bars whose delta is the sum of the ticks' signed sizes."""
    return B.time_bars(B.tick_rule(ticks(spark, sf)))


def out(df: DataFrame, *columns: str, digits: int = 6, **named) -> DataFrame:
    """Columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


TICKS = "t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS size FROM events)"
BARS = TICKS + """, b AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, seq)) AS close, sum(size) AS volume, count(*) AS num_trades FROM t GROUP BY 1, 2),
bars AS (SELECT *, CASE WHEN high = low THEN 0 ELSE trunc(volume * ((close - low) / (high - low) * 2 - 1)) END::BIGINT AS delta FROM b)"""
SBARS = TICKS + """, chg AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS c FROM t),
 sg AS (SELECT *, coalesce(last_value(CASE WHEN c <> 0 THEN c * size END IGNORE NULLS)
   OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS signed FROM chg),
 bars AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
   arg_max(price, (ts, seq)) AS close, sum(size) AS volume, count(*) AS num_trades, sum(signed) AS delta FROM sg GROUP BY 1, 2)"""
W20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
O = "(PARTITION BY symbol ORDER BY ts)"  # noqa: E741
EFFORT = SBARS + f""", e AS (SELECT *, coalesce(abs(close - lag(close) OVER {O}) / volume, 0) AS er FROM bars),
r AS (SELECT *, CASE WHEN avg(er) OVER {W20} = 0 THEN 1 ELSE er / avg(er) OVER {W20} END AS er_ratio, avg(volume) OVER {W20} AS av FROM e)"""


@query(
    "bars_absorption",
    f"""WITH {EFFORT}, g AS (SELECT *, (volume / av >= 1.5 AND er_ratio <= 0.5)::INT AS absorption FROM r)
    SELECT symbol, ts, round(er, 6) AS er, round(er_ratio, 6) AS er_ratio, absorption,
      CASE WHEN absorption = 1 THEN sign(delta) ELSE 0 END::INT AS absorption_side FROM g""",
)
def bars_absorption(spark, sf):
    return out(W.absorption(hourly_signed(spark, sf)), "symbol", "ts", "er", "er_ratio", "absorption", "absorption_side")


@query("time_bars", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, num_trades, delta, sum(delta) OVER {O}::BIGINT AS cvd FROM bars")
def time_bars(spark, sf):
    return hourly(spark, sf).withColumn("cvd", F.sum("delta").over(W.past()))


@query(
    "tick_rule",
    f"""WITH {TICKS.replace("1.0::DOUBLE AS size", "(event_id % 7 + 1)::DOUBLE AS size")},
    c AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS c FROM t)
    SELECT symbol, ts, seq, price, coalesce(last_value(CASE WHEN c <> 0 THEN c * size END IGNORE NULLS)
      OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS signed FROM c""",
)
def tick_rule(spark, sf):
    sized = ticks(spark, sf).withColumn("size", (F.col("seq") % 7 + 1).cast("double"))
    return B.tick_rule(sized).select("symbol", "ts", "seq", "price", "signed")


@query("rolling_stats", f"WITH {BARS}, i AS (SELECT *, row_number() OVER {O} AS n FROM bars) SELECT symbol, ts, round(avg(close) OVER {W20}, 6) AS mean, round(stddev_pop(close) OVER {W20}, 6) AS sd, min(low) OVER {W20} AS lo, max(high) OVER {W20} AS hi, round(CASE WHEN count(*) OVER {W20} >= 2 THEN coalesce(regr_slope(close, n) OVER {W20}, 0) ELSE 0 END, 6) AS slope FROM i")
def rolling_stats(spark, sf):
    b = W.with_slope(hourly(spark, sf), "slope", "close", 20)
    c = F.col("close")
    b = b.withColumn("mean", W.rolling_mean(c, 20)).withColumn("sd", W.rolling_std(c, 20)).withColumn("lo", F.min("low").over(W.last(20))).withColumn("hi", F.max("high").over(W.last(20)))
    return out(b, "symbol", "ts", "mean", "sd", "lo", "hi", "slope")


@query("drawdown_forward", f"WITH {BARS} SELECT symbol, ts, round(close / max(close) OVER {O} - 1, 6) AS drawdown, round(coalesce(lead(close, 1) OVER {O} / close - 1, 0), 6) AS fwd1, round(coalesce(lead(close, 5) OVER {O} / close - 1, 0), 6) AS fwd5 FROM bars")
def drawdown_forward(spark, sf):
    c = F.col("close")
    b = hourly(spark, sf).withColumn("drawdown", W.drawdown(c)).withColumn("fwd1", W.forward_return(c, 1)).withColumn("fwd5", W.forward_return(c, 5))
    return out(b, "symbol", "ts", "drawdown", "fwd1", "fwd5")


SWING = SBARS + f""", s AS (SELECT *, min(low) OVER {W20} AS lo0, max(high) OVER {W20} AS hi0, avg(volume) OVER {W20} AS av,
   lag(close) OVER {O} AS pc, row_number() OVER {O} AS n FROM bars),
 p AS (SELECT *, lag(lo0) OVER {O} AS lo, lag(hi0) OVER {O} AS hi, n > 21 AND high > low AS ok, volume >= 2 * av AS heavy FROM s),
 f AS (SELECT *, coalesce((ok AND low < lo AND close > lo AND delta > 0)::INT, 0) AS spring,
   coalesce((ok AND high > hi AND close < hi AND delta < 0)::INT, 0) AS upthrust,
   coalesce((ok AND heavy AND close < pc AND (close - low) / (high - low) < 0.3 AND delta > 0)::INT, 0) AS selling_climax,
   coalesce((ok AND heavy AND close > pc AND (high - close) / (high - low) < 0.3 AND delta < 0)::INT, 0) AS buying_climax FROM p)"""
SIDES = {"spring": 1, "upthrust": -1, "selling_climax": 1, "buying_climax": -1}


@query("swing_events", f"WITH {SWING} SELECT symbol, ts, spring, upthrust, selling_climax, buying_climax FROM f")
def swing_events(spark, sf):
    return W.swing_events(hourly_signed(spark, sf)).select("symbol", "ts", *SIDES)


@query("event_rows", f"WITH {SWING} SELECT symbol, ts, close, event_type, side::INT AS side FROM (SELECT *, unnest(['spring','upthrust','selling_climax','buying_climax']) AS event_type, unnest([spring, upthrust, selling_climax, buying_climax]) AS fl, unnest([1,-1,1,-1]) AS side FROM f) WHERE fl = 1")
def event_rows(spark, sf):
    return L.events_long(W.swing_events(hourly_signed(spark, sf)), SIDES, ["symbol", "ts", "close"])


@query("bars_since_event", f"WITH {SWING}, i AS (SELECT *, n - 1 AS i FROM f) SELECT symbol, ts, (i - coalesce(last_value(CASE WHEN spring = 1 THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), -500))::BIGINT AS since FROM i")
def bars_since_event(spark, sf):
    b = W.swing_events(hourly_signed(spark, sf))
    return b.select("symbol", "ts", W.bars_since(F.col("spring") == 1, 500).cast("bigint").alias("since"))


@query("candles", f"WITH {BARS} SELECT symbol, ts, round(CASE WHEN high - low > 1e-8 THEN abs(close - open) / (high - low) ELSE 0 END, 6) AS body_ratio, round(CASE WHEN high - low > 1e-8 THEN (high - greatest(open, close)) / (high - low) ELSE 0 END, 6) AS upper_wick, round(CASE WHEN high - low > 1e-8 THEN (close - low) / (high - low) ELSE 0.5 END, 6) AS close_location FROM bars")
def candles(spark, sf):
    return out(W.candle(hourly(spark, sf)), "symbol", "ts", "body_ratio", "upper_wick", "close_location")


ATR = f", tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {O}), abs(low - lag(close) OVER {O})) AS tr FROM bars), atr AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS atr, row_number() OVER {O} AS bar_no FROM tr)"


@query("atr", f"WITH {BARS}{ATR} SELECT symbol, ts, round(atr, 6) AS atr FROM atr")
def atr(spark, sf):
    return out(W.with_atr(hourly(spark, sf)), "symbol", "ts", "atr")


@query("rolling_rank", f"WITH {BARS}, r AS (SELECT *, list(close) OVER {W20} AS l, min(close) OVER {W20} AS lo, max(close) OVER {W20} AS hi FROM bars) SELECT symbol, ts, round(len(list_filter(l, lambda x: x <= l[-1])) / len(l), 6) AS pct, round(CASE WHEN len(l) < 20 THEN 0 WHEN hi - lo < 1e-10 THEN 0.5 ELSE (close - lo) / (hi - lo) END, 6) AS minmax FROM r")
def rolling_rank(spark, sf):
    b = hourly(spark, sf)
    b = b.withColumn("pct", W.percentile_rank(F.col("close"), 20)).withColumn("minmax", W.minmax(F.col("close"), 20))
    return out(b, "symbol", "ts", "pct", "minmax")


@query("wma", f"WITH {BARS}, r AS (SELECT *, list(close) OVER {W20} AS l FROM bars) SELECT symbol, ts, round(CASE WHEN len(l) = 20 THEN list_sum(list_transform(l, lambda x, i: x * i)) / 210 END, 6) AS wma FROM r")
def wma(spark, sf):
    return out(hourly(spark, sf).withColumn("wma", W.wma(F.col("close"), 20)), "symbol", "ts", "wma")


@query(
    "trading_range",
    f"""WITH {BARS}, m AS (SELECT *, coalesce(abs(close - lag(close) OVER {O}), 0) AS m FROM bars),
    h AS (SELECT *, greatest(avg(m) OVER {W20}, 1e-8) AS a, max(high) OVER x AS range_high, min(low) OVER x AS range_low FROM m
      WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)),
    g AS (SELECT *, coalesce((close > lag(range_high) OVER {O} + 1.5 * a OR close < lag(range_low) OVER {O} - 1.5 * a)::INT, 0) AS re,
      range_high - range_low > 1e-8 AS wide FROM h),
    i AS (SELECT *, sum(re) OVER {O}::BIGINT AS island FROM g)
    SELECT symbol, ts, island, range_high, range_low, count(*) OVER z AS bars_in_range,
      sum((wide AND (close - range_low) / (range_high - range_low) < 0.15)::INT) OVER z::BIGINT AS support_touches,
      sum((wide AND (range_high - close) / (range_high - range_low) < 0.15)::INT) OVER z::BIGINT AS resistance_touches
    FROM i WINDOW z AS (PARTITION BY symbol, island ORDER BY ts)""",
)
def trading_range(spark, sf):
    return W.trading_range(hourly(spark, sf)).select("symbol", "ts", "island", "range_high", "range_low", "bars_in_range", "support_touches", "resistance_touches")


def fold(seed: str, step: str) -> str:
    """SQL for a recurrence over a symbol's closes in order."""
    return f"WITH {BARS}, l AS (SELECT symbol, list(close ORDER BY ts) AS c, list(ts ORDER BY ts) AS ts FROM bars GROUP BY symbol), y AS (SELECT symbol, ts, list_transform(range(1, len(c) + 1), lambda k: list_reduce(c[1:k], lambda a, x: {step})) AS y FROM l) SELECT symbol, unnest(ts) AS ts, round(unnest(y), 6) AS y FROM y"


@query("ema", fold("", "a * (1 - 2.0 / 21) + x * (2.0 / 21)"))
def ema(spark, sf):
    return out(R.ema(hourly(spark, sf), "close", 20, "y"), "symbol", "ts", "y")


@query("wilder", fold("", "a * (1 - 1.0 / 14) + x * (1.0 / 14)"))
def wilder(spark, sf):
    return out(R.wilder(hourly(spark, sf), "close", 14, "y"), "symbol", "ts", "y")


@query(
    "kama",
    f"""WITH RECURSIVE {BARS}, d AS (SELECT symbol, ts, close, row_number() OVER {O} AS n, abs(close - lag(close) OVER {O}) AS d,
      first_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 10 PRECEDING) AS c0 FROM bars),
    k AS (SELECT *, ((CASE WHEN sum(d) OVER x > 0 THEN abs(close - c0) / sum(d) OVER x ELSE 0 END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31) ** 2 AS k
      FROM d WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING)),
    y AS (SELECT symbol, n, ts, close AS y FROM k WHERE n = 1
      UNION ALL SELECT k.symbol, k.n, k.ts, y.y + k.k * (k.close - y.y) FROM y JOIN k ON k.symbol = y.symbol AND k.n = y.n + 1)
    SELECT symbol, ts, round(y, 5) AS y FROM y""",
)
def kama(spark, sf):
    return out(R.kama(hourly(spark, sf), "close", 10, "y"), "symbol", "ts", "y", digits=5)


def steps(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("symbol"), F.col("event_id").alias("t"), F.sqrt("value").alias("r"), (F.col("event_type") != "purchase").cast("int").alias("undone"), F.col("value").alias("v"))


STEPS = """s AS (SELECT user_id::VARCHAR AS symbol, event_id AS t, sqrt(value) AS r, (event_type <> 'purchase')::INT AS u, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n,
  coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS v1 FROM events)"""


@query(
    "discounted_return",
    f"""WITH RECURSIVE {STEPS}, g AS (SELECT symbol, t, n, r AS g FROM s WHERE n = 1
      UNION ALL SELECT s.symbol, s.t, s.n, s.r + 0.99 * s.u * g.g FROM g JOIN s ON s.symbol = g.symbol AND s.n = g.n + 1)
    SELECT symbol, t, round(g, 5) AS g FROM g""",
)
def discounted_return(spark, sf):
    return out(R.discounted_return(steps(spark, sf), "r", "undone", "g", order="t"), "symbol", "t", "g", digits=5)


@query(
    "advantage",
    f"""WITH RECURSIVE {STEPS}, d AS (SELECT *, r + 0.99 * u * v1 - v AS d FROM s), g AS (SELECT symbol, t, n, d AS g FROM d WHERE n = 1
      UNION ALL SELECT d.symbol, d.t, d.n, d.d + 0.99 * 0.95 * d.u * g.g FROM g JOIN d ON d.symbol = g.symbol AND d.n = g.n + 1)
    SELECT symbol, t, round(g, 5) AS adv FROM g""",
)
def advantage(spark, sf):
    return out(R.advantage(steps(spark, sf), "r", "undone", "v", "adv", order="t"), "symbol", "t", "adv", digits=5)


def atr_bars(spark, sf):
    return W.with_atr(hourly_signed(spark, sf)).withColumn("bar_no", W.position().cast("bigint"))


def labelled(spark, sf):
    bars = atr_bars(spark, sf)
    events = L.events_long(W.swing_events(bars), SIDES, ["symbol", "bar_no"])
    return L.triple_barrier(bars, events)


BARRIER = f"""{SWING}{ATR}, ev AS (SELECT symbol, n AS bar_no, event_type, side::INT AS side FROM (SELECT *, unnest(['spring','upthrust','selling_climax','buying_climax']) AS event_type, unnest([spring, upthrust, selling_climax, buying_climax]) AS fl, unnest([1,-1,1,-1]) AS side FROM f) WHERE fl = 1),
pr AS (SELECT ev.*, a.close AS p, a.atr, x.bar_no AS n2, x.close AS c2, CASE WHEN (side > 0 AND x.high >= a.close + 2 * a.atr) OR (side < 0 AND x.low <= a.close - 2 * a.atr) THEN 'tp' WHEN (side > 0 AND x.low <= a.close - a.atr) OR (side < 0 AND x.high >= a.close + a.atr) THEN 'sl' END AS touch
 FROM ev JOIN atr a USING (symbol, bar_no) LEFT JOIN atr x ON x.symbol = ev.symbol AND x.bar_no > ev.bar_no AND x.bar_no <= ev.bar_no + 20),
tb AS (SELECT symbol, bar_no, event_type, side, p, coalesce(min(n2) FILTER (WHERE touch IS NOT NULL), max(n2), bar_no) AS exit_bar, coalesce(arg_min(touch, n2) FILTER (WHERE touch IS NOT NULL), 'vertical') AS exit_type, coalesce(arg_min(c2, n2) FILTER (WHERE touch IS NOT NULL), arg_max(c2, n2), p) AS c FROM pr GROUP BY symbol, bar_no, event_type, side, p)"""


@query("triple_barrier", f"WITH {BARRIER} SELECT symbol, bar_no, event_type, side, (exit_type = 'tp')::INT AS label, round(side * ln(c / p), 6) + 0.0 AS ret, exit_bar, exit_type FROM tb")
def triple_barrier(spark, sf):
    return out(labelled(spark, sf), "symbol", "bar_no", "event_type", "side", "label", "ret", "exit_bar", "exit_type")


@query("sample_weights", f"WITH {BARRIER}, x AS (SELECT symbol, bar_no, event_type, exit_bar, unnest(range(bar_no, exit_bar + 1)) AS i FROM tb), c AS (SELECT symbol, i, count(*) AS n FROM x GROUP BY ALL), u AS (SELECT symbol, bar_no, event_type, avg(1.0 / n) AS u FROM x JOIN c USING (symbol, i) GROUP BY ALL) SELECT symbol, bar_no, event_type, round(u, 6) AS uniqueness, round(u * count(*) OVER (PARTITION BY symbol) / sum(u) OVER (PARTITION BY symbol), 6) AS weight FROM u")
def sample_weights(spark, sf):
    return out(L.sample_weights(labelled(spark, sf)), "symbol", "bar_no", "event_type", "uniqueness", "weight")


@query("concurrency", f"WITH {BARRIER}, e AS (SELECT symbol, bar_no AS k, 1 AS d FROM tb UNION ALL SELECT symbol, exit_bar + 1, -1 FROM tb), st AS (SELECT symbol, k, sum(d) AS d FROM e GROUP BY ALL) SELECT symbol, k AS \"at\", sum(d) OVER (PARTITION BY symbol ORDER BY k)::BIGINT AS active FROM st")
def concurrency(spark, sf):
    return J.concurrency(labelled(spark, sf), "bar_no", "exit_bar")


@query(
    "asof_last",
    """WITH q AS (SELECT user_id, ts, max(event_id) AS seq FROM events WHERE event_type = 'purchase' GROUP BY ALL),
    z AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')
    SELECT z.event_id, z.ts, q.seq FROM z ASOF LEFT JOIN q ON z.user_id = q.user_id AND z.ts >= q.ts""",
)
def asof_last(spark, sf):
    """Each click with its user's last purchase."""
    e = read(spark, sf, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("seq"))
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return J.asof_last(left, right, "user_id", "ts", ["seq"]).select("event_id", "ts", "seq")


@query("grid_fill", f"WITH {BARS}, g AS (SELECT DISTINCT ts FROM bars), s AS (SELECT DISTINCT symbol FROM bars), j AS (SELECT g.ts, s.symbol, open, high, low, close, volume FROM g CROSS JOIN s LEFT JOIN bars USING (ts, symbol)), c AS (SELECT *, coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS fill FROM j) SELECT symbol, ts, coalesce(open, fill) AS open, coalesce(high, fill) AS high, coalesce(low, fill) AS low, coalesce(close, fill) AS close, coalesce(volume, 0) AS volume FROM c")
def grid_fill(spark, sf):
    b = hourly(spark, sf)
    return J.grid_fill(b, b.select("ts"))


def returns(spark, sf) -> DataFrame:
    """Daily revenue by nation, percent change."""
    li, o, c, n = (read(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    rev = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")
    month = F.date_format("l_shipdate", "yyyy-MM").alias("ts")
    m = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("symbol"), month).agg(rev)
    w = W.order()
    m = m.withColumn("r", F.round(F.col("v") / F.lag("v").over(w) - 1, 8)).where(F.col("r").isNotNull())
    return m.withColumn("t", F.row_number().over(w) - 1)


RET = "m AS (SELECT n_name AS symbol, strftime(l_shipdate, '%Y-%m') AS ts, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), ret AS (SELECT symbol, ts, round(v / lag(v) OVER (PARTITION BY symbol ORDER BY ts) - 1, 8) AS r FROM m QUALIFY r IS NOT NULL)"


@query("return_summary", f"WITH {RET} SELECT symbol, count(r) AS n, round(avg(r), 5) AS mean, round(stddev_samp(r), 5) AS sd, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe, round(avg(r) / (stddev_pop(r) + 1e-8) * sqrt(252), 5) AS sharpe_eval, round(avg(r) / sqrt(avg(greatest(-r, 0) ** 2)), 5) AS sortino, round(1 + avg(r) / avg(greatest(-r, 0)), 5) AS omega, round(avg(r) / (avg(greatest(-r, 0) ** 3) ** (1.0 / 3)), 5) AS kappa3, round(abs(quantile_cont(r, 0.95) / quantile_cont(r, 0.05)), 5) AS tail_ratio, round(exp(avg(ln(1 + r))) - 1, 5) AS gmean FROM ret GROUP BY symbol")
def return_summary(spark, sf):
    return out(ST.summary(returns(spark, sf)), "symbol", "n", "mean", "sd", "sharpe", "sharpe_eval", "sortino", "omega", "kappa3", "tail_ratio", "gmean", digits=5)


@query("equity", f"WITH {RET}, e AS (SELECT *, exp(sum(ln(1 + r)) OVER {O}) AS equity FROM ret) SELECT symbol, ts, round(equity, 5) AS equity, round(equity / max(equity) OVER {O} - 1, 5) AS drawdown FROM e")
def equity(spark, sf):
    return out(ST.equity_drawdown(returns(spark, sf)), "symbol", "ts", "equity", "drawdown", digits=5)


@query(
    "pbo",
    f"""WITH {RET}, n AS (SELECT *, row_number() OVER {O} - 1 AS t FROM ret), p AS (SELECT max(t) + 1 AS tt FROM n),
    k AS (SELECT symbol, r, (t - tt % 8) // (tt // 8) AS c FROM n, p WHERE t >= tt % 8),
    ms AS (SELECT list_filter(range(8), lambda b: (x >> b) & 1 = 1) AS l FROM range(256) q(x) WHERE bit_count(x) = 4),
    cb AS (SELECT row_number() OVER (ORDER BY l) - 1 AS combo, l FROM ms),
    j AS (SELECT combo, symbol, r, list_contains(l, c) AS i FROM k, cb),
    s AS (SELECT combo, symbol, avg(r) FILTER (WHERE i) / greatest(stddev_samp(r) FILTER (WHERE i), 1e-10) AS is_sr,
      avg(r) FILTER (WHERE NOT i) / greatest(stddev_samp(r) FILTER (WHERE NOT i), 1e-10) AS oos_sr FROM j GROUP BY ALL),
    rk AS (SELECT *, rank() OVER (PARTITION BY combo ORDER BY oos_sr) + (count(*) OVER (PARTITION BY combo, oos_sr) - 1) / 2 AS rk,
      count(*) OVER (PARTITION BY combo) AS n, row_number() OVER (PARTITION BY combo ORDER BY is_sr DESC, symbol) AS f FROM s)
    SELECT combo::INT AS combo, symbol AS best, round(is_sr, 6) AS is_sr, round(oos_sr, 6) AS oos_sr, round(rk / (n + 1), 6) AS omega,
      round(ln(rk / (n + 1) / (1 - rk / (n + 1))), 6) AS logit FROM rk WHERE f = 1""",
)
def pbo(spark, sf):
    return out(ST.pbo(returns(spark, sf)), "combo", "best", "is_sr", "oos_sr", "omega", "logit")


@query(
    "cpcv_ranges",
    """WITH n AS (SELECT count(*) AS n, count(*) // 6 AS s FROM events), f AS (SELECT a AS fold, a * s AS lo, CASE WHEN a = 5 THEN n ELSE (a + 1) * s END AS hi FROM range(6) x(a), n),
    c AS (SELECT row_number() OVER (ORDER BY x.fold, y.fold) - 1 AS k, x.fold AS a, y.fold AS b, x.lo AS l1, x.hi AS h1, y.lo AS l2, y.hi AS h2 FROM f x, f y WHERE x.fold < y.fold),
    r AS (SELECT k, a, b, 'test' AS role, l1 AS lo, h1 AS hi FROM c UNION ALL SELECT k, a, b, 'test', l2, h2 FROM c
      UNION ALL SELECT k, a, b, 'train', 0, l1 - 1 FROM c UNION ALL SELECT k, a, b, 'train', h1 + 20, l2 - 1 FROM c
      UNION ALL SELECT k, a, b, 'train', h2 + 20, n FROM c, n)
    SELECT k::INT AS split_id, a::INT AS fold_a, b::INT AS fold_b, role, lo::BIGINT AS lo, hi::BIGINT AS hi FROM r WHERE hi > lo""",
)
def cpcv_ranges(spark, sf):
    got = P.cpcv_ranges(spark, read(spark, sf, "events").count(), 6, 2, 1, 20)
    return got.select("split_id", F.col("folds")[0].alias("fold_a"), F.col("folds")[1].alias("fold_b"), "role", "lo", "hi")


@query("cpcv_sizes", "WITH n AS (SELECT count(*) AS n, count(*) // 6 AS s FROM events), c AS (SELECT a, b FROM range(6) x(a), range(6) y(b) WHERE a < b), i AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), k AS (SELECT a, b, i, a * s AS a0, CASE WHEN a = 5 THEN n ELSE (a + 1) * s END AS a1, b * s AS b0, CASE WHEN b = 5 THEN n ELSE (b + 1) * s END AS b1 FROM c, i, n), r AS (SELECT a, b, CASE WHEN (i >= a0 AND i < a1) OR (i >= b0 AND i < b1) THEN 'test' WHEN (i >= a0 - 1 AND i < a1 + 20) OR (i >= b0 - 1 AND i < b1 + 20) THEN 'out' ELSE 'train' END AS role FROM k) SELECT a::INT AS fold_a, b::INT AS fold_b, role, count(*) AS n FROM r WHERE role <> 'out' GROUP BY ALL")
def cpcv_sizes(spark, sf):
    e = read(spark, sf, "events").select("event_id")
    ranges = P.cpcv_ranges(spark, e.count(), 6, 2, 1, 20)
    got = P.sizes(P.runs(e, "event_id"), ranges)
    return got.select(F.col("folds")[0].alias("fold_a"), F.col("folds")[1].alias("fold_b"), "role", "n")


@query(
    "backtest_paths",
    """WITH c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split_id, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b),
    f AS (SELECT split_id, a AS fold FROM c UNION ALL SELECT split_id, b FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY split_id) - 1 AS path_id FROM f),
    e AS (SELECT value, least((row_number() OVER (ORDER BY event_id) - 1) // (count(*) OVER () // 6), 5) AS fold FROM events)
    SELECT path_id::INT AS path_id, p.fold::INT AS fold, split_id::INT AS split_id, count(*) AS n, round(sum(value), 4) AS total FROM p JOIN e ON e.fold = p.fold GROUP BY ALL""",
)
def backtest_paths(spark, sf):
    rows = P.path_rows(read(spark, sf, "events").select("event_id", "value"), "event_id", 6, 2)
    return rows.groupBy("path_id", "fold", "split_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("islands", f"WITH {BARS}, h AS (SELECT symbol, (epoch(ts) // 3600)::BIGINT AS i FROM bars), g AS (SELECT symbol, i, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS g FROM h) SELECT symbol, min(i) AS lo, max(i) AS hi, count(*) AS n FROM g GROUP BY symbol, g")
def islands(spark, sf):
    h = hourly(spark, sf).select("symbol", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("bigint").alias("i"))
    return P.islands(h, "i")


@query(
    "range_bars",
    f"""WITH RECURSIVE {SBARS}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM sg WHERE price > 0),
    st AS (SELECT symbol, n, ts, price AS o, price AS h, price AS l, size AS v, signed AS d, 1 AS k, ts AS t0, 0 AS bar, false AS done, price AS c, price AS o1, price AS h1, price AS l1 FROM i WHERE n = 1
      UNION ALL SELECT symbol, n, ts, o, h, l, v, d, k, t0, bar, h - l >= 100, CASE WHEN h - l >= 100 THEN least(greatest(p, o - 100), o + 100) END, o, h, l FROM (
        SELECT i.symbol, i.n, i.ts, i.price AS p, CASE WHEN st.done THEN st.c ELSE st.o END AS o,
          greatest(CASE WHEN st.done THEN st.c ELSE st.h END, i.price) AS h, least(CASE WHEN st.done THEN st.c ELSE st.l END, i.price) AS l,
          CASE WHEN st.done THEN 0 ELSE st.v END + i.size AS v, CASE WHEN st.done THEN 0 ELSE st.d END + i.signed AS d, CASE WHEN st.done THEN 0 ELSE st.k END + 1 AS k,
          CASE WHEN st.done THEN st.ts ELSE st.t0 END AS t0, st.bar + st.done::INT AS bar
        FROM st JOIN i ON i.symbol = st.symbol AND i.n = st.n + 1))
    SELECT symbol, bar::BIGINT AS bar_no, ts, o AS open, h AS high, l AS low, c AS close, v AS volume, d AS delta, k::BIGINT AS num_trades,
      greatest(0.1, (epoch_us(ts) - epoch_us(t0)) / 1e6) AS duration_seconds, sum(d) OVER (PARTITION BY symbol ORDER BY bar) AS cvd FROM st WHERE done""",
)
def range_bars(spark, sf):
    return B.range_bars(B.tick_rule(ticks(spark, sf)), 100.0)


@query("zigzag_waves")
def zigzag_waves(spark, sf):
    return S.waves(hourly(spark, sf), 100.0).select("symbol", "ts", "close", "wave", "direction")


@query(
    "executed_orders",
    f"""WITH {BARS}, o AS (SELECT symbol, ts, CASE WHEN delta > 0 THEN 1.0 WHEN delta < 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS target, close AS price FROM bars),
    h AS (SELECT *, coalesce(lag(target) OVER {O}, 0) AS h FROM o),
    e AS (SELECT *, target - h AS q, last_value(CASE WHEN target <> h AND target <> 0 THEN price END IGNORE NULLS)
      OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM h),
    r AS (SELECT *, coalesce(CASE WHEN h * q < 0 THEN least(abs(h), abs(q)) * ((price - e) * sign(h) * 20 - 5) ELSE 0 END, 0) AS r FROM e)
    SELECT symbol, ts, target AS "position", round(r, 5) AS realised, round(100000 + sum(r) OVER {O}, 5) AS equity FROM r""",
)
def executed_orders(spark, sf):
    b = hourly(spark, sf)
    target = F.when(F.col("delta") > 0, 1.0).when(F.col("delta") < 0, -1.0).otherwise(0.0)
    got = S.execute(b.select("symbol", "ts", target.alias("target"), F.col("close").alias("price")), 2.5, 20.0, 100_000.0)
    return out(got, "symbol", "ts", "position", "realised", "equity", digits=5)


def edges(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).agg(F.sum("l_quantity").alias("w"))


EDGES = "e AS (SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"


@query("graph_objectives", f"WITH {EDGES} SELECT sum(CASE WHEN src % 2 <> dst % 2 THEN w ELSE 0 END) AS cut, count(*) FILTER (WHERE src % 2 = 0 AND dst % 2 = 0) AS uncovered, count(*) FILTER (WHERE src % 2 = 1 AND dst % 2 = 1) AS both, count(*) FILTER (WHERE src % 2 = dst % 2) AS clashes FROM e")
def graph_objectives(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return G.objectives(e, nodes.withColumn("label", F.col("node") % 2))


@query("graph_degrees", f"WITH {EDGES}, b AS (SELECT src AS node, w FROM e UNION ALL SELECT dst, w FROM e) SELECT node, count(*) AS degree, sum(w) AS strength FROM b GROUP BY node")
def graph_degrees(spark, sf):
    return G.degrees(edges(spark, sf))


@query("best_per_group", "SELECT o_orderpriority AS split, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_per_group(spark, sf):
    return T.best_per_group(read(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey").select(F.col("o_orderpriority").alias("split"), "o_orderkey", "o_totalprice")


@query("metric_summary", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.5), 4) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(stddev_samp(o_totalprice) / abs(avg(o_totalprice)), 4) AS cv FROM orders GROUP BY 1")
def metric_summary(spark, sf):
    return out(T.metric_summary(read(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), "o_orderpriority", "n", "mean", "sd", "median", "low", "high", "iqr", "cv", digits=4)


@query("trade_summary", "WITH t AS (SELECT o_orderstatus, o_totalprice - avg(o_totalprice) OVER () AS p FROM orders) SELECT o_orderstatus, count(*) AS n, sum((p > 0)::INT)::BIGINT AS wins, CASE WHEN sum(least(p, 0)) < 0 THEN round(sum(greatest(p, 0)) / -sum(least(p, 0)), 4) ELSE 'inf'::DOUBLE END AS profit_factor FROM t GROUP BY 1")
def trade_summary(spark, sf):
    o = read(spark, sf, "orders")
    p = o.crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).withColumn("p", F.col("o_totalprice") - F.col("m"))
    return out(T.trade_summary(p, "p", "o_orderstatus"), "o_orderstatus", "n", "wins", "profit_factor", digits=4)


@query("pivot_close", f"WITH {BARS} SELECT ts, first(close) FILTER (WHERE symbol = 'click') AS click, first(close) FILTER (WHERE symbol = 'purchase') AS purchase FROM bars GROUP BY ts")
def pivot_close(spark, sf):
    return T.pivot_first(hourly(spark, sf), "ts", "symbol", ["click", "purchase"], "close")


@query("zscore_tanh", f"WITH {BARS} SELECT symbol, ts, round(tanh((close - (SELECT avg(close) FROM bars)) / (SELECT stddev_pop(close) FROM bars)), 6) AS close FROM bars")
def zscore_tanh(spark, sf):
    return out(T.zscore_tanh(hourly(spark, sf).select("symbol", "ts", "close"), ["close"]), "symbol", "ts", "close")


@query("transitions", "SELECT user_id, event_id, value, next_state FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS next_state FROM events) WHERE next_state IS NOT NULL")
def transitions(spark, sf):
    return T.transitions(read(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "value", "next_state")


@query("feature_correlation", f"WITH {BARS}, f AS (SELECT symbol, volume AS a, coalesce(lead(close) OVER {O} / close - 1, 0) AS b FROM bars), r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY symbol ORDER BY b) + (count(*) OVER (PARTITION BY symbol, b) - 1) / 2 AS rb FROM f) SELECT symbol, round(corr(ra, rb), 5) AS spearman FROM r GROUP BY symbol")
def feature_correlation(spark, sf):
    b = hourly(spark, sf).withColumn("b", W.forward_return(F.col("close"), 1))
    return out(T.feature_correlation(b, "volume", "b", "symbol"), "symbol", "spearman", digits=5)
