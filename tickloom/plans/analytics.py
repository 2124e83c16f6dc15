"""More registered queries: feature blocks, moving averages, ratios, trades and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import features as X
from tickloom.operators import graph as G
from tickloom.operators import panel as PN
from tickloom.operators import scans as S
from tickloom.operators import splits as P
from tickloom.operators import stats as ST
from tickloom.operators import trades as TR
from tickloom.operators import windows as W

from .registry import BARS, EDGES, EFFORT, O, RET, SBARS, W20, edges, hourly, hourly_signed, out, query, read, returns


def div(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-8 THEN ({a}) / ({b}) ELSE 0 END)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


def mean(x: str, n: int) -> str:
    return f"avg({x}) OVER {frame(n)}"


def fit(x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(n)} >= 2 THEN coalesce(regr_slope({x}, i) OVER {frame(n)}, 0) ELSE 0 END)"


def ratio(x: str, n: int) -> str:
    return f"least(greatest({div(x, mean(x, n))}, 0), 5)"


SPAN = "greatest(high - low, 1e-8)"


@query(
    "microstructure",
    f"""WITH {SBARS},
    a AS (SELECT *, num_trades * 60.0::DOUBLE AS dur, row_number() OVER {O} AS i, sum(delta) OVER {O} AS cvd,
      coalesce(close - lag(close) OVER {O}, 0) AS dc, lag(close, 5) OVER {O} AS c5 FROM bars),
    eb AS (SELECT *, {div("abs(dc)", "greatest(volume, 1e-8)")} AS er, {div("dc", "close")} AS ret, avg(volume) OVER {W20} AS v20,
      stddev_pop(abs(dc)) OVER (PARTITION BY symbol) AS sd FROM a)
    SELECT symbol, ts, {", ".join(f"{c} + 0.0 AS {c}" for c in X.MICRO)} FROM (SELECT symbol, ts, round({div("close - open", SPAN)}, 6) AS body_ratio, round({div("high - greatest(open, close)", SPAN)}, 6) AS upper_wick_ratio,
      round({div("least(open, close) - low", SPAN)}, 6) AS lower_wick_ratio, round({div("close - low", SPAN)}, 6) AS close_location,
      round(least(greatest({div("delta", "greatest(volume, 1e-8)")}, -1), 1), 6) AS delta_ratio,
      round({ratio("volume", 20)}, 6) AS vol_vs_ma20, round({ratio("volume", 50)}, 6) AS vol_vs_ma50, round({ratio("er", 20)}, 6) AS er_ratio,
      round({ratio("dur", 20)}, 6) AS duration_norm, round(tanh({div(fit("cvd", 10), "v20")}), 6) AS cvd_slope_fast,
      round(tanh({div(fit("cvd", 30), "v20")}), 6) AS cvd_slope_slow,
      round(least(greatest(tanh({fit("close", 20)} / (sd + 1e-8)) - tanh({div(fit("cvd", 20), "v20")}), -2), 2), 6) AS cvd_divergence,
      round(tanh(ret * 100), 6) AS return_1, round(tanh(coalesce((close - c5) / (c5 + 1e-8), 0) * 50), 6) AS return_5,
      round(tanh(stddev_pop(ret) OVER {W20} * 200), 6) AS volatility_20 FROM eb)""",
)
def microstructure(spark, sf):
    b = hourly_signed(spark, sf).withColumn("duration_seconds", F.col("num_trades") * 60.0)
    got = out(X.microstructure(b), "symbol", "ts", *X.MICRO)
    return got.select("symbol", "ts", *[(F.col(c) + 0.0).alias(c) for c in X.MICRO])  # no negative zeros


@query(
    "phase",
    f"""WITH {EFFORT}, g AS (SELECT *, CASE WHEN volume / av >= 1.5 AND er_ratio <= 0.5 THEN sign(delta) ELSE 0 END::INT AS side,
      row_number() OVER {O} AS i, sum(delta) OVER {O} AS cvd FROM r),
    p AS (SELECT *, round({fit("close", 30)} / {mean("close", 30)}, 12) AS p, round({fit("cvd", 30)}, 12) AS q, sum((side = 1)::INT) OVER {frame(30)} AS ba,
      sum((side = -1)::INT) OVER {frame(30)} AS sa FROM g)
    SELECT symbol, ts, CASE WHEN i <= 30 THEN 0 WHEN p < 0.0002 AND q > 0 AND ba > sa THEN 1 WHEN p > 0.0005 AND q > 0 THEN 2
      WHEN p > -0.0002 AND q < 0 AND sa > ba THEN 3 WHEN p < -0.0005 AND q < 0 THEN 4 ELSE 0 END::INT AS phase FROM p""",
)
def phase(spark, sf):
    return X.phase(W.absorption(hourly_signed(spark, sf)), 30).select("symbol", "ts", "phase")


@query(
    "moving_averages",
    f"""WITH {BARS}, i AS (SELECT *, row_number() OVER {O} AS i FROM bars),
    m AS (SELECT *, CASE WHEN i >= 10 THEN {mean("close", 10)} ELSE 0 END AS m,
      CASE WHEN i >= 9 THEN list_sum(list_transform(list(close) OVER {frame(9)}, lambda x, k: x * k)) / 45 ELSE 0 END * 2
      - CASE WHEN i >= 18 THEN list_sum(list_transform(list(close) OVER {frame(18)}, lambda x, k: x * k)) / 171 ELSE 0 END AS d FROM i)
    SELECT symbol, ts, round(CASE WHEN i >= 10 THEN {mean("m", 10)} END, 6) AS triangular,
      round(CASE WHEN i >= 4 THEN list_sum(list_transform(list(d) OVER {frame(4)}, lambda x, k: x * k)) / 10 END, 6) AS hull FROM m""",
)
def moving_averages(spark, sf):
    b = X.hull(X.triangular(hourly(spark, sf), "close", 10, "triangular"), "close", 18, "hull")
    return out(b, "symbol", "ts", "triangular", "hull")


@query(
    "vidya",
    f"""WITH RECURSIVE {BARS}, d AS (SELECT *, row_number() OVER {O} AS n, close - lag(close) OVER {O} AS d FROM bars),
    k AS (SELECT *, coalesce(CASE WHEN sum(abs(d)) OVER x > 0 THEN abs(sum(d) OVER x) / sum(abs(d)) OVER x END, 0) * (2.0 / 11) AS k FROM d
      WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 8 PRECEDING)),
    y AS (SELECT symbol, n, ts, close AS y FROM k WHERE n = 1
      UNION ALL SELECT k.symbol, k.n, k.ts, k.k * k.close + (1 - k.k) * y.y FROM y JOIN k ON k.symbol = y.symbol AND k.n = y.n + 1)
    SELECT symbol, ts, round(y, 5) AS y FROM y""",
)
def vidya(spark, sf):
    return out(X.vidya(hourly(spark, sf), "close", 10, "y"), "symbol", "ts", "y", digits=5)


@query(
    "rolling_risk",
    f"""WITH {BARS}, r AS (SELECT *, row_number() OVER {O} AS i, coalesce(ln(close + 1e-12) - ln(lag(close) OVER {O} + 1e-12), 0) AS r FROM bars),
    w AS (SELECT *, CASE WHEN i > 30 THEN stddev_pop(r) OVER b END AS v, CASE WHEN i > 30 THEN avg(r) OVER b END AS m FROM r
      WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, CASE WHEN v > 1e-12 THEN m / v WHEN v IS NOT NULL THEN 0 END AS q FROM w)
    SELECT symbol, ts, round(coalesce(first_value(v IGNORE NULLS) OVER a, 0), 6) AS volatility, round(coalesce(first_value(q IGNORE NULLS) OVER a, 0), 6) AS sharpe,
      round((close - max(close) OVER {frame(30)}) / (max(close) OVER {frame(30)} + 1e-9), 6) AS window_drawdown FROM q
    WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def rolling_risk(spark, sf):
    return out(X.rolling_risk(hourly(spark, sf), 30), "symbol", "ts", "volatility", "sharpe", "window_drawdown")


@query(
    "ratio_variants",
    f"""WITH {RET}, mo AS (SELECT symbol, count(r) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS sk, kurtosis(r) AS ku,
      avg(r) AS a, stddev_samp(r) AS sd, stddev_samp(least(r, 0)) AS dn, stddev_pop(r) FILTER (WHERE r < 0) AS neg,
      avg(ln(1 + r)) AS g, stddev_pop(ln(1 + r)) AS gs, sqrt(avg(ln(1 + r) ** 2) FILTER (WHERE r < 0)) AS gd, sum(ln(1 + r)) AS gt FROM ret GROUP BY symbol)
    SELECT symbol, round(a / greatest(sd, 1e-10) * sqrt(252), 5) AS sharpe_pbo, round(sr * sqrt(252), 5) AS sharpe_agents,
      round(sr * (1 + sk / 6 * sr + ku / 24 * sr * sr) * sqrt(252), 5) AS sharpe_adjusted, round(g / gs * sqrt(least(n, 320000)), 5) AS sharpe_bars,
      round(a / greatest(dn, 1e-10) * sqrt(252), 5) AS sortino_pbo, round(a / (neg + 1e-8) * sqrt(252), 5) AS sortino_eval,
      round(a / neg, 5) AS sortino_pipeline, round(g / gd * sqrt(least(n, 320000)), 5) AS sortino_bars,
      round(exp(gt) ** (12.0 / n) - 1, 5) AS annual FROM mo""",
)
def ratio_variants(spark, sf):
    r = F.col("r")
    got = returns(spark, sf).groupBy("symbol").agg(
        *[ST.sharpe(r, v).alias(f"sharpe_{v}") for v in ("pbo", "agents", "adjusted", "bars")],
        *[ST.sortino(r, v, factor=252.0).alias(f"sortino_{v}") for v in ("pbo", "eval", "pipeline", "bars")],
        ST.annual_geometric(F.log1p(r), 12.0).alias("annual"),
    )
    return out(got, *got.columns, digits=5)


@query(
    "calmar",
    f"""WITH {RET}, e AS (SELECT *, exp(sum(ln(1 + r)) OVER {O}) AS e FROM ret), d AS (SELECT *, e / max(e) OVER {O} - 1 AS d FROM e),
    g AS (SELECT symbol, arg_max(e, ts) ** (12.0 / count(*)) - 1 AS annual, min(d) AS dd, avg(r) * 12 AS m FROM d GROUP BY symbol)
    SELECT symbol, round(annual, 5) AS annual, round(dd, 5) AS max_drawdown, round(annual / abs(dd), 5) AS calmar, round(m / abs(dd), 5) AS calmar_mean FROM g""",
)
def calmar(spark, sf):
    got = ST.calmar(returns(spark, sf), factor=12.0)
    return out(got, *got.columns, digits=5)


@query(
    "dominance",
    f"""WITH {RET}, b AS (SELECT min(r) AS lo, (max(r) - min(r)) / 99 AS st FROM ret),
    c AS (SELECT least(ceil((r - lo) / st)::INT, 99) AS i, (symbol LIKE '%1%')::INT AS c FROM ret, b),
    k AS (SELECT i, sum(c) AS a, sum(1 - c) AS o FROM c GROUP BY i),
    g AS (SELECT q.i::INT AS i, lo + q.i * st AS x, st, coalesce(a, 0) AS a, coalesce(o, 0) AS o FROM range(100) q(i) CROSS JOIN b LEFT JOIN k ON k.i = q.i),
    s AS (SELECT i, x, st, sum(a) OVER (ORDER BY i) / sum(a) OVER () AS chosen, sum(o) OVER (ORDER BY i) / sum(o) OVER () AS other FROM g)
    SELECT i, round(x, 5) AS x, round(chosen, 5) AS chosen, round(other, 5) AS other, round(sum((other - chosen) * st) OVER (ORDER BY i), 5) + 0.0 AS gap FROM s""",
)
def dominance(spark, sf):
    got = ST.dominance(returns(spark, sf), F.col("symbol").contains("1"))
    return out(got, *got.columns, digits=5)


TURNS = f"""{BARS}, o AS (SELECT symbol, ts, sign(delta)::INT AS s, close AS price FROM bars),
 sb AS (SELECT *, coalesce(lag(s) OVER {O}, 0) AS b FROM o), turns AS (SELECT * FROM sb WHERE s <> b),
 x AS (SELECT *, lead(ts) OVER {O} AS exit_ts, lead(price) OVER {O} AS exit FROM turns),
 tr AS (SELECT symbol, row_number() OVER {O} AS n, ts AS entry_ts, exit_ts, s AS side, price AS entry, exit, (exit - price) * s AS pnl FROM x WHERE s <> 0 AND exit IS NOT NULL)"""


def trips(spark, sf):
    b = hourly(spark, sf)
    return TR.round_trips(b.select("symbol", "ts", F.signum("delta").alias("target"), F.col("close").alias("price")))


@query("round_trips", f'WITH {TURNS} SELECT symbol, n::INT AS n, entry_ts, exit_ts, side, entry, "exit", round(pnl, 6) AS pnl FROM tr')
def round_trips(spark, sf):
    return out(trips(spark, sf), "symbol", "n", "entry_ts", "exit_ts", "side", "entry", "exit", "pnl")


@query(
    "trade_buckets",
    f"""WITH {TURNS}, h AS (SELECT *, hour(entry_ts) AS h FROM tr)
    SELECT CASE WHEN h < 6 THEN 'asia' WHEN h < 12 THEN 'europe_am' WHEN h < 15 THEN 'europe_pm' WHEN h < 20 THEN 'us_am' ELSE 'us_pm' END AS session,
      count(*) AS n, sum((pnl > 0)::INT)::BIGINT AS wins, round(sum(pnl), 4) AS total, round(avg(pnl), 4) AS mean FROM h GROUP BY 1""",
)
def trade_buckets(spark, sf):
    t = trips(spark, sf).withColumn("session", TR.session(F.hour("entry_ts")))
    return out(TR.bucketed(t, "session", "pnl"), "session", "n", "wins", "total", "mean", digits=4)


@query(
    "equal_weight",
    f"""WITH {BARS}, r AS (SELECT ts, close / lag(close) OVER {O} - 1 AS r FROM bars), d AS (SELECT ts, avg(r) AS r FROM r WHERE r IS NOT NULL GROUP BY ts)
    SELECT count(r) AS n, round(ln(exp(sum(ln(1 + r)))), 5) AS total, round(avg(r) / (stddev_pop(r) + 1e-8) * sqrt(252), 5) AS sharpe FROM d""",
)
def equal_weight(spark, sf):
    got = TR.equal_weight(hourly(spark, sf)).withColumn("total", F.log1p("total"))
    return out(got, "n", "total", "sharpe", digits=5)


def grown(name: str, x: str) -> str:
    """Growth in SQL: logarithm of the magnitude, and sign."""
    return f"round(sum(ln(abs(CASE WHEN 1 + {x} = 0 THEN NULL ELSE 1 + {x} END))), 4) AS {name}_log, (CASE WHEN bool_or(1 + {x} = 0) THEN 0 WHEN count(*) FILTER (WHERE 1 + {x} < 0) % 2 = 1 THEN -1 ELSE 1 END)::INT AS {name}_sign"


@query(
    "baselines",
    f"""WITH {BARS}, i AS (SELECT *, row_number() OVER {O} - 1 AS i, lead(close) OVER {O} AS nx FROM bars),
    m AS (SELECT *, CASE WHEN i < 50 THEN 0 WHEN sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20
      > sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50 THEN 1 ELSE -1 END AS s, sign(nx - close) AS o FROM i),
    p AS (SELECT *, nx / close - 1 AS h, s * (nx / close - 1) - abs(lead(s) OVER {O} - s) * 0.5 / nx AS x, abs(nx / close - 1) - abs(o - coalesce(lag(o) OVER {O}, 0)) * 0.5 / nx AS y FROM m)
    SELECT symbol, count(h) AS n, {grown("hold", "h")}, {grown("sma", "x")}, {grown("oracle", "y")} FROM p GROUP BY symbol""",
)
def baselines(spark, sf):
    got = TR.baselines(hourly(spark, sf))
    return out(got, *got.columns, digits=4)


@query(
    "random_baseline",
    f"""WITH {BARS}, i AS (SELECT symbol, row_number() OVER {O} - 1 AS i, close, lead(close) OVER {O} AS nx FROM bars),
    d AS (SELECT *, ('0x' || substr(md5('42:' || trial || ':' || i), 1, 8))::BIGINT % 3 - 1 AS p FROM i, range(20) AS t(trial)),
    q AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY symbol, trial ORDER BY i), 0) AS b FROM d),
    x AS (SELECT symbol, trial, p * (nx / close - 1) - abs(p - b) * 0.5 / nx AS x FROM q WHERE nx IS NOT NULL)
    SELECT symbol, trial::INT AS trial, count(*) AS n, {grown("growth", "x")} FROM x GROUP BY symbol, trial""",
)
def random_baseline(spark, sf):
    got = TR.random_baseline(hourly(spark, sf), trials=20)
    return out(got, *got.columns, digits=4)


@query(
    "beats_average",
    f"""WITH {BARS}, a AS (SELECT *, avg(close) OVER {O} AS base, row_number() OVER {O} - 1 AS i FROM bars),
    g AS (SELECT symbol, i, close / first_value(close) OVER {O} AS v, base / first_value(base) OVER {O} AS b FROM a)
    SELECT symbol, round((arg_max(v, i) - arg_max(b, i)) * 100, 4) AS alpha, coalesce(min(i) FILTER (WHERE v > b), -1)::INT AS first_beat,
      sum((v > b)::INT)::BIGINT AS rows_beating, round(avg((v > b)::INT) * 100, 4) AS pct_beating FROM g GROUP BY symbol""",
)
def beats_average(spark, sf):
    b = hourly(spark, sf).withColumn("base", F.avg("close").over(W.past()))
    return out(TR.beat(b, "symbol", "ts", "close", "base"), "symbol", "alpha", "first_beat", "rows_beating", "pct_beating", digits=4)


@query(
    "episodes",
    """WITH e AS (SELECT user_id, value, (event_type = 'purchase')::INT AS d, event_id FROM events),
    k AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM e)
    SELECT user_id, e::BIGINT AS episode, round(sum(value), 4) AS total, count(*) AS length FROM k GROUP BY 1, 2 HAVING max(d) = 1""",
)
def episodes(spark, sf):
    e = read(spark, sf, "events").withColumn("d", F.col("event_type") == "purchase")
    return out(TR.episodes(e, "value", "d", "user_id", "event_id"), "user_id", "episode", "total", "length", digits=4)


PROFILE = "UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, sum(({c} IS NULL)::INT)::BIGINT AS missing, 0::BIGINT AS infinite, round(min({c}), 4) AS low, round(max({c}), 4) AS high, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS sd, sum(({c} = 0)::INT)::BIGINT AS zeros, min({c}) = max({c}) AS constant FROM lineitem "
    for c in ("l_quantity", "l_discount", "l_tax")
)


@query("data_profile", PROFILE)
def data_profile(spark, sf):
    got = TR.profile(read(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out(got, *got.columns, digits=4)


@query(
    "entry_profile",
    f"""WITH {SBARS}, u AS (SELECT (delta > 0)::INT AS e, unnest(['volume', 'close', 'delta']) AS feature, unnest([volume, close, delta]) AS x FROM bars),
    g AS (SELECT feature, avg(x) AS baseline, stddev_pop(x) AS sd, avg(x) FILTER (WHERE e = 1) AS entry_mean FROM u GROUP BY feature)
    SELECT feature, round(baseline, 5) AS baseline, round(sd, 5) AS sd, round(entry_mean, 5) AS entry_mean, round((entry_mean - baseline) / sd, 5) AS z FROM g""",
)
def entry_profile(spark, sf):
    b = hourly_signed(spark, sf).withColumn("e", (F.col("delta") > 0).cast("int"))
    return out(TR.entry_profile(b, "e", ["volume", "close", "delta"]), "feature", "baseline", "sd", "entry_mean", "z", digits=5)


@query(
    "veto_sweep",
    f"""WITH {TURNS}, u AS (SELECT pnl, unnest(['entry', 'hour']) AS feature, unnest([entry, hour(entry_ts)::DOUBLE]) AS x FROM tr),
    q AS (SELECT feature, p AS point, quantile_cont(x, p / 100.0) AS threshold FROM u, (SELECT unnest([5, 20, 80]) AS p) GROUP BY feature, p),
    j AS (SELECT q.*, u.x, u.pnl, side FROM u JOIN q USING (feature), (SELECT unnest(['<', '>']) AS side)),
    h AS (SELECT *, CASE side WHEN '<' THEN x < threshold ELSE x > threshold END AS hit FROM j)
    SELECT feature, point, side, round(threshold, 5) AS threshold, sum(hit::INT)::BIGINT AS n_vetoed, round(sum(CASE WHEN hit THEN -pnl ELSE 0 END), 4) AS saved
    FROM h GROUP BY feature, point, side, threshold""".replace("quantile_cont(x, p / 100.0)", "CASE p WHEN 5 THEN quantile_cont(x, 0.05) WHEN 20 THEN quantile_cont(x, 0.2) ELSE quantile_cont(x, 0.8) END"),
)
def veto_sweep(spark, sf):
    t = trips(spark, sf).withColumn("hour", F.hour("entry_ts"))
    got = TR.veto_sweep(t, ["entry", "hour"], "pnl", (5, 20, 80))
    return got.select("feature", "point", "side", F.round("threshold", 5).alias("threshold"), "n_vetoed", F.round("saved", 4).alias("saved"))


@query(
    "regime_segments",
    f"""WITH {BARS}, g AS (SELECT symbol, ts, close, sign(delta)::INT AS regime FROM bars), n AS (SELECT *, coalesce((regime <> lag(regime) OVER {O})::INT, 0) AS k FROM g),
    s AS (SELECT *, sum(k) OVER {O}::BIGINT AS segment FROM n)
    SELECT symbol, segment, any_value(regime) AS regime, count(*) AS n, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS growth FROM s GROUP BY symbol, segment""",
)
def regime_segments(spark, sf):
    b = hourly(spark, sf).withColumn("regime", F.signum("delta").cast("int"))
    return out(TR.regime_segments(b, "symbol", "ts", "regime", "close"), "symbol", "segment", "regime", "n", "growth")


@query("best_so_far", f"WITH {BARS} SELECT symbol, ts, max(close) OVER {O} AS best FROM bars")
def best_so_far(spark, sf):
    return TR.best_so_far(hourly(spark, sf), "close", "symbol", "ts").select("symbol", "ts", "best")


@query(
    "zigzag_waves",
    f"""WITH RECURSIVE {BARS}, i AS (SELECT *, row_number() OVER {O} AS n FROM bars),
    z AS (SELECT symbol, ts, n, close, 1 AS d, close AS e, 0 AS wave FROM i WHERE n = 1
      UNION ALL SELECT symbol, ts, n, close, CASE WHEN turn THEN -d ELSE d END, CASE WHEN turn OR d * (close - e) >= 0 THEN close ELSE e END, wave + turn::INT
      FROM (SELECT i.symbol, i.ts, i.n, i.close, z.d, z.e, z.wave, z.d * (z.e - i.close) >= 100 AS turn FROM z JOIN i ON i.symbol = z.symbol AND i.n = z.n + 1))
    SELECT symbol, ts, close, wave::BIGINT AS wave, d::INT AS direction FROM z""",
)
def zigzag_waves(spark, sf):
    return S.waves(hourly(spark, sf), 100.0).select("symbol", "ts", "close", "wave", "direction")


FOLDS = "n AS (SELECT count(*) AS n, count(*) // 5 AS s FROM events), f AS (SELECT k, k * s AS lo, CASE WHEN k = 4 THEN n ELSE (k + 1) * s END AS hi, n FROM range(5) x(k), n)"


@query(
    "purged_folds",
    f"""WITH {FOLDS}, r AS (SELECT k, 'test' AS role, lo, hi FROM f UNION ALL SELECT k, 'train', 0, lo - 1 FROM f UNION ALL SELECT k, 'train', hi + 7, n FROM f)
    SELECT k::INT AS split_id, role, lo::BIGINT AS lo, hi::BIGINT AS hi FROM r WHERE hi > lo""",
)
def purged_folds(spark, sf):
    return spark.createDataFrame(P.purged_folds(read(spark, sf, "events").count(), 5), "split_id int, role string, lo long, hi long")


@query(
    "walk_forward",
    """WITH n AS (SELECT count(*) // 3 AS s FROM events), f AS (SELECT k, (k + 1) * s AS hi, (k + 1) * s - (s * 0.2::DOUBLE)::BIGINT AS lo FROM range(3) x(k), n)
    SELECT k::INT AS split_id, 'train' AS role, 0::BIGINT AS lo, lo - 10 AS hi FROM f UNION ALL SELECT k::INT, 'test', lo, hi FROM f""".replace("(s * 0.2::DOUBLE)::BIGINT", "floor(s * 0.2::DOUBLE)::BIGINT"),
)
def walk_forward(spark, sf):
    return spark.createDataFrame(P.anchored(read(spark, sf, "events").count(), 3, 0.2, 10), "split_id int, role string, lo long, hi long")


@query(
    "bagged_splits",
    """WITH n AS (SELECT count(*) AS n, count(*) // 6 AS s FROM events), f AS (SELECT a AS fold, a * s AS lo, CASE WHEN a = 5 THEN n ELSE (a + 1) * s END AS hi FROM range(6) x(a), n),
    c AS (SELECT row_number() OVER (ORDER BY x.fold, y.fold) - 1 AS k, x.lo AS l1, x.hi AS h1, y.lo AS l2, y.hi AS h2 FROM f x, f y WHERE x.fold < y.fold),
    r AS (SELECT k, l1 AS lo, h1 AS hi FROM c UNION ALL SELECT k, l2, h2 FROM c)
    SELECT k::INT AS split_id, lo::BIGINT AS lo, hi::BIGINT AS hi, b::INT AS bag, (1943 + b)::INT AS seed FROM r, range(5) g(b)""",
)
def bagged_splits(spark, sf):
    ranges = P.cpcv_ranges(spark, read(spark, sf, "events").count(), 6, 2)
    return P.bagged(ranges.where("role = 'test'").select("split_id", "lo", "hi"))


@query(
    "purged_by_time",
    """WITH e AS (SELECT event_id, ts AS t, ts + INTERVAL 1 DAY AS t1 FROM events),
    p AS (SELECT min(t) AS a, max(t1) AS b FROM e WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-12'
      UNION ALL SELECT min(t), max(t1) FROM e WHERE t >= TIMESTAMP '2024-01-20' AND t < TIMESTAMP '2024-01-21')
    SELECT event_id, t FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE e.t1 >= a AND e.t <= b + INTERVAL 2 DAY)""",
)
def purged_by_time(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("ts").alias("t"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("t1"))
    day = F.to_date("t")
    tests = e.where(day.isin("2024-01-10", "2024-01-11", "2024-01-20")).groupBy(day.alias("d")).agg(F.min("t").alias("t"), F.max("t1").alias("t1"))
    return P.purge_by_time(e, tests.select("t", "t1"), "2 days").select("event_id", "t")


@query(
    "panel_columns",
    f"""WITH {BARS}, g AS (SELECT min(close) AS lo, max(close) AS hi FROM bars)
    SELECT symbol, ts, round((close - lo) / (hi - lo), 6) AS minmax, round(close / first_value(close) OVER {O} * 1000, 6) AS rebased,
      (volume >= 1)::INT + (volume >= 2)::INT + (volume >= 4)::INT + (volume >= 8)::INT AS tier,
      CASE WHEN delta / volume > 0.33 THEN 1 WHEN delta / volume < -0.33 THEN -1 ELSE 0 END::INT AS stance,
      round(sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smooth,
      round(close / sum(abs(close)) OVER {W20}, 6) AS l1 FROM bars, g""",
)
def panel_columns(spark, sf):
    b = PN.global_minmax(hourly(spark, sf), "close", "minmax")
    b = b.withColumn("rebased", PN.rebased("close", 1000.0)).withColumn("tier", PN.tier(F.col("volume"), (1.0, 2.0, 4.0, 8.0)))
    b = b.withColumn("stance", PN.position_of(F.col("delta") / F.col("volume"))).withColumn("smooth", PN.centred_mean("close", 10)).withColumn("l1", PN.l1_share("close", 20))
    return out(b, "symbol", "ts", "minmax", "rebased", "tier", "stance", "smooth", "l1")


@query(
    "complete_times",
    f"WITH {BARS}, k AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) >= (SELECT count(DISTINCT symbol) FROM bars)) SELECT symbol, ts, close FROM bars SEMI JOIN k USING (ts)",
)
def complete_times(spark, sf):
    return PN.complete_times(hourly(spark, sf)).select("symbol", "ts", "close")


@query(
    "active_average",
    f"""WITH {TURNS}, i AS (SELECT symbol, epoch(entry_ts)::BIGINT // 3600 AS a, epoch(exit_ts)::BIGINT // 3600 AS b, entry AS s FROM tr),
    st AS (SELECT symbol, a AS k, 1 AS d, s FROM i UNION ALL SELECT symbol, b + 1, -1, -s FROM i),
    g AS (SELECT symbol, k, sum(d) AS d, sum(s) AS s FROM st GROUP BY ALL)
    SELECT symbol, k AS "at", sum(d) OVER w::BIGINT AS active, round(CASE WHEN sum(d) OVER w > 0 THEN sum(s) OVER w / sum(d) OVER w ELSE 0 END, 4) AS average
    FROM g WINDOW w AS (PARTITION BY symbol ORDER BY k)""",
)
def active_average(spark, sf):
    hour = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 3600).cast("bigint")
    t = trips(spark, sf).select("symbol", hour("entry_ts").alias("a"), hour("exit_ts").alias("b"), "entry")
    return out(PN.active_average(t, "a", "b", "entry"), "symbol", "at", "active", "average", digits=4)


@query(
    "even_samples",
    f"""WITH {BARS}, i AS (SELECT *, row_number() OVER {O} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
    SELECT symbol, ts, close FROM i WHERE i IN (SELECT floor(k * (n - 1) / 7.0::DOUBLE)::BIGINT FROM range(8) r(k))""",
)
def even_samples(spark, sf):
    return PN.even_samples(hourly(spark, sf), 8).select("symbol", "ts", "close")


@query(
    "sma_seeded_ema",
    f"""WITH RECURSIVE {BARS}, k AS (SELECT *, row_number() OVER {O} AS n, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS m FROM bars),
    y AS (SELECT symbol, n, ts, m AS y FROM k WHERE n = 10 UNION ALL
      SELECT k.symbol, k.n, k.ts, k.close * (2::DOUBLE / 11) + (1 - 2::DOUBLE / 11) * y.y FROM y JOIN k ON k.symbol = y.symbol AND k.n = y.n + 1)
    SELECT k.symbol, k.ts, round(y.y, 5) AS y FROM k LEFT JOIN y USING (symbol, n)""",
)
def sma_seeded_ema(spark, sf):
    return out(PN.sma_seeded_ema(hourly(spark, sf), "close", 10, "y"), "symbol", "ts", "y", digits=5)


@query(
    "running_return",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, sqrt(value) AS r, row_number() OVER w AS n, coalesce(lag((event_type = 'purchase')::INT) OVER w, 0) AS d
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT user_id, event_id, n, r AS g FROM s WHERE n = 1
      UNION ALL SELECT s.user_id, s.event_id, s.n, s.r + 0.99 * (1 - s.d) * g.g FROM g JOIN s ON s.user_id = g.user_id AND s.n = g.n + 1)
    SELECT user_id, event_id, round(g, 5) AS g FROM g""",
)
def running_return(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", F.sqrt("value").alias("r"), (F.col("event_type") == "purchase").alias("d"))
    return out(PN.running_return(e, "r", "d", "g", key="user_id", on="event_id"), "user_id", "event_id", "g", digits=5)


@query(
    "wins_by_config",
    """WITH p AS (SELECT o_orderdate::DATE AS d, o_orderpriority AS c, max(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT c, count(*) AS wins FROM (SELECT d, c FROM p QUALIFY row_number() OVER (PARTITION BY d ORDER BY v DESC, c) = 1) GROUP BY c""",
)
def wins_by_config(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("c")).agg(F.max("o_totalprice").alias("v"))
    return PN.wins_by(o, "d", "c", "v")


@query(
    "vetoed_entries",
    f"""WITH {BARS}, o AS (SELECT symbol, ts, sign(delta)::INT AS target, volume, close, coalesce(lag(sign(delta)) OVER {O}, 0)::INT AS held FROM bars)
    SELECT symbol, ts, CASE WHEN held = 0 AND target <> 0 AND (volume < 2 OR close > 400) THEN 0 ELSE target END::INT AS target FROM o""",
)
def vetoed_entries(spark, sf):
    b = hourly(spark, sf).withColumn("target", F.signum("delta").cast("int"))
    b = b.withColumn("held", F.coalesce(F.lag("target").over(W.order()), F.lit(0)))
    return rules.vetoed(b, "volume < 2, close > 400", "held", "target").select("symbol", "ts", "target")


@query(
    "runs_of_cuts",
    f"""WITH {EDGES}, q AS (SELECT unnest(range(2, 6)) AS run)
    SELECT run::INT AS run, sum(CASE WHEN src % run <> dst % run THEN w ELSE 0 END) AS cut FROM e, q GROUP BY run""",
)
def runs_of_cuts(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    labels = nodes.withColumn("run", F.explode(F.sequence(F.lit(2), F.lit(5)))).withColumn("label", F.col("node") % F.col("run"))
    return G.scores_by_run(e, labels)


@query(
    "partition_value",
    f"""WITH {EDGES}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS (SELECT node, row_number() OVER (ORDER BY node) % 2 AS l FROM v)
    SELECT CASE WHEN (SELECT 2 * sum((l = 0)::INT) = count(*) FROM l) THEN -sum(CASE WHEN a.l <> b.l THEN w ELSE 0 END) ELSE '-inf'::DOUBLE END AS value
    FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst""",
)
def partition_value(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    numbered = P.runs(nodes, "node")
    return G.partition_value(e, numbered.select("node", ((F.col("start") + 1) % 2).alias("label")))


@query(
    "set_cover",
    """WITH s AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS i FROM lineitem WHERE l_orderkey % 50 = 0)
    SELECT count(DISTINCT id) AS n_sets, count(DISTINCT i) / (SELECT count(*) FROM supplier) AS ratio FROM s""",
)
def set_cover(spark, sf):
    """Orders as sets of suppliers; those whose key is divisible by 50 are the chosen cover."""
    li = read(spark, sf, "lineitem")
    sets = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("items"))
    chosen = li.where(F.col("l_orderkey") % 50 == 0).select(F.col("l_orderkey").alias("id"))
    return G.set_cover(sets, chosen, read(spark, sf, "supplier").count())
