"""Evaluation of strategies: significance of Sharpe ratios, overfitting summaries, running
moments, stability of training logs, gates, turbulence, fixed-hold trades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar

from .machines import slice_cuts
from .recurrence import affine_scan
from .splits import runs
from .stats import sharpe, sortino
from .windows import last, order


def bias_corrected(x: Column) -> tuple[Column, Column]:
    """Skewness and kurtosis (not in excess) of a sample; aggregates."""
    n = F.count(x)
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6) + 3


def psr_from_returns(returns: DataFrame, r: str = "r", key: str = "symbol", free: float = 0.0, target: float = 0.0) -> DataFrame:
    """(key, n, sharpe, psr): probabilistic Sharpe ratio of each strategy's returns, neither
    annualised; null below 4 returns."""
    x = F.col(r)
    skew, kurt = bias_corrected(x)
    got = returns.groupBy(key).agg(F.count(x).alias("n"), sharpe(x, "iid", 1.0, free).alias("sharpe"), skew.alias("_s"), kurt.alias("_k"))
    psr = scalar.psr_of(F.col("sharpe"), F.col("n"), F.col("_s"), F.col("_k"), target)
    return got.select(key, "n", "sharpe", F.when(F.col("n") > 3, psr).alias("psr"))


def deflated(returns: DataFrame, variant: str = "trials", r: str = "r", key: str = "symbol") -> DataFrame:
    """One row: the best strategy's Sharpe ratio deflated by the number of strategies and the
    deviation of their ratios (ties: the smaller key). trials: population moments, expected
    maximum 1 below 5 strategies; runner: the small-sample quantile there; approx: the
    deviation is taken as ratio / sqrt(2 n), 0.1 for one strategy, with bias-corrected
    moments. .5 where the spread vanishes. The strategies are counted first."""
    x = F.col(r)
    skew, kurt = bias_corrected(x) if variant == "approx" else (F.skewness(x), F.kurtosis(x) + 3)
    table = returns.groupBy(key).agg(F.count(x).alias("t"), sharpe(x, "iid", 1.0).alias("sharpe"), skew.alias("skew"), kurt.alias("kurtosis"))
    n = returns.select(key).distinct().count()
    most = {"trials": scalar.expected_max(n) if n >= 5 else 1.0, "runner": scalar.expected_max_small(n), "approx": scalar.expected_max(max(n, 2))}[variant]
    best = table.agg(F.max_by(F.struct(key, "t", "sharpe", "skew", "kurtosis"), F.struct("sharpe")).alias("b"), F.stddev_samp("sharpe").alias("sd"), F.max("sharpe").alias("_m"))
    ties = table.join(F.broadcast(best.select("_m", "sd")), F.col("sharpe") == F.col("_m")).agg(F.min_by(F.struct(key, "t", "sharpe", "skew", "kurtosis"), key).alias("b"), F.first("sd").alias("sd"))
    sd = (F.col("b.sharpe") / (2 * n) ** 0.5 if n > 1 else F.lit(0.1)) if variant == "approx" else F.col("sd")
    target = sd * most
    dsr = scalar.psr_of(F.col("b.sharpe"), F.col("b.t"), F.col("b.skew"), F.col("b.kurtosis"), target, 0.5)
    return ties.select(F.col(f"b.{key}").alias("best"), F.col("b.t").alias("t"), F.lit(n).alias("n"), F.col("b.sharpe").alias("sharpe"), target.alias("target"), dsr.alias("dsr"))


def screened(returns: DataFrame, least: float = 1e-10, r: str = "r", key: str = "symbol") -> DataFrame:
    """Returns of the strategies whose deviation reaches `least`."""
    keep = returns.groupBy(key).agg(F.stddev_samp(r).alias("_d")).where(F.col("_d") >= least).select(key)
    return returns.join(keep, key, "left_semi")


def overfitting(combos: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row of stats.pbo's combinations: pbo, its band (0 below .3, 1 below .5, 2 below .7,
    3), slope, intercept and r2 of out-of-sample on in-sample ratios, p_below: how often the
    chosen strategy falls below `threshold` out of sample."""
    p = F.avg((F.col("logit") <= 0).cast("double"))
    y, x = F.col("oos_sr"), F.col("is_sr")
    got = combos.agg(p.alias("pbo"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.avg((y < threshold).cast("double")).alias("p_below"))
    band = sum(((F.col("pbo") >= c).cast("int") for c in (0.5, 0.7)), (F.col("pbo") >= 0.3).cast("int"))
    return got.withColumn("band", band)


def report(returns: DataFrame, r: str = "r", key: str = "symbol", on: str = "ts", factor: float = 252.0) -> DataFrame:
    """(key, n, sharpe, sortino, calmar, total, max_drawdown, psr) of simple returns. The curve's
    peak starts at its first value, after the first return; sortino is 0 without any spread of
    losses, calmar (mean times factor over the greatest drawdown) 0 without a drawdown."""
    w = Window.partitionBy(key).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(r)
    df = returns.withColumn("_e", F.sum(F.log1p(x)).over(w)).withColumn("_d", F.exp(F.col("_e") - F.max("_e").over(w)) - 1)
    got = df.groupBy(key).agg(sharpe(x, "iid", factor).alias("sharpe"), F.coalesce(sortino(x, "pipeline"), F.lit(0.0)).alias("sortino"), F.coalesce(F.try_divide(F.avg(x) * factor, F.abs(F.min("_d"))), F.lit(0.0)).alias("calmar"), F.expm1(F.sum(F.log1p(x))).alias("total"), F.min("_d").alias("max_drawdown"))
    return got.join(psr_from_returns(returns, r, key).select(key, "n", "psr"), key)


def rolling_sharpe(r: Column, n: int, least: int, factor: float = 1.0) -> Column:
    """Mean over sample deviation of the last n rows; null with fewer than `least`."""
    full = F.count(r).over(last(n)) >= least
    return F.when(full, F.try_divide(F.avg(r).over(last(n)), F.stddev_samp(r).over(last(n))) * factor**0.5)


def non_iid_factor(returns: DataFrame, q: int, r: str = "r", key: str = "symbol", on: str = "ts") -> DataFrame:
    """(key, n, factor, statistic): Lo's factor q / sqrt(q + 2 sum (q - k) rho_k) over lags
    1..q - 2, and the Ljung-Box statistic of lags 1..q - 1. Each row meets only the q rows
    before it."""
    w = Window.partitionBy(key)
    df = returns.withColumn("_x", F.col(r) - F.avg(r).over(w))
    o = w.orderBy(on)
    lagged = df.withColumn("_y", F.array(*[F.lag("_x", k).over(o) for k in range(q)])).select(key, "_x", F.posexplode("_y").alias("k", "_y"))
    cov = lagged.groupBy(key, "k").agg(F.sum(F.col("_x") * F.col("_y")).alias("c"))
    n = df.groupBy(key).agg(F.count("_x").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("c0"))
    rho = F.col("c") / F.col("c0")
    k = F.col("k")
    got = cov.join(n, key).where("k > 0").groupBy(key, "n").agg(F.sum(F.when(k <= q - 2, (q - k) * rho).otherwise(0.0)).alias("_t"), (F.first("n") * (F.first("n") + 2) * F.sum(rho * rho / (F.col("n") - k))).alias("statistic"))
    return got.select(key, "n", (q / F.sqrt(q + 2 * F.col("_t"))).alias("factor"), "statistic")


def differential(df: DataFrame, r: str = "r", downside: bool = False, eta: float = 0.005, key: str = "symbol", on: str = "ts") -> DataFrame:
    """Adds reward: the differential Sharpe ratio (downside: Sortino) of each return against
    exponential first and second moments A and B of those before it, both from 0."""
    w = Window.partitionBy(key).orderBy(on)
    x = F.col(r)
    square = F.when(x < 0, x * x).otherwise(0.0) if downside else x * x
    df = df.withColumn("_q", square).withColumn("_k", F.lit(1 - eta))
    cuts = slice_cuts(df, on)
    for out, b in (("_m1", x), ("_m2", F.col("_q"))):
        df = affine_scan(df.withColumn("_b", b * eta), "_k", "_b", out, key=key, order=on, cuts=cuts).drop("_b")
    a, b = (F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in ("_m1", "_m2"))
    df = df.withColumn("_a", a).withColumn("_b", b)
    a, b = F.col("_a"), F.col("_b")
    spread = b if downside else b - a * a
    gain = (b * (x - a) - 0.5 * a * (F.col("_q") - b)) / F.pow(F.greatest(spread, F.lit(1e-300)), F.lit(1.5))
    return df.withColumn("reward", F.when(spread > 1e-12, gain).otherwise(0.0)).drop("_q", "_k", "_m1", "_m2", "_a", "_b")


def running_moments(df: DataFrame, columns: list[str], prior: float = 1e-4) -> DataFrame:
    """One row of mean and population variance a column, merged with a prior of `prior`
    observations of mean 0 and variance 1: what merging batch by batch comes to."""
    n, p = F.count(F.lit(1)).cast("double"), F.lit(prior)
    both = [(F.avg(c) * n / (n + p), (p + F.var_pop(c) * n + F.avg(c) * F.avg(c) * n * p / (n + p)) / (n + p)) for c in columns]
    return df.agg(*[x.alias(f"{k}_{c}") for c, (m, v) in zip(columns, both, strict=True) for k, x in (("mean", m), ("var", v))])


def normalised(df: DataFrame, columns: list[str], limit: float = 10.0, scale_only: bool = False) -> DataFrame:
    """Columns by running moments, clipped to +-limit; scale_only leaves the mean in."""
    stats = running_moments(df, columns)
    joined = df.crossJoin(F.broadcast(stats))  # a single row
    z = lambda c: (F.col(c) - (0.0 if scale_only else F.col(f"mean_{c}"))) / F.sqrt(F.col(f"var_{c}") + 1e-8)
    return joined.select(*[scalar.clip(z(c), -limit, limit).alias(c) if c in columns else F.col(c) for c in df.columns])


def stability(log: DataFrame, x: str, key: str = "symbol", on: str = "step") -> DataFrame:
    """(key, n, final, best, late_sd, overshoot, convergence, reduction, trend) of a training
    log: deviation and slope (over steps scaled to 0..1) of the last fifth, fall from the
    peak, share of steps until nine tenths of the rise, late over early mean (tenths). Logs
    of fewer than 5 rows go."""
    w = Window.partitionBy(key)
    df = log.withColumn("_i", F.row_number().over(w.orderBy(on)) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 5")
    tail, v, s = F.col("_i") >= F.floor(F.col("_n") * 0.8), F.col(x), F.col(on)
    df = df.withColumn("_f", F.first(x).over(w.orderBy(on))).withColumn("_b", F.max(x).over(w))
    df = df.withColumn("_lo", F.min(F.when(tail, s)).over(w)).withColumn("_hi", F.max(s).over(w))
    t = (s - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    reached = v >= F.col("_f") + 0.9 * (F.col("_b") - F.col("_f"))
    early = F.avg(F.when(F.col("_i") < F.greatest(F.floor(F.col("_n") * 0.1), F.lit(1)), v))
    late = F.avg(F.when(F.col("_i") >= F.floor(F.col("_n") * 0.9), v))
    final, best = F.max_by(x, on), F.max(x)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        final.alias("final"),
        best.alias("best"),
        F.stddev_pop(F.when(tail, v)).alias("late_sd"),
        F.when(best > 1e-8, (best - final) / best).otherwise(0.0).alias("overshoot"),
        F.coalesce(F.min(F.when(reached, s)) / F.max(s), F.lit(1.0)).alias("convergence"),
        F.when(F.abs(early) > 1e-8, late / early).alias("reduction"),
        F.when(F.count(F.when(tail, v)) > 2, F.regr_slope(F.when(tail, v), t)).otherwise(0.0).alias("trend"),
    )


def gate_sweep(trades: DataFrame, value: str, pnl: str, points: tuple = (5, 10, 15, 20, 25, 30, 40, 50)) -> DataFrame:
    """(point, threshold, kept, wins, losses, win_rate, net, lost_wins, avoided_losses): trades
    whose value reaches each percentile of it. Every trade meets the few thresholds once."""
    stats = trades.agg(F.percentile(value, F.array(*[F.lit(p / 100) for p in points])).alias("_t"))
    zipped = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("p"), F.col("_t").alias("t")))
    df = trades.select(F.col(value).alias("v"), F.col(pnl).alias("g")).crossJoin(F.broadcast(stats)).select("v", "g", zipped.alias("z"))
    keep, win = F.col("v") >= F.col("z.t"), F.col("g") > 0
    n = lambda c: F.sum(c.cast("long"))
    money = lambda c: F.sum(F.when(c, F.col("g")).otherwise(0.0))
    wins, losses = n(keep & win), n(keep & ~win)
    return df.groupBy(F.col("z.p").alias("point"), F.col("z.t").alias("threshold")).agg(n(keep).alias("kept"), wins.alias("wins"), losses.alias("losses"), (wins / F.greatest(wins + losses, F.lit(1)) * 100).alias("win_rate"), money(keep).alias("net"), money(~keep & win).alias("lost_wins"), money(~keep & ~win).alias("avoided_losses"))


def cohens_d(value: str, pnl: str) -> Column:
    """Distance of winners' and losers' mean values in pooled population deviations."""
    a, b = F.when(F.col(pnl) > 0, F.col(value)), F.when(F.col(pnl) <= 0, F.col(value))
    return (F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2 + 1e-8)


def log_metrics(log: DataFrame, key: str, on: str, realised: str = "realised", equity: str = "equity") -> DataFrame:
    """(key, bars, trades, round_trips, win_rate, total, max_drawdown) of a trade log."""
    w = Window.partitionBy(key).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    df = log.withColumn("_d", F.col(equity) - F.max(equity).over(w))
    win, loss = F.sum((F.col(realised) > 0).cast("long")), F.sum((F.col(realised) < 0).cast("long"))
    return df.groupBy(key).agg(F.max(on).alias("bars"), F.count(F.lit(1)).alias("trades"), (win + loss).alias("round_trips"), (win / F.greatest(win + loss, F.lit(1)) * 100).alias("win_rate"), F.sum(realised).alias("total"), F.min("_d").alias("max_drawdown"))


def compared(actual: DataFrame, replay: DataFrame, key: str, tolerances: dict[str, float], zeros: float = 0.0) -> DataFrame:
    """(key, name, actual, replay, diff_pct, passed): two metric tables against relative
    tolerances; both 0 is a difference of `zeros` (NaN: an undefined one, which doesn't pass), 0
    against anything else an infinite one. Null keys meet."""
    long = lambda d, out: d.select(key, *[F.col(c).cast("double").alias(c) for c in tolerances]).unpivot([key], list(tolerances), "name", out)
    a, b = F.col("actual"), F.col("replay")
    diff = F.when((a == 0) & (b == 0), zeros).when(a == 0, float("inf")).otherwise(F.abs(b - a) / F.abs(F.when(a != 0, a)))
    most = F.create_map(*[F.lit(x) for kv in tolerances.items() for x in kv])[F.col("name")]
    other = long(replay, "replay").withColumnsRenamed({key: "_k", "name": "_n"})
    both = long(actual, "actual").join(other, F.col(key).eqNullSafe(F.col("_k")) & (F.col("name") == F.col("_n")))
    return both.select(key, "name", "actual", "replay", (diff * 100).alias("diff_pct"), (diff <= most).alias("passed"))


def turbulence(panel: DataFrame, assets: list[str], n: int = 252, on: str = "ts") -> DataFrame:
    """(on, turbulence): squared Mahalanobis distance of a time's simple returns from those of
    the n times before; 0 on the first n times, and for the first two positive values. panel:
    one row a time, one price column an asset. Times are numbered and dealt to blocks of n
    with the n times before them, so that a task holds 2 n + 1 rows; assets with more missing
    returns than the longest known one are left out of a time."""
    kind = dict(panel.dtypes)[on]
    at = F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(on)
    panel = panel.select(on, *assets, at.alias("_t"))
    df = panel.join(runs(panel.select("_t"), "_t").select("_t", F.col("start").alias("_i")), "_t").drop("_t")
    # A block's first window needs the n returns before it, so n + 1 earlier prices.
    block = F.explode(F.array_distinct(F.transform(F.array(F.lit(0), F.lit(n), F.lit(n + 1)), lambda k: F.floor((F.col("_i") + k) / n))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        block = int(pdf["_b"].iloc[0])
        at, prices = pdf["_i"].to_numpy(), pdf[assets].to_numpy(float)
        moves = np.vstack([np.full((1, len(assets)), np.nan), prices[1:] / prices[:-1] - 1])
        out = np.zeros(len(pdf))
        for j in np.flatnonzero((at // n == block) & (at >= n)):
            past = moves[j - n : j]
            past = past[np.isnan(past).sum(axis=0).min() :]
            known = ~np.isnan(past).any(axis=0)
            if known.any():
                past = past[:, known]
                away = moves[j, known] - past.mean(axis=0)
                value = away @ np.linalg.pinv(np.atleast_2d(np.cov(past, rowvar=False))) @ away
                out[j] = value if value > 0 else 0.0
        mine = at // n == block
        return pd.DataFrame({on: pdf[on].to_numpy()[mine], "turbulence": out[mine]})

    got = df.withColumn("_b", block).groupBy("_b").applyInPandas(run, f"{on} {kind}, turbulence double")
    early = got.where("turbulence > 0").orderBy(on).limit(2).select(on, F.lit(True).alias("_early"))
    return got.join(F.broadcast(early), on, "left").select(on, F.when(F.col("_early"), 0.0).otherwise(F.col("turbulence")).alias("turbulence"))


def fixed_hold(signals: DataFrame, hold: int = 10, signal: str = "signal", price: str = "close", key: str = "symbol", on: str = "ts") -> DataFrame:
    """(key, entry_ts, exit_ts, side, entry, exit, pnl): enters on a signal when flat, leaves
    `hold` rows later, and may enter again on the row after. Exits are looked up by windows;
    only the rows with a signal go through the greedy choice."""
    w = Window.partitionBy(key).orderBy(on)
    df = signals.select(key, F.col(on).alias("entry_ts"), F.lead(on, hold).over(w).alias("exit_ts"), F.col(signal).cast("int").alias("side"), F.col(price).cast("double").alias("entry"), F.lead(price, hold).over(w).cast("double").alias("exit"), F.row_number().over(w).alias("_i"))
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        at, keep, j = pdf["_i"].to_numpy(), [], 0
        while j < len(at):
            keep.append(j)
            j = int(np.searchsorted(at, at[j] + hold + 1))
        return pdf.iloc[keep].drop(columns="_i")

    fields = ", ".join(f"{c} {kinds[c]}" for c in (key, "entry_ts", "exit_ts", "side", "entry", "exit"))
    got = df.where(F.col("side") != 0).groupBy(key).applyInPandas(run, fields).where(F.col("exit_ts").isNotNull())
    return got.withColumn("pnl", (F.col("exit") - F.col("entry")) * F.col("side"))


def effort_score(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds effort: .6 of the bounded gap of a fast (span n) and a slow (span 3 n) mean of the
    running delta, scaled by its mean size after the first n rows, and .4 of the delta over
    the mean volume, within +-1. The scale takes the symbol's whole history."""
    from .recurrence import ema

    df = bars.withColumn("_c", F.sum("delta").over(order().rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    cuts = slice_cuts(bars, "ts")
    df = ema(ema(df, "_c", n, "_f", cuts=cuts), "_c", 3 * n, "_s", cuts=cuts).withColumn("_g", F.col("_f") - F.col("_s")).withColumn("_i", F.row_number().over(order()))
    scale = F.avg(F.when(F.col("_i") > n, F.abs("_g"))).over(Window.partitionBy("symbol")) + 1e-9
    mean = F.avg("volume").over(last(n))
    push = scalar.clip(F.when(mean > 0, F.try_divide(F.col("delta"), mean)).otherwise(0.0), -1.0, 1.0)
    return df.withColumn("effort", 0.6 * F.tanh(F.col("_g") / scale) + 0.4 * push).drop("_c", "_f", "_s", "_g", "_i")


def emphasised(x: str, n: int = 5, multiplier: float = 1.0) -> Column:
    """Size in per cent of the distance from the rolling mean, times a multiplier, rounded half
    to even at two digits."""
    mean = F.avg(x).over(last(n))
    return F.bround(F.abs((F.col(x) / F.when(mean == 0, 1.0).otherwise(mean) * 100 - 100) * multiplier), 2)


def kijun_gap(x: str = "close", n: int = 26) -> Column:
    """Distance from the middle of the last n rows' range; null on the first n - 1 rows."""
    full = F.count(x).over(last(n)) == n
    return F.when(full, F.col(x) - (F.max(x).over(last(n)) + F.min(x).over(last(n))) / 2)


def bollinger(x: str = "close", n: int = 20, width: float = 2.0) -> tuple[Column, Column]:
    """Upper and lower band about the rolling mean, sample deviation."""
    mean, sd = F.avg(x).over(last(n)), F.stddev_samp(x).over(last(n))
    return mean + width * sd, mean - width * sd
