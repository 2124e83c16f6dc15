"""Return statistics and overfitting measures, grouped by strategy."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharpe(r: Column, variant: str = "iid", factor: float = 252.0, bench: float = 0.0) -> Column:
    """iid: mean / sample deviation; pbo: the same, deviation floored at 1e-10; eval: mean /
    (population deviation + 1e-8); agents: iid, 0 below a deviation of 1e-10; adjusted: iid
    corrected by bias-corrected skewness and excess kurtosis; bars: log returns, population
    deviation, times the root of their number (320,000 at most) in place of the factor.
    All others times the root of factor. Aggregates."""
    x, root = r - F.lit(bench), factor**0.5
    if variant == "iid":
        return F.try_divide(F.avg(x), F.stddev_samp(x)) * root
    if variant == "pbo":
        return F.avg(x) / F.greatest(F.stddev_samp(x), F.lit(1e-10)) * root
    if variant == "eval":
        return F.avg(x) / (F.stddev_pop(x) + 1e-8) * root
    if variant == "agents":
        return F.when(F.stddev_samp(x) < 1e-10, 0.0).otherwise(F.try_divide(F.avg(x), F.stddev_samp(x)) * root)
    if variant == "adjusted":
        n, sr = F.count(x), F.try_divide(F.avg(x), F.stddev_samp(x))
        skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
        return sr * (1 + skew / 6 * sr + kurt / 24 * sr * sr) * root
    if variant == "bars":
        g = F.log1p(x)
        return F.when(F.stddev_pop(g) > 1e-12, F.avg(g) / F.stddev_pop(g) * F.sqrt(F.least(F.count(g), F.lit(320_000)))).otherwise(0.0)
    raise ValueError("variant: iid, pbo, eval, agents, adjusted or bars")


def lpm(r: Column, target: float, order: int) -> Column:
    """Lower partial moment."""
    return F.avg(F.pow(F.greatest(F.lit(target) - r, F.lit(0.0)), F.lit(order)))


def sortino(r: Column, variant: str = "lpm", target: float = 0.0, factor: float = 1.0) -> Column:
    """lpm: mean excess / root of LPM2; pbo: mean / sample deviation of returns clipped at
    0; eval: mean / population deviation of negative returns."""
    root = factor**0.5
    if variant == "lpm":
        return F.try_divide(F.avg(r - target), F.sqrt(lpm(r, target, 2))) * root
    if variant == "pbo":
        return F.avg(r) / F.greatest(F.stddev_samp(F.least(r, F.lit(0.0))), F.lit(1e-10)) * root
    if variant == "eval":
        return F.avg(r) / (F.stddev_pop(F.when(r < 0, r)) + 1e-8) * root
    if variant == "pipeline":
        return F.try_divide(F.avg(r), F.stddev_pop(F.when(r < 0, r)))
    if variant == "bars":
        g = F.log1p(r)
        down = F.coalesce(F.sqrt(F.avg(F.when(g < 0, g * g))), F.lit(1e-12))
        return F.try_divide(F.avg(g), down) * F.sqrt(F.least(F.count(g), F.lit(320_000)))
    raise ValueError("variant: lpm, pbo, eval, pipeline or bars")


def annual_geometric(r: Column, factor: float = 252.0) -> Column:
    """Growth a year of log returns."""
    return F.pow(F.exp(F.sum(r)), F.lit(factor) / F.count(r)) - 1


def annualized(total: Column, days: Column, factor: float = 252.0, log: bool = False) -> Column:
    """A total growth (1.5 for half more) or, with log, a total log return, a year."""
    return total / (days / factor) if log else F.pow(total, F.lit(1.0) / (days / factor)) - 1


def calmar(returns: DataFrame, r: str = "r", key: str = "symbol", on: str = "ts", factor: float = 252.0) -> DataFrame:
    """(key, annual, max_drawdown, calmar, calmar_mean) of simple returns: growth a year, and
    factor * mean, over the largest drawdown of the equity."""
    curve = equity_drawdown(returns, r, key, on)
    got = curve.groupBy(key).agg((F.pow(F.max_by("equity", on), F.lit(factor) / F.count(r)) - 1).alias("annual"), F.min("drawdown").alias("max_drawdown"), (F.avg(r) * factor).alias("_m"))
    depth = F.abs("max_drawdown")
    return got.select(key, "annual", "max_drawdown", F.try_divide(F.col("annual"), depth).alias("calmar"), F.try_divide(F.col("_m"), depth).alias("calmar_mean"))


def dominance(returns: DataFrame, chosen: Column, points: int = 100, r: str = "r") -> DataFrame:
    """Second-order stochastic dominance: (i, x, chosen, other, gap) on a grid from the least
    to the largest return: both empirical distributions and the running sum of their
    difference times the step. Returns fall into grid cells first, so that no row meets the
    grid."""
    low, high = returns.agg(F.min(r), F.max(r)).first()
    spark, step = returns.sparkSession, ((high or 0.0) - (low or 0.0)) / (points - 1)
    cell = F.least(F.ceil((F.col(r) - F.lit(low)) / F.lit(step or 1.0)).cast("int"), F.lit(points - 1))
    cells = returns.select(cell.alias("i"), chosen.cast("int").alias("c")).groupBy("i").agg(F.sum("c").alias("a"), F.sum(1 - F.col("c")).alias("b"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("i"), (F.lit(low) + F.col("id") * F.lit(step)).alias("x")).join(cells, "i", "left")
    w, all_ = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(w), F.lit(0)), F.sum(c).over(all_))
    got = grid.select("i", "x", share("a").alias("chosen"), share("b").alias("other"))
    return got.withColumn("gap", F.sum((F.col("other") - F.col("chosen")) * F.lit(step)).over(w))


def omega(r: Column, target: float = 0.0) -> Column:
    """Gains over losses about the target: 1 + mean excess / LPM1."""
    return F.try_divide(F.avg(r - target), lpm(r, target, 1)) + 1


def kappa(r: Column, target: float = 0.0, order: int = 3) -> Column:
    return F.try_divide(F.avg(r - target), F.pow(lpm(r, target, order), F.lit(1.0 / order)))


def tail_ratio(r: Column, p: float = 0.05) -> Column:
    return F.abs(F.try_divide(F.percentile(r, 1 - p), F.percentile(r, p)))


def gmean(r: Column) -> Column:
    return F.exp(F.avg(F.log1p(r))) - 1


def summary(returns: DataFrame, r: str = "r", key: str = "symbol") -> DataFrame:
    """One row a strategy: moments, ratios, tails."""
    x = F.col(r)
    return returns.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), sharpe(x).alias("sharpe"), sharpe(x, "eval").alias("sharpe_eval"), sortino(x).alias("sortino"), omega(x).alias("omega"), kappa(x).alias("kappa3"), tail_ratio(x).alias("tail_ratio"), gmean(x).alias("gmean"))


def equity_drawdown(returns: DataFrame, r: str = "r", key: str = "symbol", on: str = "ts") -> DataFrame:
    """Equity, its drawdown, by row. The product as a sum of logarithms."""
    w = Window.partitionBy(key).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("equity", F.exp(F.sum(F.log1p(F.col(r))).over(w)))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def pbo(returns: DataFrame, chunks: int = 8, r: str = "r", key: str = "symbol", on: str = "t") -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    returns: (strategy, t from 0 without gaps, r). The first T mod chunks rows go. Per
    strategy and chunk only (n, mean, squares about the mean) is kept, by partial aggregation;
    the combinations, C(chunks, chunks / 2) of them, join those, so that the cost doesn't depend
    on T. Returns (combo, best strategy in sample, omega, logit); PBO is the share of
    logits <= 0.
    """
    spark = returns.sparkSession
    total = returns.agg((F.max(on) + 1).alias("t")).first()["t"] or 0
    skip, size = total % chunks, max(1, total // chunks)
    chunk = F.floor((F.col(on) - skip) / size).cast("int").alias("c")
    base = returns.where(F.col(on) >= skip).groupBy(key, chunk).agg(F.count(r).alias("n"), F.avg(r).alias("m"), (F.var_pop(r) * F.count(r)).alias("q"))
    combos = [(k, c, int(c in chosen)) for k, chosen in enumerate(combinations(range(chunks), chunks // 2)) for c in range(chunks)]
    joined = base.join(F.broadcast(spark.createDataFrame(combos, "combo int, c int, inside int")), "c")
    s = F.col("n") * F.col("m")
    part = joined.groupBy("combo", key, "inside").agg(F.sum("n").alias("n"), F.sum(s).alias("s"), F.sum(F.col("q") + s * F.col("m")).alias("q"))
    part = part.withColumn("m", F.col("s") / F.col("n"))
    var = (F.col("q") - F.col("s") * F.col("m")) / (F.col("n") - 1)
    part = part.withColumn("sr", F.col("m") / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(1e-10)))
    both = part.groupBy("combo", key).agg(F.max(F.when(F.col("inside") == 1, F.col("sr"))).alias("is_sr"), F.max(F.when(F.col("inside") == 0, F.col("sr"))).alias("oos_sr"))
    by = Window.partitionBy("combo")
    ties = Window.partitionBy("combo", "oos_sr")
    ranked = both.withColumn("rank", F.rank().over(by.orderBy("oos_sr")) + (F.count(F.lit(1)).over(ties) - 1) / 2).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("first", F.row_number().over(by.orderBy(F.desc("is_sr"), key)))
    best = ranked.where("first = 1").withColumn("omega", F.col("rank") / (F.col("n") + 1))
    return best.select("combo", F.col(key).alias("best"), "is_sr", "oos_sr", "omega", F.ln(F.col("omega") / (1 - F.col("omega"))).alias("logit"))
