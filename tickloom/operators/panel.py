"""Panels and sequences: normalising, completeness, sampling, active sizes, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recurrence import affine_scan
from .windows import last, order, past, position


def tier(x: Column, cuts: tuple[float, float, float, float]) -> Column:
    """0-4: how many of four ascending thresholds x has reached."""
    return sum(((x >= c).cast("int") for c in cuts[1:]), (x >= cuts[0]).cast("int"))


def global_minmax(df: DataFrame, x: str, out: str) -> DataFrame:
    """(x - min) / (max - min) over the whole table, 0 where that range is below 1e-10: one
    aggregation, joined as a single row; it looks ahead."""
    stats = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span < 1e-10, 0.0).otherwise(F.try_divide(F.col(x) - F.col("_lo"), span))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, value).drop("_lo", "_hi")


def complete_times(df: DataFrame, on: str = "ts", key: str = "symbol") -> DataFrame:
    """Rows of times at which every key of the table is present."""
    n = df.agg(F.countDistinct(key).alias("_k"))
    full = df.groupBy(on).agg(F.countDistinct(key).alias("_n")).crossJoin(F.broadcast(n)).where(F.col("_n") >= F.col("_k")).select(on)
    return df.join(full, on, "left_semi")


def rebased(x: str, amount: float = 1.0) -> Column:
    """A curve as a multiple of its first value, times an amount."""
    return F.col(x) / F.first(x).over(past()) * amount


def position_of(action: Column, dead: float = 0.33) -> Column:
    """-1, 0 or 1: a continuous action's sign outside the dead band."""
    return F.when(action > dead, 1).when(action < -dead, -1).otherwise(0)


def active_average(intervals: DataFrame, start: str, end: str, size: str, key: str = "symbol") -> DataFrame:
    """(key, at, active, average): from each change on, how many closed intervals are open
    and their mean size (0 if none): ends as events and two prefix sums, no interval join."""
    opens = intervals.select(key, F.col(start).alias("at"), F.lit(1).alias("d"), F.col(size).alias("s"))
    closes = intervals.select(key, (F.col(end) + 1).alias("at"), F.lit(-1).alias("d"), (-F.col(size)).alias("s"))
    steps = opens.unionAll(closes).groupBy(key, "at").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    w = Window.partitionBy(key).orderBy("at")
    active = F.sum("d").over(w)
    return steps.select(key, "at", active.alias("active"), F.when(active > 0, F.sum("s").over(w) / active).otherwise(0.0).alias("average"))


def even_samples(df: DataFrame, n: int, key: str = "symbol", on: str = "ts") -> DataFrame:
    """n evenly spaced rows of each key, the first and the last among them (all, if fewer)."""
    w = Window.partitionBy(key)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(on)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1)).cast("int"))
    return df.where(F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def centred_mean(x: str, n: int) -> Column:
    """Mean over n rows about each row; rows beyond the ends count as 0."""
    after = (n - 1) // 2
    return F.sum(x).over(order().rowsBetween(-(n - 1 - after), after)) / n


def l1_share(x: str, n: int) -> Column:
    return F.try_divide(F.col(x), F.sum(F.abs(F.col(x))).over(last(n)))


def sma_seeded_ema(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Exponential mean that starts on row n from the mean of the first n; null before."""
    alpha = 2 / (n + 1)
    df = df.withColumn("_i", position()).withColumn("_m", F.avg(x).over(last(n)))
    a = F.when(F.col("_i") <= n, 0.0).otherwise(1 - alpha)
    b = F.when(F.col("_i") <= n, F.col("_m")).otherwise(F.col(x) * alpha)
    got = affine_scan(df.withColumn("_a", a).withColumn("_b", b), "_a", "_b", out)
    return got.withColumn(out, F.when(F.col("_i") >= n, F.col(out))).drop("_i", "_m", "_a", "_b")


def running_return(df: DataFrame, reward: str, done: str, out: str, gamma: float = 0.99, key: str = "symbol", on: str = "t") -> DataFrame:
    """Forward discounted sum of rewards that starts anew after a done row."""
    before = F.coalesce(F.lag(done).over(Window.partitionBy(key).orderBy(on)).cast("int"), F.lit(0))
    df = df.withColumn("_a", gamma * (1 - before)).withColumn("_b", F.col(reward).cast("double"))
    return affine_scan(df, "_a", "_b", out, key=key, order=on).drop("_a", "_b")


def wins_by(df: DataFrame, split: str, config: str, metric: str) -> DataFrame:
    """(config, wins): in how many splits a configuration has the largest metric, ties to the
    smaller name."""
    best = df.groupBy(split).agg(F.max(F.struct(F.col(metric))).alias("_m"))
    top = df.join(best, split).where(F.col(metric) == F.col(f"_m.{metric}")).groupBy(split).agg(F.min(config).alias(config))
    return top.groupBy(config).agg(F.count(F.lit(1)).alias("wins"))


def priority(error: Column, alpha: float = 0.6) -> Column:
    """Replay priority of a temporal-difference error: clipped to 1e-8..10, to the power."""
    return F.pow(F.least(F.greatest(F.abs(error), F.lit(1e-8)), F.lit(10.0)), F.lit(alpha))


def prioritised(buffer: DataFrame, weight: str, n: int, seed: int = 7, beta: float = 0.4, on: str = "step") -> DataFrame:
    """n rows drawn by weight: one seeded uniform in each of n equal strata of the total
    weight, and importance weights (rows * share)^-beta over their maximum. Rows may repeat.
    Prefix sums are taken within ranges of `on`, and offset by a table of one row a range."""
    parts = max(2, int(buffer.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(buffer.agg(F.percentile_approx(on, [i / parts for i in range(1, parts)])).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(on))) if cuts else F.lit(0)
    df = buffer.withColumn("_p", part)
    sums = df.groupBy("_p").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    sums = sums.select("_p", F.coalesce(F.sum("_w").over(w), F.lit(0.0)).alias("_at"), F.sum("_w").over(all_).alias("_t"), F.sum("_c").over(all_).alias("_k"))
    inside = Window.partitionBy("_p").orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(sums), "_p").withColumn("_hi", F.col("_at") + F.sum(weight).over(inside)).withColumn("_lo", F.col("_hi") - F.col(weight))
    # Strata that a row's range [lo, hi) of the total meets, then the uniforms that fall in it.
    step = F.col("_t") / n
    first, stop = F.floor(F.col("_lo") / step), F.least(F.floor(F.col("_hi") / step), F.lit(n - 1))
    df = df.withColumn("_s", F.explode(F.sequence(F.least(first, stop), stop)))
    u = (F.pmod(F.xxhash64(F.lit(seed), "_s"), F.lit(1 << 30)) / float(1 << 30) + F.col("_s")) * step
    df = df.where((u >= F.col("_lo")) & (u < F.col("_hi")))
    raw = F.pow(F.col("_k") * F.col(weight) / F.col("_t"), F.lit(-beta))
    return df.withColumn("_r", raw).withColumn("is_weight", F.col("_r") / F.max("_r").over(all_)).select(*buffer.columns, F.col("_s").alias("draw"), "is_weight")
