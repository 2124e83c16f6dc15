"""Trades, curves and baselines: buckets, profiles, drawdowns, episodes, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hold_bucket(bars: Column) -> Column:
    return F.when(bars <= 10, "short").when(bars <= 50, "medium").otherwise("long")


def session(hour: Column) -> Column:
    """Five sessions of the UTC day, which start at 0, 6, 12, 15 and 20."""
    return F.when(hour < 6, "asia").when(hour < 12, "europe_am").when(hour < 15, "europe_pm").when(hour < 20, "us_am").otherwise("us_pm")


def bucketed(trades: DataFrame, bucket: str, pnl: str) -> DataFrame:
    """(bucket, n, wins, total, mean) of the profit."""
    p = F.col(pnl)
    return trades.groupBy(bucket).agg(F.count(p).alias("n"), F.sum((p > 0).cast("long")).alias("wins"), F.sum(p).alias("total"), F.avg(p).alias("mean"))


def entry_profile(rows: DataFrame, entry: str, features: list[str]) -> DataFrame:
    """(feature, baseline, sd, entry_mean, z): how far the mean at entries (rows where the
    0/1 column `entry` is 1) lies from that of all rows, in population deviations. One
    aggregation over unpivoted features."""
    stack = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    long = rows.select(entry, F.expr(f"stack({len(features)}, {stack}) as (feature, x)"))
    got = long.groupBy("feature").agg(F.avg("x").alias("baseline"), F.stddev_pop("x").alias("sd"), F.avg(F.when(F.col(entry) == 1, F.col("x"))).alias("entry_mean"))
    return got.withColumn("z", F.when(F.col("sd") > 1e-12, (F.col("entry_mean") - F.col("baseline")) / F.col("sd")).otherwise(0.0))


def round_trips(orders: DataFrame, key: str = "symbol", on: str = "ts") -> DataFrame:
    """(key, n, entry_ts, exit_ts, side, entry, exit, pnl): flat-to-flat or reversal trades of
    (key, on, target, price), each with the price of the order that opened it and of the next
    order that changes the side. Windows only."""
    w = Window.partitionBy(key).orderBy(on)
    side = F.signum("target")
    turns = orders.withColumn("_s", side).withColumn("_b", F.coalesce(F.lag(side).over(w), F.lit(0.0))).where(F.col("_s") != F.col("_b"))
    turns = turns.withColumn("exit_ts", F.lead(on).over(w)).withColumn("exit", F.lead("price").over(w))
    done = turns.where((F.col("_s") != 0) & F.col("exit").isNotNull())
    return done.select(key, F.row_number().over(w).alias("n"), F.col(on).alias("entry_ts"), "exit_ts", F.col("_s").cast("int").alias("side"), F.col("price").alias("entry"), "exit", ((F.col("exit") - F.col("price")) * F.col("_s")).alias("pnl"))


def equal_weight(panel: DataFrame, asset: str = "symbol", on: str = "ts", price: str = "close") -> DataFrame:
    """One row: product return and Sharpe ratio (population deviation, root of 252) of the
    mean of the assets' simple returns by time. The first return of an asset is left out."""
    r = F.col(price) / F.lag(price).over(Window.partitionBy(asset).orderBy(on)) - 1
    by_time = panel.select(on, r.alias("r")).where(F.col("r").isNotNull()).groupBy(on).agg(F.avg("r").alias("r"))
    return by_time.agg(F.count("r").alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total"), (F.avg("r") / (F.stddev_pop("r") + 1e-8) * 252**0.5).alias("sharpe"))


def growth(x: Column) -> tuple[Column, Column]:
    """Product of 1 + x as aggregates (ln of its magnitude, sign): it may be negative, where a
    short position loses more than there is, and beyond doubles; 0 has the sign 0 and counts 1
    in the logarithm."""
    g = 1 + x
    minus = F.sum(F.coalesce((g < 0).cast("long"), F.lit(0)))
    sign = F.when(F.min(F.coalesce((g != 0).cast("int"), F.lit(1))) == 0, 0).otherwise(1 - 2 * (minus % 2))
    return F.sum(F.ln(F.when(g != 0, F.abs(g)))), sign.cast("int")


def crossover(bars: DataFrame, fast: int = 20, slow: int = 50, centred: bool = True, key: str = "symbol", on: str = "ts") -> Column:
    """Position of a two-mean crossover: 1 where the fast mean lies above the slow one, else -1,
    0 on the first `slow` rows. Centred means look ahead by about half their length, and rows
    beyond either end count as zero prices; trailing ones (centred false) don't."""
    w = Window.partitionBy(key).orderBy(on)

    def mean(n: int) -> Column:
        ahead = (n - 1) // 2 if centred else 0
        return F.sum("close").over(w.rowsBetween(ahead + 1 - n, ahead)) / n

    return F.when(F.row_number().over(w) <= slow, 0).when(mean(fast) > mean(slow), 1).otherwise(-1)


def _held(df: DataFrame, position: str, turn: Column, cost: float, key: str, on: str) -> Column:
    """What a position gains until the next row, less `cost` price units a unit of `turn`."""
    w = Window.partitionBy(key).orderBy(on)
    after = F.lead("close").over(w)
    return F.col(position) * (after / F.col("close") - 1) - F.abs(turn) * cost / after


def baselines(bars: DataFrame, cost: float = 0.5, fast: int = 20, slow: int = 50, centred: bool = True, key: str = "symbol", on: str = "ts") -> DataFrame:
    """(key, n, then <name>_log and <name>_sign, the growth of one unit, see `growth`, for
    hold, sma and oracle): always holding; a crossover of two means, long and short, that pays
    for a change of position on the row that follows the change's return; and the position of
    the next return's sign, that pays for each change from the one before, the first one too."""
    w = Window.partitionBy(key).orderBy(on)
    df = bars.select(key, on, "close", crossover(bars, fast, slow, centred, key, on).alias("_s"))
    df = df.withColumn("_o", F.signum(F.lead("close").over(w) - F.col("close")))
    df = df.withColumn("_ds", F.lead("_s").over(w) - F.col("_s")).withColumn("_do", F.col("_o") - F.coalesce(F.lag("_o").over(w), F.lit(0.0)))
    df = df.withColumn("_h", F.lead("close").over(w) / F.col("close") - 1)
    df = df.withColumn("_x", _held(df, "_s", F.col("_ds"), cost, key, on)).withColumn("_y", _held(df, "_o", F.col("_do"), cost, key, on))
    found = []
    for name, c in (("hold", "_h"), ("sma", "_x"), ("oracle", "_y")):
        size, sign = growth(F.col(c))
        found += [size.alias(f"{name}_log"), sign.alias(f"{name}_sign")]
    return df.groupBy(key).agg(F.count("_h").alias("n"), *found)


def drawn(seed: int, trial: Column, row: Column) -> Column:
    """-1, 0 or 1, evenly, as a function of seed, trial and row number."""
    text = F.concat_ws(":", F.lit(str(seed)), trial.cast("string"), row.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 3 - 1


def random_baseline(bars: DataFrame, trials: int = 100, cost: float = 0.5, seed: int = 42, key: str = "symbol", on: str = "ts") -> DataFrame:
    """(key, trial, n, growth_log, growth_sign): growth of one unit under random positions of -1,
    0 or 1 on every row, with costs of each change. A row becomes `trials` rows of its number,
    return and next price, summed up on the map side."""
    w = Window.partitionBy(key).orderBy(on)
    after = F.lead("close").over(w)
    df = bars.select(key, (F.row_number().over(w) - 1).alias("_i"), (after / F.col("close") - 1).alias("_r"), after.alias("_a")).where("_a IS NOT NULL")
    df = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    now, before = drawn(seed, F.col("trial"), F.col("_i")), F.when(F.col("_i") > 0, drawn(seed, F.col("trial"), F.col("_i") - 1)).otherwise(0)
    size, sign = growth(now * F.col("_r") - F.abs(now - before) * cost / F.col("_a"))
    return df.groupBy(key, "trial").agg(F.count(F.lit(1)).alias("n"), size.alias("growth_log"), sign.alias("growth_sign"))


def beat(curves: DataFrame, key: str, on: str, value: str, base: str) -> DataFrame:
    """(key, alpha, first_beat, rows_beating, pct_beating) of one curve against another, each as
    growth since its own first row: the difference of their total returns in per cent points,
    the number of the first row (from 0) on which it lies above, -1 if none, and on how many."""
    w = Window.partitionBy(key).orderBy(on)
    grown = lambda c: F.col(c) / F.first(c).over(w)
    df = curves.select(key, on, grown(value).alias("_v"), grown(base).alias("_b"), (F.row_number().over(w) - 1).alias("_i"))
    above = F.col("_v") > F.col("_b")
    got = df.groupBy(key).agg(
        ((F.max_by("_v", on) - F.max_by("_b", on)) * 100).alias("alpha"),
        F.coalesce(F.min(F.when(above, F.col("_i"))), F.lit(-1)).alias("first_beat"),
        F.sum(F.coalesce(above.cast("long"), F.lit(0))).alias("rows_beating"),
        F.count(F.lit(1)).alias("_n"),
    )
    return got.withColumn("pct_beating", F.col("rows_beating") / F.col("_n") * 100).drop("_n")


def episodes(steps: DataFrame, reward: str, done: str, key: str = "symbol", on: str = "t") -> DataFrame:
    """(key, episode, total, length): returns and lengths of finished episodes; the steps
    after the last done row belong to none."""
    w = Window.partitionBy(key).orderBy(on)
    df = steps.withColumn("_e", F.coalesce(F.sum(F.col(done).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = df.groupBy(key, F.col("_e").alias("episode")).agg(F.sum(reward).alias("total"), F.count(F.lit(1)).alias("length"), F.max(F.col(done).cast("int")).alias("_d"))
    return got.where("_d = 1").drop("_d")


def veto_sweep(trades: DataFrame, features: list[str], pnl: str, points: tuple = (5, 10, 20, 80, 90, 95)) -> DataFrame:
    """(feature, point, side, threshold, n_vetoed, saved): what a veto on a feature above or
    below each of its percentiles would leave out, and the loss that it saves (the negated
    profit of the trades left out). Thresholds are one aggregation; each trade meets only the
    thresholds of its features."""
    stack = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    long = trades.select(pnl, F.expr(f"stack({len(features)}, {stack}) as (feature, x)"))
    cuts = long.groupBy("feature").agg(F.percentile("x", F.array(*[F.lit(p / 100) for p in points])).alias("_q"))
    cuts = cuts.select("feature", F.posexplode("_q").alias("_p", "threshold")).withColumn("point", F.array(*map(F.lit, points))[F.col("_p")])
    both = long.join(F.broadcast(cuts), "feature")
    hit = lambda c: F.sum(c.cast("long"))
    sides = []
    for name, c in ((">", F.col("x") > F.col("threshold")), ("<", F.col("x") < F.col("threshold"))):
        got = both.groupBy("feature", "point", "threshold").agg(hit(c).alias("n_vetoed"), F.sum(F.when(c, -F.col(pnl)).otherwise(0.0)).alias("saved"))
        sides.append(got.withColumn("side", F.lit(name)))
    return sides[0].unionByName(sides[1]).select("feature", "point", "side", "threshold", "n_vetoed", "saved")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, infinite, low, high, mean, sd, zeros, constant): data-quality
    profile of numeric columns in one aggregation of the unpivoted table."""
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    x, ok = F.col("x"), F.col("ok")
    long = df.select(F.expr(f"stack({len(columns)}, {stack}) as (column, x)"))
    long = long.withColumn("ok", F.when(~(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), x))
    got = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((x.isNull() | F.isnan(x)).cast("long")).alias("missing"),
        F.sum(F.coalesce(F.abs(x) == float("inf"), F.lit(False)).cast("long")).alias("infinite"),
        F.min(ok).alias("low"),
        F.max(ok).alias("high"),
        F.avg(ok).alias("mean"),
        F.stddev_pop(ok).alias("sd"),
        F.sum(F.coalesce(ok == 0, F.lit(False)).cast("long")).alias("zeros"),
    )
    return got.withColumn("constant", F.coalesce(F.col("low") == F.col("high"), F.lit(False)))


def best_so_far(df: DataFrame, x: str, key: str, on: str) -> DataFrame:
    return df.withColumn("best", F.max(x).over(Window.partitionBy(key).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)))


def regime_segments(df: DataFrame, key: str, on: str, regime: str, price: str) -> DataFrame:
    """(key, segment, regime, n, growth): runs of rows of one regime and the price's growth
    over each."""
    w = Window.partitionBy(key).orderBy(on)
    new = F.coalesce((F.col(regime) != F.lag(regime).over(w)).cast("int"), F.lit(0))
    df = df.withColumn("_n", new).withColumn("segment", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = df.groupBy(key, "segment").agg(F.first(regime).alias("regime"), F.count(F.lit(1)).alias("n"), (F.max_by(price, on) / F.min_by(price, on) - 1).alias("growth"))
    return got
