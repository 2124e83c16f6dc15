"""Result tables: best rows, summaries, trades, panels, replay buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, group: str, metric: str, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(metric), tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def metric_summary(df: DataFrame, x: str, group: str) -> DataFrame:
    c = F.col(x)
    q = lambda p: F.percentile(c, p)
    return df.groupBy(group).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), q(0.5).alias("median"), F.min(c).alias("low"), F.max(c).alias("high"), (q(0.75) - q(0.25)).alias("iqr"), F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))).alias("cv"))


def trade_summary(trades: DataFrame, pnl: str, group: str) -> DataFrame:
    """Wins, losses, profit factor (infinity without losses) by group."""
    p = F.col(pnl)
    win, loss = F.sum(F.greatest(p, F.lit(0.0))), -F.sum(F.least(p, F.lit(0.0)))
    return trades.groupBy(group).agg(F.count(p).alias("n"), F.sum((p > 0).cast("long")).alias("wins"), F.sum(p).alias("total"), F.when(loss > 0, F.try_divide(win, loss)).otherwise(F.lit(float("inf"))).alias("profit_factor"))


def pivot_first(df: DataFrame, on: str, column: str, values: list[str], x: str, first: str | None = None) -> DataFrame:
    """Long to wide; the columns are listed, so that Spark needs no extra pass. Of rows that
    repeat a key the one of least `first` counts (by default, of least value)."""
    return df.groupBy(on).pivot(column, values).agg(F.min_by(x, first or x))


def zscore_tanh(df: DataFrame, columns: list[str]) -> DataFrame:
    """tanh of z-scores against whole-table mean and population deviation (floored 1e-8):
    one aggregation, joined as a single row."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))
    return joined.select(*[c for c in df.columns if c not in columns], *[F.tanh((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns])


def transitions(steps: DataFrame, seq: str, step: str, state: str) -> DataFrame:
    """Replay rows with the next state; the last step of a sequence has none and goes."""
    w = Window.partitionBy(seq).orderBy(step)
    return steps.withColumn("next_state", F.lead(state).over(w)).where(F.col("next_state").isNotNull())


def feature_correlation(df: DataFrame, feature: str, target: str, group: str) -> DataFrame:
    """Spearman: Pearson correlation of average ranks."""
    rank = lambda c: F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(group, c)) - 1) / 2
    ranked = df.select(group, rank(feature).alias("_a"), rank(target).alias("_b"))
    return ranked.groupBy(group).agg(F.corr("_a", "_b").alias("spearman"))
