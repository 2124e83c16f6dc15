"""As-of, interval and grid joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(left: DataFrame, right: DataFrame, key: str, on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: tagged union and
    carry, one sort by key, no range join."""
    names = [c for c in left.columns if c not in (key, on)]
    a = left.select(key, on, F.lit(1).alias("_tag"), F.struct(*names, F.lit(1).alias("_l")).alias("_row"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema[0].dataType).alias("_v"))
    b = right.select(key, on, F.lit(0).alias("_tag"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(key).orderBy(on, "_tag").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionAll(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_tag = 1")
    return carried.select(key, on, *[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_v.{c}").alias(c) for c in values])


def concurrency(intervals: DataFrame, start: str, end: str, key: str = "symbol") -> DataFrame:
    """(key, at, active): how many closed intervals [start, end] (integers) are open from
    each change on. Ends as events: no interval is expanded, no overlap join."""
    events = intervals.select(key, F.col(start).alias("at"), F.lit(1).alias("d")).unionAll(intervals.select(key, (F.col(end) + 1).alias("at"), F.lit(-1).alias("d")))
    steps = events.groupBy(key, "at").agg(F.sum("d").alias("d"))
    return steps.withColumn("active", F.sum("d").over(Window.partitionBy(key).orderBy("at"))).drop("d")


def uniqueness(intervals: DataFrame, start: str, end: str, key: str = "symbol") -> DataFrame:
    """Mean of 1 / concurrency over each interval, from prefix sums at the change points:
    two as-of lookups instead of an interval join."""
    steps = concurrency(intervals, start, end, key)
    w = Window.partitionBy(key).orderBy("at")
    span = F.lead("at").over(w) - F.col("at")
    rate = F.when(F.col("active") > 0, F.lit(1.0) / F.col("active")).otherwise(0.0)
    steps = steps.withColumn("rate", rate).withColumn("_part", F.coalesce(span * rate, F.lit(0.0)))
    steps = steps.withColumn("total", F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    steps = steps.select(key, "at", F.coalesce("total", F.lit(0.0)).alias("total"), "rate", F.col("at").alias("from"))
    at = lambda df, c: asof_last(df.withColumn("at", F.col(c)), steps, key, "at", ["total", "rate", "from"]).withColumn("_s", F.col("total") + F.col("rate") * (F.col("at") - F.col("from"))).drop("total", "rate", "from", "at")
    low = at(intervals, start).withColumnRenamed("_s", "_lo").withColumn("_stop", F.col(end) + 1)
    both = at(low, "_stop")
    return both.withColumn("uniqueness", (F.col("_s") - F.col("_lo")) / (F.col(end) - F.col(start) + 1)).drop("_s", "_lo", "_stop")


def grid_fill(bars: DataFrame, grid: DataFrame, key: str = "symbol", on: str = "ts") -> DataFrame:
    """Every symbol on every grid time: gaps take the last close on all of OHLC with volume
    0, a leading gap the first close there is (0 if none). `grid` is one column of times; its size
    times the symbols is the result's."""
    symbols = bars.select(key).distinct()
    full = grid.select(on).distinct().crossJoin(F.broadcast(symbols)).join(bars, [on, key], "left")
    w = Window.partitionBy(key).orderBy(on)
    close = F.coalesce("close", F.last("close", ignorenulls=True).over(w), F.first("close", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    full = full.withColumn("_c", close)
    return full.select(key, on, *[F.coalesce(c, F.col("_c")).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))
