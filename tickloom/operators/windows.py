"""Rolling indicators over bars (symbol, ts, open, high, low, close, volume, delta): row
frames of one window specification, so that one sort by symbol serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip, safe_div


def order() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int) -> Window:
    return order().rowsBetween(-(n - 1), 0)


def past() -> Window:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def position() -> Column:
    return F.row_number().over(order())


def rolling_mean(x: Column, n: int, strict: bool = False) -> Column:
    mean = F.avg(x).over(last(n))
    return F.when(F.count(x).over(last(n)) == n, mean) if strict else mean


def rolling_std(x: Column, n: int) -> Column:
    """Population deviation, from the first row on."""
    return F.stddev_pop(x).over(last(n))


def with_slope(df: DataFrame, name: str, x: str, n: int) -> DataFrame:
    """Adds a rolling least-squares slope of column x."""
    df = df.withColumn("_i", position().cast("double"))
    slope = F.regr_slope(F.col(x), F.col("_i")).over(last(n))
    return df.withColumn(name, F.when(F.count(x).over(last(n)) >= 2, F.coalesce(slope, F.lit(0.0))).otherwise(0.0)).drop("_i")


def wma(x: Column, n: int) -> Column:
    """Linearly weighted mean of full windows."""
    frame = F.collect_list(x).over(last(n))
    total = F.aggregate(F.transform(frame, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(frame) == n, total / (n * (n + 1) / 2))


def percentile_rank(x: Column, n: int) -> Column:
    """Share of the frame that is at most its last value."""
    frame = F.collect_list(x).over(last(n))
    return F.size(F.filter(frame, lambda v: v <= F.element_at(frame, -1))) / F.size(frame)


def drawdown(x: Column) -> Column:
    return x / F.max(x).over(past()) - 1


def forward_return(x: Column, h: int) -> Column:
    """x[h] / x - 1; 0 on the last h rows."""
    return F.coalesce(F.lead(x, h).over(order()) / x - 1, F.lit(0.0))


def bars_since(flag: Column, most: int) -> Column:
    """Rows since the flag was last true; row number + most before that."""
    i = position() - 1
    return i - F.coalesce(F.last(F.when(flag, i), ignorenulls=True).over(past()), F.lit(-most))


def true_range() -> Column:
    before = F.lag("close").over(order())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("_tr", true_range()).withColumn("atr", F.avg("_tr").over(last(n))).drop("_tr")


def minmax(x: Column, n: int) -> Column:
    """Causal min-max: 0 before the frame is full, .5 when it is flat."""
    low, high = F.min(x).over(last(n)), F.max(x).over(last(n))
    full = F.count(x).over(last(n)) == n
    return F.when(~full, 0.0).when(high - low < 1e-10, 0.5).otherwise(F.try_divide(x - low, high - low))


def effort_result(df: DataFrame, n: int = 20) -> DataFrame:
    """er = |close change| / volume (0 where undefined), er_ratio = er / its rolling mean
    (1 where undefined)."""
    change = F.abs(F.col("close") - F.lag("close").over(order()))
    df = df.withColumn("er", F.coalesce(F.try_divide(change, F.col("volume")), F.lit(0.0)))
    mean = F.avg("er").over(last(n))
    return df.withColumn("er_ratio", F.coalesce(F.try_divide(F.col("er"), mean), F.lit(1.0)))


def absorption(df: DataFrame, volume: float = 1.5, effort: float = 0.5, n: int = 20) -> DataFrame:
    """Flag of much volume (at least `volume` times its mean) with little result (er_ratio at
    most `effort`), and its side by the sign of delta, 0 where delta is 0."""
    df = effort_result(df, n)
    flag = (F.try_divide(F.col("volume"), F.avg("volume").over(last(n))) >= volume) & (F.col("er_ratio") <= effort)
    df = df.withColumn("absorption", F.coalesce(flag.cast("int"), F.lit(0)))
    return df.withColumn("absorption_side", F.when(F.col("absorption") == 1, F.signum("delta").cast("int")).otherwise(0))


def swing_events(df: DataFrame, n: int = 20, multiple: float = 2.0, near: float = 0.3) -> DataFrame:
    """spring, upthrust, selling and buying climax flags, from row n + 2 on, of bars with a
    range. Spring: the low pierces the previous row's swing low, the close is back above it,
    delta is positive; upthrust: the mirror image. Selling climax: volume at least `multiple`
    times its mean, a lower close within `near` of the range from the low, and yet positive
    delta; buying climax: the mirror image."""
    df = df.withColumn("_lo", F.min("low").over(last(n))).withColumn("_hi", F.max("high").over(last(n)))
    before_low, before_high = F.lag("_lo").over(order()), F.lag("_hi").over(order())
    span, change = F.col("high") - F.col("low"), F.col("close") - F.lag("close").over(order())
    ok = (position() > n + 1) & (span > 0)
    heavy = F.col("volume") >= F.avg("volume").over(last(n)) * multiple
    bought, sold = F.col("delta") > 0, F.col("delta") < 0
    flags = {
        "spring": (F.col("low") < before_low) & (F.col("close") > before_low) & bought,
        "upthrust": (F.col("high") > before_high) & (F.col("close") < before_high) & sold,
        "selling_climax": heavy & (change < 0) & (F.try_divide(F.col("close") - F.col("low"), span) < near) & bought,
        "buying_climax": heavy & (change > 0) & (F.try_divide(F.col("high") - F.col("close"), span) < near) & sold,
    }
    for name, flag in flags.items():
        df = df.withColumn(name, F.coalesce((ok & flag).cast("int"), F.lit(0)))
    return df.drop("_lo", "_hi")


def candle(df: DataFrame) -> DataFrame:
    """Body, wick and close-location ratios of a bar's range."""
    span = F.col("high") - F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return df.select(
        "*",
        safe_div(F.abs(F.col("close") - F.col("open")), span).alias("body_ratio"),
        safe_div(F.col("high") - top, span).alias("upper_wick"),
        safe_div(bottom - F.col("low"), span).alias("lower_wick"),
        safe_div(F.col("close") - F.col("low"), span, 0.5).alias("close_location"),
        clip(safe_div(F.col("delta"), F.col("volume")), -1.0, 1.0).alias("delta_ratio"),
    )


def trading_range(df: DataFrame, n: int = 50, multiple: float = 1.5, atr: int = 20, zone: float = 0.15) -> DataFrame:
    """Rolling range, reset when the close leaves the previous row's range by more than
    multiple * (mean of the last `atr` absolute close changes, the first one 0). Adds island
    number, bars_in_range, and how many closes of the island so far lay in the lower or upper
    `zone` of their range."""
    move = F.coalesce(F.abs(F.col("close") - F.lag("close").over(order())), F.lit(0.0))
    df = df.withColumn("_m", move).withColumn("_a", F.greatest(F.avg("_m").over(last(atr)), F.lit(1e-8)))
    df = df.withColumn("range_high", F.max("high").over(last(n))).withColumn("range_low", F.min("low").over(last(n)))
    hi, lo = F.lag("range_high").over(order()), F.lag("range_low").over(order())
    out = (F.col("close") > hi + multiple * F.col("_a")) | (F.col("close") < lo - multiple * F.col("_a"))
    df = df.withColumn("_r", F.coalesce(out.cast("int"), F.lit(0))).withColumn("island", F.sum("_r").over(past()))
    span = F.when(F.col("range_high") - F.col("range_low") > 1e-8, F.col("range_high") - F.col("range_low"))
    touch = lambda d: F.coalesce((F.try_divide(d, span) < zone).cast("int"), F.lit(0))
    inside = Window.partitionBy("symbol", "island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("bars_in_range", F.count(F.lit(1)).over(inside))
    df = df.withColumn("support_touches", F.sum(touch(F.col("close") - F.col("range_low"))).over(inside))
    df = df.withColumn("resistance_touches", F.sum(touch(F.col("range_high") - F.col("close"))).over(inside))
    return df.drop("_r", "_m", "_a")
