"""Standard stock indicators by symbol: MACD, bands, RSI, CCI, DX and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import slice_cuts
from .recurrence import affine_scans
from .windows import last, order

INDICATORS = ["macd", "boll_ub", "boll_lb", "rsi_30", "cci_30", "dx_30", "close_30_sma", "close_60_sma"]


def weighted_means(df: DataFrame, series: list[tuple[str, float, str]], cuts: list | None = None) -> DataFrame:
    """Exponentially weighted means out of x (x, alpha, out) whose weights (1 - alpha)^age are
    divided by their own sum, so that early rows aren't drawn to the first one: quotients of two
    affine recurrences each, all in one pass."""
    own, steps = df.columns, []
    for k, (x, alpha, _) in enumerate(series):
        df = df.withColumn(f"_a{k}", F.lit(1 - alpha)).withColumn(f"_x{k}", F.col(x).cast("double")).withColumn(f"_o{k}", F.lit(1.0))
        steps += [(f"_a{k}", f"_x{k}", f"_n{k}"), (f"_a{k}", f"_o{k}", f"_d{k}")]
    got = affine_scans(df, steps, cuts=cuts)
    return got.select(*own, *[(F.col(f"_n{k}") / F.col(f"_d{k}")).alias(out) for k, (_, _, out) in enumerate(series)])


def indicators(bars: DataFrame, n: int = 30, band: int = 20, fast: int = 12, slow: int = 26) -> DataFrame:
    """Adds INDICATORS to bars (symbol, ts, high, low, close).

    macd: weighted means (alpha 2 / (span + 1)) of spans fast less slow. boll_ub, boll_lb: mean
    and twice the sample deviation of the last `band` closes. rsi_30: 100 - 100 / (1 + mean rise
    / mean fall), with means of alpha 1 / n. cci_30: the typical price's distance from its mean
    over n rows, over .015 of their mean absolute deviation from it. dx_30: the gap of the
    directional indexes over their sum, in per cent; each is the weighted mean (alpha 1 / n) of
    one side's moves, where the larger, over that of the true range. close_30_sma and
    close_60_sma: means of the last rows. Windows are as long as there are rows; null where a
    quotient has no divisor."""
    c, high, low = F.col("close").cast("double"), F.col("high").cast("double"), F.col("low").cast("double")
    lag = lambda x: F.lag(x).over(order())
    change = F.coalesce(c - lag(c), F.lit(0.0))
    up, down = F.coalesce(high - lag(high), F.lit(0.0)), F.coalesce(lag(low) - low, F.lit(0.0))
    wide = F.coalesce(F.greatest(high - low, F.abs(high - lag(c)), F.abs(low - lag(c))), high - low)
    side = lambda x, y: F.when((x > y) & (x > 0), x).otherwise(0.0)
    df = bars.withColumn("_rise", F.greatest(change, F.lit(0.0))).withColumn("_fall", F.greatest(-change, F.lit(0.0)))
    df = df.withColumn("_up", side(up, down)).withColumn("_down", side(down, up)).withColumn("_tr", wide).withColumn("_tp", (high + low + c) / 3)
    cuts, slow_ = slice_cuts(bars, "ts"), 1 / n
    df = weighted_means(df, [("close", 2 / (fast + 1), "_f"), ("close", 2 / (slow + 1), "_s"), ("_rise", slow_, "_r"), ("_fall", slow_, "_l"), ("_up", slow_, "_p"), ("_down", slow_, "_m"), ("_tr", slow_, "_t")], cuts)
    mean, spread = F.avg(c).over(last(band)), F.stddev_samp(c).over(last(band))
    frame = F.collect_list("_tp").over(last(n))
    middle = F.avg("_tp").over(last(n))
    df = df.withColumn("_w", frame).withColumn("_mid", middle)
    off = F.aggregate(F.transform("_w", lambda x: F.abs(x - F.col("_mid"))), F.lit(0.0), lambda a, x: a + x) / F.size("_w")
    plus, minus = F.try_divide(F.col("_p"), F.col("_t")), F.try_divide(F.col("_m"), F.col("_t"))
    strength: Column = 100 - 100 / (1 + F.try_divide(F.col("_r"), F.col("_l")))
    return df.select(
        *bars.columns,
        (F.col("_f") - F.col("_s")).alias("macd"),
        (mean + 2 * spread).alias("boll_ub"),
        (mean - 2 * spread).alias("boll_lb"),
        F.when(F.col("_l") == 0, F.when(F.col("_r") > 0, 100.0)).otherwise(strength).alias("rsi_30"),
        F.try_divide(F.col("_tp") - F.col("_mid"), 0.015 * off).alias("cci_30"),
        F.try_divide(F.abs(plus - minus), plus + minus).alias("_dx"),
        F.avg(c).over(last(30)).alias("close_30_sma"),
        F.avg(c).over(last(60)).alias("close_60_sma"),
    ).withColumn("dx_30", 100 * F.col("_dx")).select(*bars.columns, *INDICATORS)


def deviation_about(x: Column, mean: Column, n: int) -> Column:
    """Population deviation, plus 1e-10, of x - mean over the last n rows, those without a mean
    left out; null on the first n - 1 rows."""
    full = F.count(F.lit(1)).over(last(n)) == n
    return F.when(full, F.coalesce(F.stddev_pop(x - mean).over(last(n)), F.lit(0.0)) + 1e-10)


def entry_exits(events: DataFrame) -> DataFrame:
    """(symbol, entry_bar, exit_bar, direction, entry_price, exit_price, pnl, hold_bars): trades of
    events (symbol, bar, action BUY or SELL, change, price, pnl, before), in order of bar.

    An event with profit (not 0) closes a trade if one is open; whatever else comes becomes the
    entry. After a closing event the entry is that event, if it leaves a position (before +
    change is not 0), else none is open. So the entry of a closing event is the event before it,
    unless that closed a trade and left no position, or there is none: windows only."""
    w = Window.partitionBy("symbol").orderBy("bar")
    flat = (F.col("pnl") != 0) & (F.col("before") + F.col("change") == 0)
    df = events.withColumn("_flat", flat.cast("int")).withColumn("_i", F.row_number().over(w))
    # Whether an entry is open before an event: a run of events that each go flat with a profit
    # opens and closes in turns, as one without an open entry only opens.
    start = F.last(F.when(F.col("_flat") == 0, F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    since = F.col("_i") - 1 - F.coalesce(start, F.lit(0))
    open_ = F.when(start.isNull(), since % 2 == 1).otherwise(since % 2 == 0)
    entry = F.lag(F.struct("bar", "action", "price")).over(w)
    df = df.withColumn("_open", open_).withColumn("_e", entry)
    done = df.where(F.col("_open") & (F.col("pnl") != 0))
    return done.select("symbol", F.col("_e.bar").alias("entry_bar"), F.col("bar").alias("exit_bar"), F.when(F.col("_e.action") == "BUY", "LONG").otherwise("SHORT").alias("direction"), F.col("_e.price").alias("entry_price"), F.col("price").alias("exit_price"), "pnl", (F.col("bar") - F.col("_e.bar")).alias("hold_bars"))
