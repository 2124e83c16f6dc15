"""Feature blocks and moving averages over bars: windows of one specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip, safe_div

from .recurrence import affine_scan, ema, kama, wilder
from .windows import last, order, past, position, rolling_mean, wma

TINY = 1e-8


def slope(x: str, n: int, i: str = "_i") -> Column:
    """Rolling least-squares slope over the row number `i`; 0 on the first row."""
    fit = F.regr_slope(F.col(x), F.col(i)).over(last(n))
    return F.when(F.count(x).over(last(n)) >= 2, F.coalesce(fit, F.lit(0.0))).otherwise(0.0)


MICRO = ["body_ratio", "upper_wick_ratio", "lower_wick_ratio", "close_location", "delta_ratio", "vol_vs_ma20", "vol_vs_ma50", "er_ratio", "duration_norm", "cvd_slope_fast", "cvd_slope_slow", "cvd_divergence", "return_1", "return_5", "volatility_20"]


def microstructure(bars: DataFrame) -> DataFrame:
    """Adds the 15 microstructure features MICRO to bars (symbol, ts, open, high, low, close,
    volume, delta, duration_seconds): candle geometry, volume, effort and pace against their
    rolling means, bounded slopes of the running delta, returns. cvd_divergence scales by the
    deviation of the symbol's whole history, so that it looks ahead."""
    o, h, l, c, v, d = map(F.col, ("open", "high", "low", "close", "volume", "delta"))
    change = F.coalesce(c - F.lag("close").over(order()), F.lit(0.0))
    span = F.greatest(h - l, F.lit(TINY))
    df = bars.withColumn("_i", position().cast("double")).withColumn("_cvd", F.sum("delta").over(past())).withColumn("_dc", change)
    df = df.withColumn("_er", safe_div(F.abs("_dc"), F.greatest(v, F.lit(TINY)))).withColumn("_ret", safe_div(F.col("_dc"), c))
    df = df.withColumn("_sd", F.stddev_pop(F.abs("_dc")).over(Window.partitionBy("symbol"))).withColumn("_v20", rolling_mean(v, 20))
    ratio = lambda x, n: clip(safe_div(x, rolling_mean(x, n)), 0.0, 5.0)
    flow = lambda n: F.tanh(safe_div(slope("_cvd", n), F.col("_v20")))
    before = F.lag("close", 5).over(order())
    return df.select(
        *bars.columns,
        safe_div(c - o, span).alias("body_ratio"),
        safe_div(h - F.greatest(o, c), span).alias("upper_wick_ratio"),
        safe_div(F.least(o, c) - l, span).alias("lower_wick_ratio"),
        safe_div(c - l, span).alias("close_location"),
        clip(safe_div(d, F.greatest(v, F.lit(TINY))), -1.0, 1.0).alias("delta_ratio"),
        ratio(v, 20).alias("vol_vs_ma20"),
        ratio(v, 50).alias("vol_vs_ma50"),
        ratio(F.col("_er"), 20).alias("er_ratio"),
        ratio(F.col("duration_seconds"), 20).alias("duration_norm"),
        flow(10).alias("cvd_slope_fast"),
        flow(30).alias("cvd_slope_slow"),
        clip(F.tanh(slope("close", 20) / (F.col("_sd") + TINY)) - flow(20), -2.0, 2.0).alias("cvd_divergence"),
        F.tanh(F.col("_ret") * 100).alias("return_1"),
        F.tanh(F.coalesce((c - before) / (before + TINY), F.lit(0.0)) * 50).alias("return_5"),
        F.tanh(F.stddev_pop("_ret").over(last(20)) * 200).alias("volatility_20"),
    )


def phase(bars: DataFrame, n: int = 50) -> DataFrame:
    """Adds phase to bars with absorption_side and delta, 0 on the first n rows: 1
    accumulation, 2 markup, 3 distribution, 4 markdown, 0 none, by the slopes of price
    (relative to its mean) and running delta and the counts of either side's absorption."""
    df = bars.withColumn("_i", position().cast("double")).withColumn("_cvd", F.sum("delta").over(past()))
    mean = rolling_mean(F.col("close"), n)
    ps, cs = slope("close", n) / F.when(mean != 0, mean).otherwise(1.0), slope("_cvd", n)
    count = lambda side: F.sum((F.col("absorption_side") == side).cast("int")).over(last(n))
    df = df.withColumn("_p", ps).withColumn("_c", cs).withColumn("_b", count(1)).withColumn("_s", count(-1))
    p, q = F.col("_p"), F.col("_c")
    code = (
        F.when(F.col("_i") <= n, 0)
        .when((p < 0.0002) & (q > 0) & (F.col("_b") > F.col("_s")), 1)
        .when((p > 0.0005) & (q > 0), 2)
        .when((p > -0.0002) & (q < 0) & (F.col("_s") > F.col("_b")), 3)
        .when((p < -0.0005) & (q < 0), 4)
        .otherwise(0)
    )
    return df.withColumn("phase", code).drop("_i", "_cvd", "_p", "_c", "_b", "_s")


def triangular(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Mean of full windows of the mean of full windows, whose warm-up counts as 0; null on
    the first n - 1 rows."""
    df = df.withColumn("_m", F.coalesce(rolling_mean(F.col(x), n, strict=True), F.lit(0.0)))
    return df.withColumn(out, rolling_mean(F.col("_m"), n, strict=True)).drop("_m")


def hull(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Weighted mean over root n rows of 2 * weighted mean over n / 2 - weighted mean over n;
    warm-up rows of those two count as 0."""
    zero = lambda k: F.coalesce(wma(F.col(x), k), F.lit(0.0))
    df = df.withColumn("_d", 2 * zero(max(1, n // 2)) - zero(n))
    return df.withColumn(out, wma(F.col("_d"), max(1, int(n**0.5)))).drop("_d")


def vidya(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Exponential mean whose weight is 2 / (n + 1) times the absolute momentum oscillator of
    the last n values (n - 1 changes); starts from the first value."""
    df = df.withColumn("_i", position())
    change = F.when(F.col("_i") > 1, F.col(x) - F.lag(x).over(order()))
    df = df.withColumn("_c", change)
    frame = order().rowsBetween(-(n - 2), 0)
    net, total = F.abs(F.sum("_c").over(frame)), F.sum(F.abs("_c")).over(frame)
    df = df.withColumn("_k", F.coalesce(F.try_divide(net, total), F.lit(0.0)) * (2 / (n + 1)))
    first = F.col("_i") == 1
    df = df.withColumn("_a", F.when(first, 0.0).otherwise(1 - F.col("_k"))).withColumn("_b", F.when(first, F.col(x)).otherwise(F.col(x) * F.col("_k")))
    return affine_scan(df.drop("_i", "_c", "_k"), "_a", "_b", out).drop("_a", "_b")


def log_return(x: str = "close") -> Column:
    return F.coalesce(F.ln(F.col(x) + 1e-12) - F.ln(F.lag(x).over(order()) + 1e-12), F.lit(0.0))


def rolling_risk(df: DataFrame, n: int = 200, x: str = "close") -> DataFrame:
    """Adds volatility and sharpe of the n log returns before each row (the row's own left
    out), the first n rows taking the first such value, 0 if there is none; and the windowed
    drawdown from the peak of the last n rows."""
    before = order().rowsBetween(-n, -1)
    df = df.withColumn("_r", log_return(x))
    full = position() > n
    sd, mean = F.stddev_pop("_r").over(before), F.avg("_r").over(before)
    df = df.withColumn("_v", F.when(full, sd)).withColumn("_q", F.when(full, F.when(sd > 1e-12, mean / sd).otherwise(0.0)))
    ahead = order().rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(0.0))
    peak = F.max(x).over(last(n))
    return df.withColumn("volatility", fill("_v")).withColumn("sharpe", fill("_q")).withColumn("window_drawdown", (F.col(x) - peak) / (peak + 1e-9)).drop("_r", "_v", "_q")


#: Kinds of moving averages over a column x with n rows, by name: (df, x, n, out).
AVERAGES = {
    "simple": lambda df, x, n, out: df.withColumn(out, rolling_mean(F.col(x), n, strict=True)),
    "weighted": lambda df, x, n, out: df.withColumn(out, wma(F.col(x), n)),
    "exponential": ema,
    "wilder": wilder,
    "triangular": triangular,
    "hull": hull,
    "vidya": vidya,
    "adaptive": kama,
}


def moving_average(df: DataFrame, kind: str, x: str, n: int, out: str) -> DataFrame:
    """Adds the moving average of a kind in AVERAGES."""
    if kind not in AVERAGES:
        raise ValueError(f"kind: {', '.join(AVERAGES)}")
    return AVERAGES[kind](df, x, n, out)
