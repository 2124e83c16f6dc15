"""Wave, event and context features over bars (symbol, ts, open, high, low, close, volume,
delta), from the zigzag of closes: one row-order scan numbers the waves, all else is windows
and one small table of waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip, decay, finite, safe_div

from .features import MICRO, TINY, microstructure, slope
from .scans import waves
from .windows import bars_since, last, order, past, position, rolling_mean, trading_range

WAVE = ["wave_direction", "wave_progress", "wave_displacement_norm", "wave_vol_cumulative_norm", "wave_delta_ratio", "wave_vol_vs_same", "wave_vol_vs_prev", "wave_disp_vs_same", "wave_disp_vs_prev", "wave_er_vs_same", "wave_er_vs_prev", "wave_delta_vs_same", "demand_score_3wave", "supply_score_3wave", "wave_vol_trend_up", "wave_vol_trend_down", "wave_shortening_up", "wave_shortening_down", "yellow_bar", "large_wave_score"]
EVENT = ["spring_score", "upthrust_score", "sc_score", "bc_score", "absorption_score", "absorption_direction", "stopping_action_score", "bars_since_spring", "bars_since_upthrust", "bars_since_climax", "cumulative_absorption", "event_sequence_bull", "event_sequence_bear"]
CONTEXT = ["pct_in_range", "range_width_norm", "bars_in_range", "support_test_count", "resistance_test_count", "phase_accum_score", "phase_markup_score", "phase_distrib_score", "phase_markdown_score", "trend_4x"]


def some(x: Column) -> Column:
    """x, but at least a tiny amount: that amount where x is null."""
    return F.greatest(x, F.lit(TINY))


def unit(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def step() -> Column:
    """Absolute close change, 0 on the first row."""
    return F.coalesce(F.abs(F.col("close") - F.lag("close").over(order())), F.lit(0.0))


def wave_values(df: DataFrame) -> DataFrame:
    """Adds, to bars with wave and direction, what the wave holds up to each bar: wave_bars,
    wave_vol, wave_delta, and wave_disp, the way from its first close to its extreme close."""
    w = Window.partitionBy("symbol", "wave").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    extreme = F.when(F.col("direction") > 0, F.max("close").over(w)).otherwise(F.min("close").over(w))
    return df.select(
        "*",
        F.count(F.lit(1)).over(w).alias("wave_bars"),
        F.sum("volume").over(w).alias("wave_vol"),
        F.sum("delta").over(w).cast("double").alias("wave_delta"),
        F.abs(extreme - F.first("close").over(w)).alias("wave_disp"),
    )


def wave_table(df: DataFrame) -> DataFrame:
    """(symbol, wave, direction, start, bars, vol, delta, disp): one row a wave."""
    return df.groupBy("symbol", "wave").agg(
        F.max("direction").alias("direction"),
        F.min("ts").alias("start"),
        F.max("wave_bars").alias("bars"),
        F.max_by("wave_vol", "ts").alias("vol"),
        F.max_by("wave_delta", "ts").alias("delta"),
        F.max_by("wave_disp", "ts").alias("disp"),
    )


def _trend(ys: list[Column]) -> Column:
    """tanh of the slope over four waves, relative to their mean; 0 if there are fewer."""
    mean = sum(ys[1:], ys[0]) / 4
    fall = (ys[3] * 1.5 + ys[2] * 0.5 - ys[1] * 0.5 - ys[0] * 1.5) / (5 + TINY)
    return F.coalesce(F.tanh(fall / some(mean)), F.lit(0.0))


def wave_features(bars: DataFrame, points: float = 40.0) -> DataFrame:
    """Adds wave and the 20 features WAVE to bars. The running wave is compared with the
    completed ones before it: directions alternate, so that lags 2, 4, ... of the wave table
    have its own direction and lags 1, 3, ... the other."""
    df = wave_values(waves(bars, points))
    o = Window.partitionBy("symbol").orderBy("wave")
    table = wave_table(df)
    before = table.select(
        "symbol",
        "wave",
        *[F.lag(c, k).over(o).alias(f"_{c[0]}{k}") for c in ("vol", "disp") for k in range(1, 9)],
        F.lag(F.col("delta") / some(F.col("vol")), 2).over(o).alias("_q2"),
    )
    df = df.join(before, ["symbol", "wave"]).withColumn("_m", step())
    v, d = (lambda k: F.col(f"_v{k}")), (lambda k: F.col(f"_d{k}"))
    vol, disp, up = F.col("wave_vol"), F.col("wave_disp"), F.col("direction") > 0
    er = vol / some(disp)
    flow = F.col("wave_delta") / some(vol)
    against = lambda k, x, base, other: F.when(v(k) > TINY, x / base).otherwise(other)
    mean3 = lambda ks: sum((v(k) for k in ks[1:]), v(ks[0])) / 3
    same, other = mean3((2, 4, 6)), mean3((1, 3, 5))
    bought, sold = F.when(up, same).otherwise(other), F.when(up, other).otherwise(same)
    known = lambda a, b: clip(F.when(a.isNotNull() & b.isNotNull(), a / some(b)).otherwise(1.0), 0.0, 5.0)
    pick = lambda f, rising: F.when(up == rising, _trend([f(k) for k in (8, 6, 4, 2)])).otherwise(_trend([f(k) for k in (7, 5, 3, 1)]))
    most = lambda x: clip(x, 0.0, 5.0)
    avg4 = sum((v(k) for k in (2, 3, 4)), v(1)) / 4
    return df.select(
        *bars.columns,
        "wave",
        F.col("direction").cast("double").alias("wave_direction"),
        most(F.col("wave_bars") / 20.0).alias("wave_progress"),
        most(disp / some(rolling_mean(F.col("_m"), 20) * 20)).alias("wave_displacement_norm"),
        most(safe_div(vol, rolling_mean(vol, 50))).alias("wave_vol_cumulative_norm"),
        clip(flow, -1.0, 1.0).alias("wave_delta_ratio"),
        most(against(2, vol, v(2), 1.0)).alias("wave_vol_vs_same"),
        most(against(1, vol, v(1), 1.0)).alias("wave_vol_vs_prev"),
        most(against(2, disp, some(d(2)), 1.0)).alias("wave_disp_vs_same"),
        most(against(1, disp, some(d(1)), 1.0)).alias("wave_disp_vs_prev"),
        most(against(2, er, some(v(2) / some(d(2))), 1.0)).alias("wave_er_vs_same"),
        most(against(1, er, some(v(1) / some(d(1))), 1.0)).alias("wave_er_vs_prev"),
        clip(F.when(v(2) > TINY, flow - F.col("_q2")).otherwise(0.0), -2.0, 2.0).alias("wave_delta_vs_same"),
        known(bought, sold).alias("demand_score_3wave"),
        known(sold, bought).alias("supply_score_3wave"),
        pick(v, True).alias("wave_vol_trend_up"),
        pick(v, False).alias("wave_vol_trend_down"),
        pick(d, True).alias("wave_shortening_up"),
        pick(d, False).alias("wave_shortening_down"),
        F.when(v(2) > TINY, F.least(vol / v(2), F.lit(1.0))).otherwise(0.0).alias("yellow_bar"),
        known(vol, avg4).alias("large_wave_score"),
    )


def event_scores(df: DataFrame, n: int = 20, strict: bool = False) -> DataFrame:
    """Adds the 13 soft scores EVENT to bars with WAVE features. Swings take n + 1 rows. The
    upthrust's rejection grows with the close's height in the bar, as users of these scores
    know it; strict: with its depth."""
    h, l, c, v, d = map(F.col, ("high", "low", "close", "volume", "delta"))
    span = some(h - l)
    swing = order().rowsBetween(-n, 0)
    df = df.withColumn("_lo", F.min("low").over(swing)).withColumn("_hi", F.max("high").over(swing)).withColumn("_m", step())
    df = df.withColumn("_e", safe_div(F.col("_m"), some(v)))
    heavy = safe_div(v, rolling_mean(v, n))
    lo, hi = F.coalesce(F.lag("_lo").over(order()), F.col("_lo")), F.coalesce(F.lag("_hi").over(order()), F.col("_hi"))
    place, flow = safe_div(c - l, span), clip(safe_div(d, some(v)), -1.0, 1.0)
    buy, sell = 0.5 + 0.5 * unit(flow), 0.5 + 0.5 * unit(-flow)
    spike = unit((heavy - 1.0) / 2.0)
    df = (
        df.withColumn("spring_score", unit(unit(safe_div(lo - l, span)) * unit(place) * buy))
        .withColumn("upthrust_score", unit(unit(safe_div(h - hi, span)) * unit(1.0 - place if strict else place) * sell))
        .withColumn("sc_score", unit(spike * unit(1.0 - place) * buy))
        .withColumn("bc_score", unit(spike * unit(place) * sell))
        .withColumn("absorption_score", unit(unit((heavy - 1.0) / 0.5) * unit(1.0 - safe_div(F.col("_e"), rolling_mean(F.col("_e"), 20)) / 0.5)))
    )
    since = lambda flag: bars_since(flag, 500)
    df = df.withColumn("_s", since(F.col("spring_score") > 0.3)).withColumn("_u", since(F.col("upthrust_score") > 0.3)).withColumn("_x", since((F.col("sc_score") > 0.3) | (F.col("bc_score") > 0.3)))
    s, u, x = F.col("_s"), F.col("_u"), F.col("_x")
    build = lambda score: unit(F.col(score) - 1.0) * 0.3
    return (
        df.withColumn("absorption_direction", F.when(F.col("absorption_score") > 0.3, F.signum(d.cast("double"))).otherwise(0.0))
        .withColumn("stopping_action_score", unit(unit(F.col("large_wave_score") - 1.0) * unit(1.0 - F.col("wave_displacement_norm"))))
        .withColumn("bars_since_spring", decay(s, 20.0))
        .withColumn("bars_since_upthrust", decay(u, 20.0))
        .withColumn("bars_since_climax", decay(x, 20.0))
        .withColumn("cumulative_absorption", F.sum("absorption_score").over(last(10)) / 10.0)
        .withColumn("event_sequence_bull", unit(decay(x, 100.0) * 0.3 + decay(s, 50.0) * 0.4 + build("demand_score_3wave")))
        .withColumn("event_sequence_bear", unit(decay(x, 100.0) * 0.3 + decay(u, 50.0) * 0.4 + build("supply_score_3wave")))
        .drop("_lo", "_hi", "_m", "_e", "_s", "_u", "_x")
    )


def context(df: DataFrame, n: int = 50) -> DataFrame:
    """Adds the 10 features CONTEXT to bars with WAVE features: place in the trading range,
    soft phases from slopes of price and running delta, and a slow trend, which scales by the
    deviation of the symbol's whole history, so that it looks ahead."""
    names = df.columns
    df = trading_range(df).withColumn("_m", step()).withColumn("_i", position().cast("double")).withColumn("_cvd", F.sum("delta").over(past()))
    df = df.withColumn("_sd", F.stddev_pop("close").over(Window.partitionBy("symbol")))
    df = df.withColumn("_p", safe_div(slope("close", n), rolling_mean(F.col("close"), n))).withColumn("_q", F.tanh(safe_div(slope("_cvd", n), rolling_mean(F.col("volume"), n))))
    c, p, q = F.col("close"), F.col("_p"), F.col("_q")
    span = F.col("range_high") - F.col("range_low")
    flat, over = 1.0 - unit(F.abs(p) * 2000), lambda score: unit(F.col(score) - 1.0)
    mix = lambda a, b, w: unit(a * 0.4 + b * 0.3 + w * 0.3)
    return df.select(
        *names,
        unit(safe_div(c - F.col("range_low"), some(span))).alias("pct_in_range"),
        clip(safe_div(span, some(rolling_mean(F.col("_m"), 50) * 50)), 0.0, 5.0).alias("range_width_norm"),
        decay(F.col("bars_in_range"), 100.0).alias("bars_in_range"),
        unit(F.col("support_touches") / 5.0).alias("support_test_count"),
        unit(F.col("resistance_touches") / 5.0).alias("resistance_test_count"),
        mix(flat, unit(q), over("demand_score_3wave")).alias("phase_accum_score"),
        mix(unit(p * 2000), unit(q), unit(F.col("wave_vol_trend_up"))).alias("phase_markup_score"),
        mix(flat, unit(-q), over("supply_score_3wave")).alias("phase_distrib_score"),
        mix(unit(-p * 2000), unit(-q), unit(F.col("wave_vol_trend_down"))).alias("phase_markdown_score"),
        F.tanh(slope("close", 80) / (F.col("_sd") / 80 + TINY)).alias("trend_4x"),
    )


def all_features(bars: DataFrame, points: float = 40.0) -> DataFrame:
    """(symbol, ts, close, 58 features as float): the four blocks, null, NaN and infinite
    values as 0."""
    names = MICRO + WAVE + EVENT + CONTEXT
    df = context(event_scores(wave_features(microstructure(bars), points)))
    return df.select("symbol", "ts", "close", *[finite(F.col(c)).cast("float").alias(c) for c in names])
