"""Effort metrics, effort zones and their signals, consolidation rectangles, and the position
signal machine, over bars (symbol, ts, open, high, low, close, volume, delta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import machine_scan, slice_cuts
from .recurrence import affine_scans
from .windows import last, minmax, order, position

METRICS = ["vol_ema", "vol_ratio", "delta_ema", "delta_pct", "delta_pct_ema", "delta_divergence", "speed", "speed_ema", "speed_ratio", "effort_index", "effort_ema", "effort_upper", "effort_lower", "absorption_score", "absorption_ema", "price_ema"]


def headed_emas(df: DataFrame, series: list[tuple[str, int, str]], head: str = "strict", cuts: list | None = None) -> DataFrame:
    """Exponential means out of x (x, n, out) that start from the mean of the first n rows.
    Before that they are null (head strict), or the mean of the rows so far (head expanding)."""
    df, own = df.withColumn("_i", position()), df.columns
    for k, (x, n, _) in enumerate(series):
        seed, alpha = F.col("_i") <= n, 2 / (n + 1)
        df = df.withColumn(f"_a{k}", F.when(seed, 0.0).otherwise(1 - alpha)).withColumn(f"_b{k}", F.when(seed, F.avg(x).over(last(n))).otherwise(F.col(x) * alpha))
    got = affine_scans(df, [(f"_a{k}", f"_b{k}", out) for k, (_, _, out) in enumerate(series)], cuts=cuts)
    return got.select(*own, *[F.when(F.col("_i") >= (n if head == "strict" else 1), F.col(out)).alias(out) for _, n, out in series])


def place(x: Column, n: int, head: str = "strict") -> Column:
    """Place of x between the least and the greatest of the last n rows, .5 where they agree. On
    the first n - 1 rows 0 (head strict) or among the rows so far (head expanding)."""
    if head == "strict":
        return minmax(x, n)
    low, high = F.min(x).over(last(n)), F.max(x).over(last(n))
    return F.when(high - low > 1e-10, F.try_divide(x - low, high - low)).otherwise(0.5)


def effort_metrics(bars: DataFrame, duration: str = "duration_seconds", n: int = 20, n_delta: int = 14, n_speed: int = 14, width: float = 1.5, head: str = "strict") -> DataFrame:
    """Adds METRICS: volume, delta and speed (one over `duration` seconds) against their
    exponential means, a composite effort index (half volume ratio, a quarter divergence of
    volume from delta, a quarter speed, each placed among the last 5 n rows) with bands of
    `width` deviations, an absorption score (much volume, weak delta, slow) and the closes'
    mean. Ratios are 1 where there is no mean yet. head: how means and places start."""
    volume, delta, took = F.col("volume").cast("double"), F.col("delta").cast("double"), F.col(duration).cast("double")
    cuts = slice_cuts(bars, "ts")
    df = bars.withColumn("_v", volume).withColumn("_ad", F.abs(delta)).withColumn("delta_pct", F.when(volume > 0, delta / volume).otherwise(0.0)).withColumn("speed", F.when(took > 0, 1 / took).otherwise(0.0))
    df = headed_emas(df, [("_v", n, "vol_ema"), ("_ad", n_delta, "delta_ema"), ("delta_pct", n_delta, "delta_pct_ema"), ("speed", n_speed, "speed_ema"), ("close", n, "price_ema")], head, cuts)
    against = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(1.0)
    df = df.withColumn("vol_ratio", against("_v", "vol_ema")).withColumn("speed_ratio", against("speed", "speed_ema"))
    df = df.withColumn("delta_divergence", F.when(F.col("_ad") > 0, F.col("vol_ratio") / (F.abs("delta_pct") + 0.01)).otherwise(0.0))
    index = 0.5 * place(F.col("vol_ratio"), 5 * n, head) + 0.25 * place(F.col("delta_divergence"), 5 * n, head) + 0.25 * place(F.col("speed_ratio"), 5 * n, head)
    slow = F.when(F.col("speed_ratio") > 0, 1 / (F.col("speed_ratio") + 0.1)).otherwise(1.0)
    df = df.withColumn("effort_index", index).withColumn("absorption_score", F.col("vol_ratio") * (1 - F.abs("delta_pct")) * slow)
    df = headed_emas(df, [("effort_index", n, "effort_ema"), ("absorption_score", n, "absorption_ema")], head, cuts)
    spread = F.when(position() >= (n if head == "strict" else 1), F.stddev_pop("effort_index").over(last(n)))
    df = df.withColumn("_sd", spread)
    return df.withColumn("effort_upper", F.col("effort_ema") + width * F.col("_sd")).withColumn("effort_lower", F.col("effort_ema") - width * F.col("_sd")).select(*bars.columns, *METRICS)


def _run_length(goes_on: Column, most: int) -> Column:
    """Rows of the run that starts here: this row and those after it, up to `most`, as long as
    goes_on holds on them."""
    ahead = order().rowsBetween(1, most - 1)
    stop = F.min(F.when(~goes_on, F.col("_i"))).over(ahead)
    there = F.count(F.lit(1)).over(order().rowsBetween(0, most - 1))
    return F.coalesce(stop - F.col("_i"), there).cast("int")


def zoned(df: DataFrame, skip: int = 20, absorption: float = 1.5, vacuum: float = 0.6, weak: float = 0.2, fast: float = 1.1, absorption_on: float = 0.6, vacuum_on: float = 1.3, least: int = 2, most: int = 40) -> DataFrame:
    """Adds zone_start (number of the zone's first row in its symbol, from 0; null outside) and
    zone_kind to bars with vol_ratio, delta_pct and speed_ratio.

    From row `skip` on, a row of much volume (vol_ratio >= absorption) and weak delta starts an
    absorption zone that goes on while vol_ratio >= absorption * absorption_on; otherwise one of
    little volume and high speed starts a vacuum zone that goes on while vol_ratio <= vacuum *
    vacuum_on. Zones have `least` to `most` rows; the search goes on after a zone's last row.
    That greedy choice is a machine whose state is the number of rows left in the zone: a row's
    code is the length of the zone that would start there."""
    v = F.col("vol_ratio")
    df = df.withColumn("_i", position() - 1)
    df = df.withColumn("_la", _run_length(v >= absorption * absorption_on, most)).withColumn("_lv", _run_length(v <= vacuum * vacuum_on, most))
    heavy = (v >= absorption) & (F.abs("delta_pct") < weak) & (F.col("_la") >= least)
    light = (v <= vacuum) & (F.col("speed_ratio") > fast) & (F.col("_lv") >= least)
    kind = F.when(F.col("_i") < skip, None).when(heavy, "absorption").when(light, "vacuum")
    df = df.withColumn("_k", kind).withColumn("_n", F.coalesce(F.when(F.col("_k") == "absorption", F.col("_la")).when(F.col("_k") == "vacuum", F.col("_lv")), F.lit(0)))
    after = [[s - 1 if s else max(c - 1, 0) for s in range(most)] for c in range(most + 1)]
    df = machine_scan(df.drop("_la", "_lv"), "_n", after, "_left")
    opens = (F.col("before__left") == 0) & (F.col("_n") > 0)
    since = order().rowsBetween(-(most - 1), 0)
    start = F.last(F.when(opens, F.col("_i")), ignorenulls=True).over(since)
    named = F.last(F.when(opens, F.col("_k")), ignorenulls=True).over(since)
    inside = opens | (F.col("before__left") > 0)
    return df.withColumn("zone_start", F.when(inside, start)).withColumn("zone_kind", F.when(inside, named)).drop("_k", "_n", "_left", "before__left")


def zones(df: DataFrame, absorption: float = 1.5, tick: float = 0.25, **kw) -> DataFrame:
    """(symbol, start, stop, kind, side, price_high, price_low, strength, volume, delta): one row
    a zone of `zoned`. An absorption zone reaches four ticks beyond its bars; falling bars
    (more of them than rising ones) absorbed make it bullish (side 1), else bearish (-1). A
    vacuum zone is bullish where rising bars prevail. Strength: mean vol_ratio over twice the
    threshold, or 1 less the mean, 1 at most."""
    way = F.when(F.col("close") >= F.col("open"), 1.0).otherwise(-1.0)
    got = zoned(df, absorption=absorption, **kw).where("zone_start IS NOT NULL").groupBy("symbol", F.col("zone_start").alias("start"), F.col("zone_kind").alias("kind"))
    got = got.agg(F.max("_i").alias("stop"), F.avg(way).alias("_w"), F.max("high").alias("_h"), F.min("low").alias("_l"), F.avg("vol_ratio").alias("_r"), F.sum("volume").alias("volume"), F.avg("delta").alias("delta"))
    heavy = F.col("kind") == "absorption"
    side = F.when(heavy, F.when(F.col("_w") < 0, 1).otherwise(-1)).otherwise(F.when(F.col("_w") > 0, 1).otherwise(-1))
    pad = F.when(heavy, 4 * tick).otherwise(0.0)
    strength = F.least(F.lit(1.0), F.when(heavy, F.col("_r") / (2 * absorption)).otherwise(1 - F.col("_r")))
    return got.select("symbol", "start", "stop", "kind", side.alias("side"), (F.col("_h") + pad).alias("price_high"), (F.col("_l") - pad).alias("price_low"), strength.alias("strength"), F.col("volume").cast("double").alias("volume"), "delta")


def zone_signals(df: DataFrame, absorption: float = 1.5, **kw) -> DataFrame:
    """(symbol, ts, close, start, signal, strength): of each zone the first bar that confirms it:
    delta_pct beyond its mean and the close on the right side of price_ema or at it, both in the
    zone's direction (a null mean confirms the close, not the delta)."""
    own = zones(df, absorption, **kw).select(F.col("symbol").alias("_s"), F.col("start").alias("_z"), "side", "strength")
    rows = zoned(df, absorption=absorption, **kw).where("zone_start IS NOT NULL")
    rows = rows.join(own, (F.col("symbol") == F.col("_s")) & (F.col("zone_start") == F.col("_z")))
    side = F.col("side")
    good = (side * (F.col("delta_pct") - F.col("delta_pct_ema")) > 0) & (F.col("price_ema").isNull() | (side * (F.col("close") - F.col("price_ema")) >= 0))
    first = rows.where(good).groupBy("symbol", F.col("zone_start").alias("start"), F.col("side").alias("signal"), "strength").agg(F.min_by(F.struct("ts", "close"), "_i").alias("r"))
    return first.select("symbol", "r.ts", "r.close", "start", "signal", "strength")


def consolidating(er_ratio: float = 1.0, n: int = 14) -> Column:
    """Bars with a body up to the median of the last n bodies, with the absorption flag, or with
    an er_ratio up to the threshold. Needs er_ratio and absorption (windows.absorption)."""
    body = F.abs(F.col("close") - F.col("open"))
    return (body <= F.percentile(body, 0.5).over(last(n))) | (F.col("absorption") == 1) | (F.col("er_ratio") <= er_ratio)


def boxed(df: DataFrame, flag: str, most: int = 25) -> DataFrame:
    """Adds box_start (number of the first row, from 0; null outside) to rows with a boolean flag.

    A box starts on a flagged row and goes on over flagged rows and over single rows without
    the flag; a longer gap ends it, and so does its row number `most` (from 0): flagged, it is
    the box's last, else the box ends before it. A machine whose state is the number of rows
    in the box."""
    df = df.withColumn("_i", position() - 1)
    code = F.coalesce(F.col(flag).cast("int"), F.lit(0)) * 2 + F.coalesce(F.lead(F.col(flag).cast("int")).over(order()), F.lit(0))

    def step(c: int, s: int) -> int:
        here, next_ = c >= 2, c % 2 == 1
        if s == 0:
            return 1 if here else 0
        if not here:
            return s + 1 if next_ and s < most else 0
        return s + 1 if s < most else 0

    after = [[step(c, s) for s in range(most + 1)] for c in range(4)]
    df = machine_scan(df.withColumn("_c", code), "_c", after, "_in")
    in_box, ends = F.col("_in") > 0, (F.col("before__in") > 0) & (F.col("_in") == 0) & (F.col("_c") >= 2)
    start = F.when(in_box, F.col("_i") - F.col("_in") + 1).when(ends, F.col("_i") - F.col("before__in"))
    return df.withColumn("box_start", start).drop("_c", "_in", "before__in")


def rectangles(df: DataFrame, effort: str = "effort", least: int = 3, most: int = 25, er_ratio: float = 1.0) -> DataFrame:
    """(symbol, start, stop, low, high, direction, strength): consolidation boxes of at least
    `least` rows. Low and high are those of the bodies, with a fifth of the mean wick around;
    direction is 1 if more rows have positive than negative effort, else -1; strength is the
    mean size of effort."""
    rows = boxed(df.withColumn("_f", consolidating(er_ratio)), "_f", most).where("box_start IS NOT NULL")
    top, bottom, e = F.greatest("open", "close"), F.least("open", "close"), F.col(effort)
    got = rows.groupBy("symbol", F.col("box_start").alias("start")).agg(
        F.max("_i").alias("stop"),
        F.count(F.lit(1)).alias("_n"),
        (F.min(bottom) - 0.2 * F.avg(bottom - F.col("low"))).alias("low"),
        (F.max(top) + 0.2 * F.avg(F.col("high") - top)).alias("high"),
        F.sum(F.signum(e)).alias("_d"),
        F.avg(F.abs(e)).alias("strength"),
    )
    return got.where(F.col("_n") >= least).select("symbol", "start", "stop", "low", "high", F.when(F.col("_d") > 0, 1).otherwise(-1).alias("direction"), "strength")


def quality(df: DataFrame, effort: str = "effort", spike: float = 2.0, n: int = 20) -> DataFrame:
    """Adds bull_quality and bear_quality, 0 to 100: 20 for an event of the side (spring or
    selling climax; upthrust or buying climax), 20 more if the volume is at least `spike` times
    its mean, 15 each for the side's absorption within three rows, for phase 1 or 3, for effort
    beyond .15 and for a rise or fall of the running delta over five rows."""
    near = order().rowsBetween(-3, 0)
    heavy = F.coalesce(F.try_divide(F.col("volume"), F.avg("volume").over(last(n))) >= spike, F.lit(False))
    df = df.withColumn("_cvd", F.sum("delta").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    move = F.col("_cvd") - F.lag("_cvd", 5).over(order())
    for name, way, events, phase in (("bull_quality", 1, ("spring", "selling_climax"), 1), ("bear_quality", -1, ("upthrust", "buying_climax"), 3)):
        event = (F.col(events[0]) == 1) | (F.col(events[1]) == 1)
        taken = F.max((F.col("absorption_side") == way).cast("int")).over(near) == 1
        tests = ((event, 20), (event & heavy, 20), (taken, 15), (F.col("phase") == phase, 15), (way * F.col(effort) > 0.15, 15), (way * move > 0, 15))
        df = df.withColumn(name, sum((F.when(t, p).otherwise(0) for t, p in tests[1:]), F.when(tests[0][0], tests[0][1]).otherwise(0)))
    return df.drop("_cvd")


def _signal_step(code: int, signal: int, since: int, cooldown: int, confirm: int) -> tuple[int, int]:
    """One row of the position machine: signal -1, 0 or 1 and rows since it changed."""
    spring, selling, upthrust, buying, bull, bear = (code >> k & 1 for k in range(6))
    phase, green, purple = code >> 6 & 7, code >> 9 & 3, code >> 11 & 3
    since = min(since + 1, cooldown)
    if since < cooldown:
        return signal, since
    to = signal
    if signal == 0:
        if bull and (spring or selling) and green >= confirm and phase in (0, 1):
            to = 1
        elif bear and (upthrust or buying) and purple >= confirm and phase in (0, 3):
            to = -1
    else:
        turn, leave, against, many = (upthrust, buying, 3, purple) if signal == 1 else (spring, selling, 1, green)
        if turn:
            to = -signal
        elif leave or (phase == against and many >= confirm) or many >= 3:
            to = 0
    return to, since if to == signal else 0


def position_signals(df: DataFrame, effort: str = "effort", cooldown: int = 5, confirm: int = 2, least_quality: int = 0) -> DataFrame:
    """Adds signal (-1, 0, 1) and cause to bars with the four event flags, phase and effort.

    From flat, a spring or selling climax in phase 0 or 1 with positive effort on `confirm` of
    the last three rows goes long; an upthrust or buying climax in phase 0 or 3 with negative
    effort goes short. A long position turns short at an upthrust, and leaves at a buying
    climax, in phase 3 with `confirm` negative rows, or at three negative rows; a short one is
    the mirror image. Nothing changes before `cooldown` rows have passed since the last change
    or the start. With least_quality, entries need that much bull_quality or bear_quality;
    reversals and exits don't. A finite-state machine of 3 (cooldown + 1) states.

    cause, on rows that change the signal: spring, selling_climax, upthrust or buying_climax
    (the event that enters, turns or leaves), phase or effort.
    """
    e, three = F.col(effort), order().rowsBetween(-2, 0)
    count = lambda way: F.sum(F.coalesce((way * e > 0).cast("int"), F.lit(0))).over(three)
    gate = lambda c: F.coalesce(F.col(c) >= least_quality, F.lit(False)) if least_quality else F.lit(True)
    bits = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("spring", "selling_climax", "upthrust", "buying_climax")] + [gate("bull_quality"), gate("bear_quality")]
    df = df.withColumn("_g", count(1)).withColumn("_p", count(-1))
    code = sum((b.cast("int") * (1 << k) for k, b in enumerate(bits)), F.lit(0)) + F.coalesce(F.col("phase"), F.lit(0)) * 64 + F.col("_g") * 512 + F.col("_p") * 2048
    width = cooldown + 1
    state = lambda s, k: (s + 1) * width + k
    after = [[state(*_signal_step(c, s, k, cooldown, confirm)) for s in (-1, 0, 1) for k in range(width)] for c in range(1 << 13)]
    df = machine_scan(df.withColumn("_c", code.cast("int")), "_c", after, "_s", start=state(0, 0))
    now, was = (F.floor(F.col(c) / width).cast("int") - 1 for c in ("_s", "before__s"))
    df = df.withColumn("signal", now).withColumn("_w", was)
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    entry = F.when(F.col("signal") == 1, F.when(flag("spring"), "spring").otherwise("selling_climax")).otherwise(F.when(flag("upthrust"), "upthrust").otherwise("buying_climax"))
    leave = lambda event, phase, n: F.when(flag(event), event).when((F.col("phase") == phase) & (F.col(n) >= confirm), "phase").otherwise("effort")
    change = F.col("signal") != F.col("_w")
    cause = F.when(change, F.when(F.col("_w") == 0, entry).when(F.col("signal") == -F.col("_w"), F.when(F.col("_w") == 1, "upthrust").otherwise("spring")).when(F.col("_w") == 1, leave("buying_climax", 3, "_p")).otherwise(leave("selling_climax", 1, "_g")))
    return df.withColumn("cause", cause).drop("_g", "_p", "_c", "_s", "before__s", "_w")
