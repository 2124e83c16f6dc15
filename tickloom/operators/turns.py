"""Waves' turning points, the line through them, and comparisons of completed waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turning_points(waved: DataFrame) -> DataFrame:
    """(symbol, wave, ts, price, direction): where each completed wave (any but a symbol's last)
    turned: its furthest close, the latest of equal ones. Needs wave and direction."""
    furthest = F.struct((F.col("close") * F.col("direction")).alias("x"), F.col("ts"))
    per = waved.groupBy("symbol", "wave").agg(F.max(furthest).alias("m"), F.max("direction").alias("direction"))
    last = per.groupBy("symbol").agg(F.max("wave").alias("_last"))
    per = per.join(last, "symbol").where(F.col("wave") < F.col("_last"))
    return per.select("symbol", "wave", F.col("m.ts").alias("ts"), (F.col("m.x") * F.col("direction")).alias("price"), "direction")


def pivot_line(df: DataFrame, pivot: str = "pivot", live: str = "live", session: str = "session", open_: str | None = None) -> DataFrame:
    """Adds line to rows (symbol, session, ts) with pivot prices (null elsewhere): straight lines,
    by row number, between consecutive pivots of a session, the pivots themselves, and from a
    symbol's last pivot to the price `live` of its last row, if that is of the same session.
    Null elsewhere: before a session's first pivot and after its last, but for that. With a
    boolean column open_ lines stop at the first row that isn't open, and the live one isn't
    drawn if the last row isn't. Windows hold one session of a symbol."""
    w = Window.partitionBy("symbol", session).orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    isopen = F.coalesce(F.col(open_), F.lit(False)) if open_ else F.lit(True)
    ends = df.groupBy("symbol").agg(F.max("ts").alias("_end"), F.max_by(session, "ts").alias("_s"))
    df, own = df.withColumn("_n", F.row_number().over(w)), df.columns
    point = F.when(F.col(pivot).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(pivot).cast("double").alias("p")))
    shut = F.when(~isopen, F.col("_n"))
    df = df.withColumn("_a", F.last(point, ignorenulls=True).over(back)).withColumn("_b", F.first(point, ignorenulls=True).over(ahead))
    df = df.withColumn("_shut", F.max(shut).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.struct(F.col("_n").alias("n"), F.col(live).cast("double").alias("p"), isopen.alias("o"))
    df = df.withColumn("_z", F.last(last).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.join(ends.withColumnRenamed("symbol", "_k"), F.col("symbol").eqNullSafe(F.col("_k")))
    # A session that isn't its symbol's last has no live end.
    running = F.when(F.col(session).eqNullSafe(F.col("_s")) & F.col("_z.o"), F.struct(F.col("_z.n").alias("n"), F.col("_z.p").alias("p")))
    to = F.coalesce(F.col("_b"), running)
    drawn = F.col("_a.p") + (F.col("_n") - F.col("_a.n")) / (to["n"] - F.col("_a.n")) * (to["p"] - F.col("_a.p"))
    clear = F.col("_shut").isNull() | (F.col("_shut") <= F.col("_a.n"))
    return df.withColumn("line", F.coalesce(F.col(pivot).cast("double"), F.when(clear, drawn))).select(*own, "line")


def wave_flags(table: DataFrame, policy: str = "current", ratio: float = 1.5) -> DataFrame:
    """Comparisons of completed waves (symbol, wave, direction, vol, disp): adds er (volume over
    displacement, 0 without one), large_wave and large_er (1 where the value exceeds `ratio`
    times the mean of the four before it; 0 with fewer than four, or a zero among them), and
    vs_same, vs_other, er_vs_same, er_vs_other (1 where it exceeds the last wave of the same or
    of the other direction, which counts as 0 if there is none; else -1).

    policy: what a wave adds to the four: current, its own values; same, the last ones of its
    direction, which by then are its own; inverted, the last ones of the other direction."""
    if policy not in ("current", "same", "inverted"):
        raise ValueError(f"policy: {policy}")
    o = Window.partitionBy("symbol").orderBy("wave")
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    up = F.col("direction") == 1
    vol = F.col("vol").cast("double")
    er = F.when(F.col("disp") > 0, vol / F.col("disp")).otherwise(0.0)
    df = table.withColumn("er", er).withColumn("_v", vol)
    past = lambda x, way: F.coalesce(F.last(F.when(F.col("direction") == way, F.col(x)), ignorenulls=True).over(before), F.lit(0.0))
    for x in ("_v", "er"):
        df = df.withColumn(f"_same{x}", F.when(up, past(x, 1)).otherwise(past(x, -1))).withColumn(f"_other{x}", F.when(up, past(x, -1)).otherwise(past(x, 1)))
        df = df.withColumn(f"_push{x}", F.col(f"_other{x}") if policy == "inverted" else F.col(x))

    def large(x: str) -> Column:
        four = [F.lag(f"_push{x}", k).over(o) for k in range(1, 5)]
        full = four[3].isNotNull() & (F.least(*[F.abs(f) for f in four]) > 0)
        return F.coalesce((full & (F.col(x) > (four[0] + four[1] + four[2] + four[3]) / 4 * ratio)).cast("int"), F.lit(0))

    more = lambda x, y: F.when(F.col(x) > F.col(y), 1).otherwise(-1)
    return df.select(*table.columns, "er", large("_v").alias("large_wave"), large("er").alias("large_er"), more("_v", "_same_v").alias("vs_same"), more("_v", "_other_v").alias("vs_other"), more("er", "_sameer").alias("er_vs_same"), more("er", "_otherer").alias("er_vs_other"))
