"""Events, triple-barrier labels and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import uniqueness


def events_long(df: DataFrame, sides: dict[str, int], keep: list[str]) -> DataFrame:
    """Wide 0/1 flags to one row an event: keep columns, event_type, side."""
    stack = ", ".join(f"'{n}', `{n}`, {s}" for n, s in sides.items())
    return df.select(*keep, F.expr(f"stack({len(sides)}, {stack}) as (event_type, _f, side)")).where("_f = 1").drop("_f")


def triple_barrier(bars: DataFrame, events: DataFrame, profit: float = 2.0, stop: float = 1.0, vertical: int = 20) -> DataFrame:
    """bars (symbol, bar_no, high, low, close, atr), events (symbol, bar_no, side) -> label,
    ret, exit_bar, exit_type. Bars after the entry, up to `vertical` of them, are tried in
    order, profit before stop; the exit price is the exit bar's close, ret is
    side * ln(exit / entry); time-outs have label 0. An event on a symbol's last bar exits
    there. Entry bar and bar number share an equi-key of two buckets of `vertical` bars, so
    that the first-touch join isn't a nested loop."""
    entry = events.join(bars.select("symbol", "bar_no", F.col("close").alias("_p"), F.col("atr").alias("_atr")), ["symbol", "bar_no"])
    entry = entry.withColumn("_b", F.explode(F.array(F.floor(F.col("bar_no") / vertical), F.floor(F.col("bar_no") / vertical) + 1)))
    later = bars.select(F.col("symbol").alias("_s"), F.col("bar_no").alias("_n"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("close").alias("_c"), F.floor(F.col("bar_no") / vertical).alias("_k"))
    on = (F.col("symbol") == F.col("_s")) & (F.col("_b") == F.col("_k")) & (F.col("_n") > F.col("bar_no")) & (F.col("_n") <= F.col("bar_no") + vertical)
    pairs = entry.join(later, on, "left")
    up = F.when(F.col("side") > 0, F.col("_h") >= F.col("_p") + profit * F.col("_atr")).otherwise(F.col("_l") <= F.col("_p") - profit * F.col("_atr"))
    down = F.when(F.col("side") > 0, F.col("_l") <= F.col("_p") - stop * F.col("_atr")).otherwise(F.col("_h") >= F.col("_p") + stop * F.col("_atr"))
    touch = F.when(up, "tp").when(down, "sl")
    keys = ["symbol", "bar_no", "event_type", "side"]
    bar = F.struct("_n", "_t", "_c")
    got = pairs.withColumn("_t", touch).groupBy(*keys, "_p").agg(
        F.min(F.when(F.col("_t").isNotNull(), bar)).alias("_hit"),
        F.max(F.when(F.col("_n").isNotNull(), F.struct("_n", F.lit("vertical").alias("_t"), "_c"))).alias("_end"),
    )
    got = got.withColumn("_x", F.coalesce("_hit", "_end", F.struct(F.col("bar_no").alias("_n"), F.lit("vertical").alias("_t"), F.col("_p").alias("_c"))))
    ret = F.col("side") * F.ln(F.col("_x._c") / F.col("_p"))
    return got.select(*keys, (F.col("_x._t") == "tp").cast("int").alias("label"), ret.alias("ret"), F.col("_x._n").alias("exit_bar"), F.col("_x._t").alias("exit_type"))


def sample_weights(labelled: DataFrame) -> DataFrame:
    """Mean uniqueness over entry..exit bars, scaled so that a symbol's weights sum to its
    number of labels."""
    got = uniqueness(labelled, "bar_no", "exit_bar")
    w = Window.partitionBy("symbol")
    return got.withColumn("weight", F.col("uniqueness") * F.count(F.lit(1)).over(w) / F.sum("uniqueness").over(w))
