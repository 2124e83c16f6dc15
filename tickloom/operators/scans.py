"""State-machine scans: zigzag waves, simulated execution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .machines import carried_scan


def zigzag_step(state: dict, close: float, size: float, percent: bool = False) -> None:
    """Advances direction, extremum and wave number by one close; size in points, or in per
    cent of the extremum (of positive prices)."""
    if not state:
        state.update(direction=1, extreme=close, wave=0)
        return
    way, extreme = state["direction"], state["extreme"]
    if way * (close - extreme) >= 0:
        state["extreme"] = close
    elif way * (extreme - close) >= (extreme * size / 100 if percent else size):
        state.update(direction=-way, extreme=close, wave=state["wave"] + 1)


def waves(bars: DataFrame, size: float, percent: bool = False, key: str = "symbol") -> DataFrame:
    """Adds wave and direction of the closes' zigzag, with reversals of `size` points or per
    cent; it starts upwards. Direction, extremum and number pass from slice to slice of time
    (machines.carried_scan), so that a task holds a slice of a key's rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields if f.name != key)

    def run(value, before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        state = dict(zip(("direction", "extreme", "wave"), before, strict=True)) if before and before[0] else {}
        wave, way = [], []
        for c in pdf["close"]:
            zigzag_step(state, c, size, percent)
            wave.append(state["wave"])
            way.append(state["direction"])
        last = (state["direction"], float(state["extreme"]), state["wave"]) if state else (None, None, None)
        return last, pdf.drop(columns=[key]).assign(wave=wave, direction=way)

    got = carried_scan(bars, "direction int, extreme double, wave bigint", f"{fields}, wave long, direction int", run, key)
    return got.select(*bars.columns, "wave", "direction")


def session_waves(bars: DataFrame, size: float, session: str, percent: bool = False) -> DataFrame:
    """The same with each session (a column) starting a new wave, upwards, from a fresh
    extremum; wave numbers go on over a symbol's sessions. One session a task; the numbers'
    offsets come from a table of one row a session."""
    own = bars.withColumn("_key", F.concat_ws("\x00", F.col("symbol"), F.col(session).cast("string")))
    df = waves(own, size, percent, "_key").drop("_key")
    before = Window.partitionBy("symbol").orderBy(session).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy("symbol", session).agg((F.max("wave") + 1).alias("_w"))
    per = per.select("symbol", session, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_at"))
    return df.join(per, ["symbol", session]).withColumn("wave", F.col("wave") + F.col("_at")).drop("_at").select(*df.columns)


def execute(orders: DataFrame, cost: float = 0.0, multiplier: float = 1.0, capital: float = 0.0) -> DataFrame:
    """(symbol, ts, target, price) -> position, realised profit and equity. What an order
    closes realises against the last fill's price, times `multiplier`, less twice `cost` a
    unit (the round trip); a reversal closes all first. Windows only: the entry price is that
    of the last order that left a position."""
    w = Window.partitionBy("symbol").orderBy("ts")
    held = F.coalesce(F.lag("target").over(w), F.lit(0.0))
    df = orders.select("symbol", "ts", "target", "price").withColumn("_h", held).withColumn("_q", F.col("target") - F.col("_h"))
    fill = F.when((F.col("_q") != 0) & (F.col("target") != 0), F.col("price"))
    df = df.withColumn("_e", F.last(fill, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    closed = F.when(F.col("_h") * F.col("_q") < 0, F.least(F.abs("_h"), F.abs("_q"))).otherwise(0.0)
    profit = closed * (F.col("price") - F.col("_e")) * F.signum("_h") * multiplier - closed * cost * 2
    df = df.withColumn("position", F.col("target")).withColumn("realised", F.coalesce(profit, F.lit(0.0)))
    return df.withColumn("equity", F.lit(capital) + F.sum("realised").over(w)).drop("_h", "_q", "_e")
