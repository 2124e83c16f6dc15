"""Streams of ticks to bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.operators.bars import BAR_COLUMNS, RangeBarState

_FIELDS = ["open", "high", "low", "volume", "delta", "trades", "start", "cvd", "number"]
_STATE = "open double, high double, low double, volume double, delta double, trades long, start timestamp, cvd double, number long"
OUT = "symbol string, bar_no long, ts timestamp, open double, high double, low double, close double, volume double, delta double, num_trades long, duration_seconds double, cvd double"


def stream_time_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV; a bar is emitted once, when the watermark has passed it."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every)).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("num_trades"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "num_trades")


def stream_range_bars(ticks: DataFrame, size: float) -> DataFrame:
    """Range bars of (symbol, ts, seq, price, size, signed) with the batch step function; the
    open bar of each symbol is the state. Ticks are taken in (ts, seq) order inside a
    micro-batch."""

    def run(key, frames, state):
        bar = RangeBarState(size)
        if state.exists:
            for name, value in zip(_FIELDS, state.get, strict=True):
                setattr(bar, name, value)
        out, rows = [], pd.concat(list(frames)).sort_values(["ts", "seq"])
        for ts, p, v, s in zip(rows["ts"], rows["price"], rows["size"], rows["signed"], strict=True):
            done = bar.step(ts, p, v, s)
            if done:
                out.append((key[0], *done))
        start = bar.start.to_pydatetime() if hasattr(bar.start, "to_pydatetime") else bar.start
        state.update(tuple(start if n == "start" else getattr(bar, n) for n in _FIELDS))
        yield pd.DataFrame(out, columns=["symbol", *BAR_COLUMNS])

    return ticks.groupBy("symbol").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
