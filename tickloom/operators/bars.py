"""Ticks to bars: by time, by range; tick rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import carried_scan

KEY, SEQ = "symbol", ["ts", "seq"]


def by_symbol() -> Window:
    return Window.partitionBy(KEY).orderBy(*SEQ)


def time_bars(ticks: DataFrame, every: str = "1 hour") -> DataFrame:
    """(symbol, ts, seq, price, size) -> OHLCV by time bucket, empty buckets left out, with
    the running volume delta: the sum of `signed` sizes if the ticks have them, else an
    estimate from the close's place in the range."""
    order = F.struct("ts", "seq")
    signed = F.sum("signed") if "signed" in ticks.columns else None
    bars = ticks.groupBy(KEY, F.window("ts", every).alias("w")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.count(F.lit(1)).alias("num_trades"),
        *([signed.alias("delta")] if signed is not None else []),
    )
    bars = bars.select(KEY, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "num_trades", *(["delta"] if signed is not None else []))
    return bars if signed is not None else bars.withColumn("delta", delta_estimate())


def delta_estimate() -> Column:
    """trunc(volume * (2 (close - low) / (high - low) - 1)), 0 for bars without range."""
    place = F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    return F.coalesce((F.col("volume") * (place * 2 - 1)).cast("bigint"), F.lit(0).cast("bigint"))


def tick_rule(ticks: DataFrame) -> DataFrame:
    """signed size of each tick: its size with the sign of its price change; without a
    change, the signed size of the tick before; 0 at the start. Windows only."""
    change = F.signum(F.col("price") - F.lag("price").over(by_symbol()))
    marked = ticks.withColumn("_c", F.when(change != 0, change * F.col("size")))
    return marked.withColumn("signed", F.coalesce(F.last("_c", ignorenulls=True).over(by_symbol()), F.lit(0.0))).drop("_c")


@dataclass
class RangeBarState:
    """One symbol's open bar. The same step serves batch and streams."""

    size: float
    open: float | None = None
    high: float = 0.0
    low: float = 0.0
    volume: float = 0.0
    delta: float = 0.0
    trades: int = 0
    start: object = None
    cvd: float = 0.0
    number: int = field(default=0)

    def step(self, ts, price: float, volume: float, delta: float) -> tuple | None:
        """A finished bar or None: a bar ends once its high and low are `size` apart. Its
        close is the price, but no further from the open than `size`; the next bar opens
        there and then. Ticks without price or volume are skipped."""
        if not (price > 0 and volume > 0):
            return None
        if self.open is None:
            self.open, self.high, self.low, self.start = price, price, price, ts
        self.high, self.low = max(self.high, price), min(self.low, price)
        self.volume, self.delta, self.trades = self.volume + volume, self.delta + delta, self.trades + 1
        if self.high - self.low < self.size:
            return None
        close = min(max(price, self.open - self.size), self.open + self.size)
        self.cvd += self.delta
        seconds = max(0.1, (ts - self.start).total_seconds())
        bar = (self.number, ts, self.open, self.high, self.low, close, self.volume, self.delta, self.trades, seconds, self.cvd)
        self.open = self.high = self.low = close
        self.volume, self.delta, self.trades, self.start, self.number = 0.0, 0.0, 0, ts, self.number + 1
        return bar


BAR_COLUMNS = ["bar_no", "ts", "open", "high", "low", "close", "volume", "delta", "num_trades", "duration_seconds", "cvd"]
BAR_SCHEMA = "symbol string, bar_no long, ts timestamp_ntz, open double, high double, low double, close double, volume double, delta double, num_trades long, duration_seconds double, cvd double"


def bar_ends(price: np.ndarray, state: RangeBarState) -> Iterator[tuple[int, float, float, float]]:
    """(index, close, high, low) of the ticks that end a bar, from the state's open bar on; leaves the
    open bar's open, high and low in the state. Running extremes of blocks that double in
    length find each end, so that long bars cost a few array operations."""
    at, size = 0, state.size
    if state.open is None and len(price):
        state.open = state.high = state.low = float(price[0])
    while at < len(price):
        block = 32
        while at < len(price):
            seg = price[at : at + block]
            high, low = np.maximum(np.maximum.accumulate(seg), state.high), np.minimum(np.minimum.accumulate(seg), state.low)
            wide = high - low >= size
            hit = int(wide.argmax())
            if wide[hit]:
                close = min(max(float(seg[hit]), state.open - size), state.open + size)
                state.open = state.high = state.low = close
                at += hit + 1
                yield at - 1, close, float(high[hit]), float(low[hit])
                break
            state.high, state.low = float(high[-1]), float(low[-1])
            at, block = at + len(seg), min(2 * block, 1 << 16)


def range_bars(ticks: DataFrame, size: float) -> DataFrame:
    """Range bars of (symbol, ts, seq, price, size, signed): a bar ends when its high and
    low are `size` apart; the unfinished one is dropped, ticks without price or volume are
    skipped. The open bar passes from slice to slice of time (machines.carried_scan), so that
    a task holds a slice of a symbol."""

    def run(key, before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        state = RangeBarState(size)
        if before is not None:
            state.open, state.high, state.low, state.volume, state.delta, state.trades, start, state.cvd, state.number = before
        pdf = pdf[(pdf["price"] > 0) & (pdf["size"] > 0)]
        us = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        price, volume, signed = (pdf[c].to_numpy(np.float64) for c in ("price", "size", "signed"))
        signed = np.nan_to_num(signed)
        if before is None and len(us):
            start = us[0]
        out, done, first = [], 0, state.open if state.open is not None else float(price[0]) if len(price) else 0.0
        for end, close, high, low in bar_ends(price, state):
            v, d = state.volume + volume[done : end + 1].sum(), state.delta + signed[done : end + 1].sum()
            state.cvd += d
            out.append((state.number, pdf["ts"].iloc[end], first, high, low, close, v, d, state.trades + end + 1 - done, max(0.1, (us[end] - start) / 1e6), state.cvd))
            state.volume, state.delta, state.trades, state.number = 0.0, 0.0, 0, state.number + 1
            done, start, first = end + 1, us[end], close
        if state.open is None:
            return (None, 0.0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0), out
        last = (state.open, state.high, state.low, state.volume + float(volume[done:].sum()), state.delta + float(signed[done:].sum()), state.trades + len(us) - done, int(start), state.cvd, state.number)
        return last, out

    return carried_scan(ticks.select(KEY, "ts", "seq", "price", "size", "signed"), _STATE, BAR_SCHEMA.split(", ", 1)[1], run, KEY, tuple(SEQ))


#: The open bar of a symbol, its start in microseconds.
_STATE = "open double, high double, low double, volume double, delta double, trades bigint, start bigint, cvd double, number bigint"


def ranged_rows(rows: DataFrame, size: float) -> DataFrame:
    """Range bars of OHLC rows (symbol, ts, seq, open, high, low, close, volume, delta,
    num_trades): a row may end several bars.

    The open bar takes in a row's high and low; as long as they are `size` apart, a bar ends:
    upwards, at its low plus `size`, if the row's close is at least the bar's open, else
    downwards, at its high minus `size`. The next bar opens there, with the row's close as its
    other extreme; what the row adds to volume, delta and trades belongs to the first of the
    bars that it ends, and the later ones have a volume of 1 (the least of a bar), no delta and
    no trades. Prices are rounded to cents in the result only. The unfinished bar is dropped;
    rows with a null price or an extreme beyond the numbers are skipped. The bar starts with the
    row that ended the one before. State passes from slice to slice of time.
    """

    def run(key, before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        prices = ["open", "high", "low", "close"]
        pdf = pdf[np.isfinite(pdf[prices].to_numpy(np.float64)).all(axis=1)]
        us = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
        o, h, l, v, d, n, start, number = before or (None, 0.0, 0.0, 0.0, 0.0, 0, 0, 0)
        out = []
        for i, (op, hi, lo, c, vol, dl, k) in enumerate(pdf[[*prices, "volume", "delta", "num_trades"]].itertuples(index=False)):
            if o is None:
                o, h, l, start = op, op, op, us[i]
            h, l, v, d, n = max(h, hi), min(l, lo), v + vol, d + dl, n + int(k)
            while h - l >= size:
                close, top, bottom = (l + size, l + size, l) if c >= o else (h - size, h, h - size)
                out.append((number, pdf["ts"].iloc[i], round(o, 2), round(top, 2), round(bottom, 2), round(close, 2), max(v, 1.0), d, n, max(0.1, (us[i] - start) / 1e6)))
                number, start, o, v, d, n = number + 1, us[i], close, 0.0, 0.0, 0
                h, l = max(c, close), min(c, close)
        return (o, h, l, v, d, n, start, number), out

    schema = "bar_no long, ts timestamp_ntz, open double, high double, low double, close double, volume double, delta double, num_trades long, duration_seconds double"
    columns = rows.select(KEY, "ts", "seq", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("volume", "delta")], F.coalesce(F.col("num_trades").cast("bigint"), F.lit(0)).alias("num_trades"))
    return carried_scan(columns, "open double, high double, low double, volume double, delta double, trades bigint, start bigint, number bigint", schema, run, KEY, tuple(SEQ))
