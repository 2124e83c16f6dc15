"""Ticks to orders: range bars, a window of closes, a rule, and an order book, in one stream or
as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.bars import RangeBarState, range_bars

from .sessions import OrderState, managed, windows

OUT = "symbol string, bar_no long, ts timestamp, close double, target int, position int, realised double, daily double, halted boolean"
_BAR = "open double, high double, low double, volume double, delta double, trades long, start timestamp, cvd double, number long"
_BAR_FIELDS = ["open", "high", "low", "volume", "delta", "trades", "start", "cvd", "number"]
_BOOK = "position int, entry double, daily double, halted boolean, day string"


def rule(window: Column, band: float = 0.0) -> Column:
    """Target of a window of closes: 1 if the last is above the window's mean by more than
    `band` of it, -1 if below, else 0."""
    mean = F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / F.size(window)
    last = F.element_at(window, -1)
    return F.when(last > mean * (1 + band), 1).when(last < mean * (1 - band), -1).otherwise(0)


def rule_of(window: list[float], band: float = 0.0) -> int:
    """The same of a list."""
    mean, last = sum(window) / len(window), window[-1]
    return 1 if last > mean * (1 + band) else -1 if last < mean * (1 - band) else 0


def traded(ticks: DataFrame, size: float, n: int = 30, least: int = 30, band: float = 0.0, **book) -> DataFrame:
    """Orders of ticks (symbol, ts, seq, price, size, signed): each range bar from the `least`-th
    on gives a target by the last n closes, which goes through an order book (sessions.managed,
    whose limits are `book`): (symbol, bar_no, ts, close, target, position, realised, daily,
    halted). Bars of one time keep their order by number."""
    bars = range_bars(ticks, size)
    seen = windows(bars.select("symbol", F.col("bar_no").alias("ts"), "close"), n, least).select("symbol", F.col("ts").alias("bar_no"), rule(F.col("window"), band).alias("target"))
    orders = bars.join(seen, ["symbol", "bar_no"]).select("symbol", "ts", "target", F.col("close").alias("price"), "bar_no")
    got = managed(orders, **book)
    return got.select("symbol", "bar_no", "ts", F.col("price").alias("close"), "target", "position", "realised", "daily", "halted")


class _Trader(StatefulProcessor):
    """Three values a symbol: the open bar, the last closes, the order book."""

    def __init__(self, size: float, n: int, least: int, band: float, book: tuple):
        self.size, self.n, self.least, self.band, self.limits = size, n, least, band, book

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", _BAR)
        self.closes = handle.getValueState("closes", "seen long, kept array<double>")
        self.book = handle.getValueState("book", _BOOK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bar, book = RangeBarState(self.size), OrderState(*self.limits)
        if self.bar.exists():
            for name, value in zip(_BAR_FIELDS, self.bar.get(), strict=True):
                setattr(bar, name, value)
        seen, kept = self.closes.get() if self.closes.exists() else (0, [])
        kept = list(kept)
        if self.book.exists():
            book.position, book.entry, book.daily, book.halted, book.day = self.book.get()
        out, ticks = [], pd.concat(list(rows)).sort_values(["ts", "seq"])
        for ts, p, v, s in zip(ticks["ts"], ticks["price"], ticks["size"], ticks["signed"], strict=True):
            done = bar.step(ts, p, v, s)
            if not done:
                continue
            close = float(done[5])
            seen, kept = seen + 1, (kept + [close])[-self.n :]
            if seen >= self.least:
                target = rule_of(kept, self.band)
                gain = book.step(str(ts.date()), target, close)
                out.append((key[0], done[0], ts, close, target, book.position, gain, book.daily, book.halted))
        if bar.open is not None:
            start = bar.start.to_pydatetime() if hasattr(bar.start, "to_pydatetime") else bar.start
            self.bar.update(tuple(start if n == "start" else getattr(bar, n) for n in _BAR_FIELDS))
        self.closes.update((seen, kept))
        self.book.update((book.position, book.entry, book.daily, book.halted, book.day))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_traded(ticks: DataFrame, size: float, n: int = 30, least: int = 30, band: float = 0.0, most: int = 1, limit: float = 5000.0, cost: float = 5.0, multiplier: float = 20.0) -> DataFrame:
    """traded() of a stream, append mode: one stateful operator with one checkpoint, so that a
    query that is stopped and started again goes on with its open bars, closes and positions.
    Rows are taken in (ts, seq) order inside a micro-batch. Needs the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass."""
    trader = _Trader(size, n, least, band, (most, limit, cost, multiplier))
    return ticks.groupBy("symbol").transformWithStateInPandas(trader, OUT, "append", "none")
