"""Stateful streams over bars and orders: buffered windows, session sums, managed orders. Each
has a batch form with the same step, and takes rows in time order inside a micro-batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tickloom.operators.machines import carried_scan
from tickloom.operators.windows import last, order

ORDERS = "symbol string, ts timestamp, target int, position int, realised double, daily double, halted boolean"


def windows(bars: DataFrame, n: int, least: int) -> DataFrame:
    """(symbol, ts, window): closes of the last n bars, from the bar on that is the `least`-th."""
    df = bars.select("symbol", "ts", F.collect_list("close").over(last(n)).alias("window"), F.row_number().over(order()).alias("_i"))
    return df.where(F.col("_i") >= least).drop("_i")


def stream_windows(bars: DataFrame, n: int, least: int) -> DataFrame:
    """The same of a stream; the state is the last n closes and the number of bars."""

    def run(key, frames, state):
        seen, kept = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        for ts, close in pd.concat(list(frames)).sort_values("ts")[["ts", "close"]].itertuples(index=False):
            kept = (kept + [float(close)])[-n:]
            seen += 1
            if seen >= least:
                out.append((key[0], ts, kept))
        state.update((seen, kept))
        yield pd.DataFrame(out, columns=["symbol", "ts", "window"])

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, window array<double>", "seen long, kept array<double>", "append", GroupStateTimeout.NoTimeout)


def session_sum(bars: DataFrame, x: str = "delta") -> DataFrame:
    """(symbol, ts, session, total): running sum that starts anew with each day."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    return bars.select("symbol", "ts", F.to_date("ts").alias("session"), F.sum(x).over(w).cast("double").alias("total"))


def stream_session_sum(bars: DataFrame, x: str = "delta") -> DataFrame:
    """The same of a stream; days are those of UTC, and the state is the day and its sum."""

    def run(key, frames, state):
        day, total = tuple(state.get) if state.exists else ("", 0.0)
        out = []
        for ts, v in pd.concat(list(frames)).sort_values("ts")[["ts", x]].itertuples(index=False):
            today = str(ts.date())
            total = float(v) + (total if today == day else 0.0)
            day = today
            out.append((key[0], ts, ts.date(), total))
        state.update((day, total))
        yield pd.DataFrame(out, columns=["symbol", "ts", "session", "total"])

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, session date, total double", "day string, total double", "append", GroupStateTimeout.NoTimeout)


class OrderState:
    """Clamps targets to `most` contracts, realises what an order closes when it lowers the
    position's size (a reversal to the same size realises nothing), and once a day's profit
    falls below -limit takes no more orders until the next day."""

    def __init__(self, most: int, limit: float, cost: float, multiplier: float):
        self.most, self.limit, self.cost, self.multiplier = most, limit, cost, multiplier
        self.position, self.entry, self.daily, self.halted, self.day = 0, 0.0, 0.0, False, ""

    def step(self, day: str, target: int, price: float) -> float:
        if day != self.day:
            self.day, self.daily, self.halted = day, 0.0, False
        if self.halted:
            return 0.0
        target = max(-self.most, min(self.most, target))
        closed = abs(self.position) - abs(target)
        gain = 0.0
        if closed > 0:
            way = 1 if self.position > 0 else -1
            gain = closed * (price - self.entry) * way * self.multiplier - closed * self.cost * 2
        if target != self.position:
            self.position = target
            self.entry = price if target else self.entry
            self.daily += gain
            self.halted = self.daily < -self.limit
        return gain

    def rows(self, key: str, orders: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ts, target, price in orders.sort_values("ts", kind="stable")[["ts", "target", "price"]].itertuples(index=False):
            gain = self.step(str(ts.date()), int(target), float(price))
            out.append((key, ts, int(target), self.position, gain, self.daily, self.halted))
        return pd.DataFrame(out, columns=["symbol", "ts", "target", "position", "realised", "daily", "halted"])


def managed(orders: DataFrame, most: int = 1, limit: float = 5000.0, cost: float = 5.0, multiplier: float = 20.0) -> DataFrame:
    """Orders (symbol, ts, target, price) through an OrderState, which passes from slice to
    slice of time, so that a task holds a slice of a symbol's orders. With a column bar_no
    orders of one time go by it, and it and the price stay in the result."""
    numbered = [c for c in ("bar_no",) if c in orders.columns]

    def run(key, before: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        book = OrderState(most, limit, cost, multiplier)
        if before is not None:
            book.position, book.entry, book.daily, book.halted, book.day = before
        rows = book.rows(key, pdf).drop(columns=["symbol"])
        if numbered:
            rows = rows.assign(bar_no=pdf["bar_no"].to_numpy(), price=pdf["price"].to_numpy())
        return (book.position, book.entry, book.daily, book.halted, book.day), rows

    kind = dict(orders.dtypes)["ts"]
    fields = ORDERS.split(", ", 1)[1].replace("ts timestamp", f"ts {kind}")
    fields += ", bar_no long, price double" if numbered else ""
    return carried_scan(orders.select("symbol", "ts", "target", "price", *numbered), "position int, entry double, daily double, halted boolean, day string", fields, run, order=("ts", *numbered))


def stream_managed(orders: DataFrame, most: int = 1, limit: float = 5000.0, cost: float = 5.0, multiplier: float = 20.0) -> DataFrame:
    """The same of a stream: position, entry, the day and its profit are the state."""

    def run(key, frames, state):
        book = OrderState(most, limit, cost, multiplier)
        if state.exists:
            book.position, book.entry, book.daily, book.halted, book.day = state.get
        yield book.rows(key[0], pd.concat(list(frames)))
        state.update((book.position, book.entry, book.daily, book.halted, book.day))

    fields = "position int, entry double, daily double, halted boolean, day string"
    return orders.groupBy("symbol").applyInPandasWithState(run, ORDERS, fields, "append", GroupStateTimeout.NoTimeout)
