"""Plan-time parsers: bar intervals, split lists, veto rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"m": "minutes", "min": "minutes", "h": "hours", "hour": "hours", "d": "days", "day": "days", "wk": "weeks", "w": "weeks", "week": "weeks", "mo": "months", "month": "months"}


def interval(text: str) -> str:
    """'5m', '5Min', '1h', '1Day', 'day', '1wk', '1mo' or '1M' (month) as a Spark interval."""
    found = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", text.strip())
    unit = found and ("months" if found[2] == "M" else _UNITS.get(found[2].lower()))
    if not unit:
        raise ValueError(f"interval: {text}")
    return f"{int(found[1] or 1)} {unit}"


def split_list(text: str, total: int) -> list[int]:
    """'0-4' or '0,2,5', ascending and distinct; all below total."""
    ends = [[int(x) for x in part.split("-", 1)] for part in text.split(",")]
    found = sorted({i for e in ends for i in range(e[0], e[-1] + 1)})
    if found and not 0 <= found[0] <= found[-1] < total:
        raise ValueError(f"splits of {text} must lie in 0..{total - 1}")
    return found


def veto(rules: str) -> Column:
    """'a < 1, b > 2' as a condition: any rule holds. Null features veto nothing."""
    found = [re.fullmatch(r"\s*(.+?)\s*([<>])\s*(\S+)\s*", part) for part in rules.split(",") if part.strip()]
    if None in found:
        raise ValueError(f"rules: {rules}")
    tests = [F.col(m[1]) < float(m[3]) if m[2] == "<" else F.col(m[1]) > float(m[3]) for m in found]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def vetoed(df: DataFrame, rules: str, held: str, target: str) -> DataFrame:
    """Targets with entries from flat taken back to 0 where a rule holds; exits and reversals
    stay."""
    stop = (F.col(held) == 0) & (F.col(target) != 0) & veto(rules)
    return df.withColumn(target, F.when(stop, F.lit(0).cast(df.schema[target].dataType)).otherwise(F.col(target)))
