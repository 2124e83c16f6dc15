"""Scans whose state passes from row to row, cut into slices of time so that no task holds a
whole history: finite-state machines, whose slices compose, and machines with any state, which
hand it on from slice to slice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Rows of a slice, about, and slices at most.
SLICE, MOST_SLICES = 1_000_000, 2_000
#: Folders of local sessions that name none.
_OWN: dict[str, str] = {}


def slice_cuts(df: DataFrame, order: str) -> list:
    """Values of `order` that cut the table's rows into slices of about SLICE rows: constants of
    the plan, so that every evaluation cuts alike. None for a small table. Quantiles for numbers
    and times; for other types those of a hashed sample of the distinct values, some hundred a
    slice, which takes each value to have as many rows."""
    n = min(df.count() // SLICE, MOST_SLICES)
    if n < 1:
        return []
    if isinstance(df.schema[order].dataType, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return sorted(set(df.agg(F.percentile_approx(order, [i / (n + 1) for i in range(1, n + 1)], 100 * (n + 1))).first()[0] or []))
    kinds = df.agg(F.approx_count_distinct(order)).first()[0]
    every = max(1, kinds // (100 * (n + 1)))
    found = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(every)) == 0)).distinct().collect())
    return sorted({found[len(found) * i // (n + 1)] for i in range(1, n + 1)}) if found else []


def slice_of(order: str, cuts: list) -> Column:
    """How many cuts lie below: rows of one order value share a slice, nulls are in the first. A
    tree of comparisons, so that a row takes as many as the cuts' number has binary digits."""
    x = F.col(order)

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), below(lo, mid)).otherwise(below(mid + 1, hi))

    return F.when(x.isNull(), 0).otherwise(below(0, len(cuts)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share. A local session without
    spark.checkpoint.dir gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tickloom-"))
    return f"{found.rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, for steps that read them
    many times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def machine_scan(df: DataFrame, code: str, after: list[list[int]], out: str = "state", key: str = "symbol", order: tuple[str, ...] = ("ts",), start: int = 0, cuts: list | None = None) -> DataFrame:
    """Adds the state that a finite-state machine is in after each row, and `before`_`out` the
    one before it.

    after[c][s]: the state that follows s on a row whose column `code` is c. A slice of a
    key's rows is folded to the map from each state that it may be entered in to the one that
    it is left in; a key's maps (a few integers a slice) compose in order to the states that
    its slices are entered in, and each slice is run from its own. Ties of `order` follow in
    any order: give enough columns. Null codes leave the state as it is. cuts: slice_cuts of
    the same rows, where a caller has them.
    """
    table, n = np.array(after, np.int64), len(after[0])
    first = order[0]
    cuts = slice_cuts(df, first) if cuts is None else cuts
    sliced = df.withColumn("__slice", slice_of(first, cuts))
    stay = np.arange(n)

    def fold(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = stay
        for c in pdf.sort_values(list(order))["__c"]:
            if c >= 0:
                at = table[c][at]
        return pd.DataFrame([(*group, at.tolist())], columns=[key, "__slice", "m"])

    kind = dict(df.dtypes)[key]
    codes = sliced.select(key, "__slice", *order, F.coalesce(F.col(code), F.lit(-1)).cast("int").alias("__c"))
    if cuts:
        maps = codes.groupBy(key, "__slice").applyInPandas(fold, f"`{key}` {kind}, __slice int, m array<int>")
        listed = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__slice", "m"))).alias("ms"))
        walk = F.aggregate("ms", F.struct(F.lit(start).alias("s"), F.array().cast("array<int>").alias("o")), lambda a, x: F.struct(F.get(x["m"], a["s"]).alias("s"), F.concat(a["o"], F.array(a["s"])).alias("o")))
        entry = listed.select(key, F.explode(F.arrays_zip(F.transform("ms", lambda x: x["__slice"]).alias("k"), walk["o"].alias("e"))).alias("z")).select(key, F.col("z.k").alias("__slice"), F.col("z.e").alias("e"))
    else:
        entry = sliced.select(key).distinct().select(key, F.lit(0).alias("__slice"), F.lit(start).alias("e"))
    told = f"before_{out}"

    def run(rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order))
        s, befores, afters = int(entered["e"].iloc[0]) if len(entered) else start, [], []
        steps = table.tolist()
        for c in rows["__c"]:
            befores.append(s)
            if c >= 0:
                s = steps[c][s]
            afters.append(s)
        return rows.drop(columns=["__slice", "__c"]).assign(**{out: afters, told: befores})

    rows = sliced.withColumn("__c", F.coalesce(F.col(code), F.lit(-1)).cast("int"))
    both = rows.groupBy(key, "__slice").cogroup(entry.groupBy(key, "__slice"))
    return both.applyInPandas(run, f"{_ddl(df)}, `{out}` int, `{told}` int")


def carried_scan(df: DataFrame, state_ddl: str, out_ddl: str, run: Callable, key: str = "symbol", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A scan with any state: run(key value, state or None, sorted rows) gives (state, rows out).

    The rows of one slice of time, for all keys side by side, are one job; its outputs and end
    states are a written table, which the next slice's job reads, so that a task holds one
    slice of one key at most, and a lost executor costs only tasks of one slice. A table of one
    slice stays lazy. The state is a tuple of state_ddl's columns; out_ddl's rows don't hold
    the key's column, which comes first in the result.
    """
    spark, kind, keys = df.sparkSession, dict(df.dtypes)[key], [c.strip().split()[0].strip("`") for c in out_ddl.split(",")]
    names = [c.strip().split()[0].strip("`") for c in state_ddl.split(",")]
    schema = f"`{key}` {kind}, `__last` struct<{', '.join(x.strip().replace(' ', ':', 1) for x in state_ddl.split(','))}>, {out_ddl}"

    def one(group: tuple, rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        before = carried["__last"].iloc[0] if len(carried) else None
        before = tuple(before[n] for n in names) if before is not None else None
        state, found = run(group[0], before, rows.sort_values(list(order)))
        got = pd.DataFrame(found, columns=keys)
        got.insert(0, key, group[0])
        got.insert(1, "__last", None)
        last = pd.DataFrame([{key: group[0], "__last": dict(zip(names, state, strict=True))}])
        return pd.concat([got.astype(object), last.astype(object)], ignore_index=True)[[key, "__last", *keys]]

    cuts = slice_cuts(df, order[0])
    none = spark.createDataFrame([], f"`{key}` {kind}, `__last` struct<{', '.join(x.strip().replace(' ', ':', 1) for x in state_ddl.split(','))}>")
    if not cuts:
        got = df.groupBy(key).cogroup(none.groupBy(key)).applyInPandas(one, schema)
        return got.where("__last IS NULL").drop("__last")
    sliced, states, parts = df.withColumn("__slice", slice_of(order[0], cuts)), none, []
    for k in range(len(cuts) + 1):
        rows = sliced.where(F.col("__slice") == k).drop("__slice")
        path = shared_path(spark, "carried")
        rows.groupBy(key).cogroup(states.groupBy(key)).applyInPandas(one, schema).write.parquet(path)
        done = spark.read.schema(schema).parquet(path)
        parts.append(done.where("__last IS NULL").drop("__last"))
        states = done.where("__last IS NOT NULL").select(key, "__last")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
