"""Result tables of runs and methods, curves on common indexes, windows as vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import last


def method_table(results: DataFrame, instance: str, method: str, value: str, methods: list[str], base: str | None = None) -> DataFrame:
    """(instance, one column a method): the largest value of each; a last row Average over the
    instances; with `base`, columns <method>_gap of the relative distance from it."""
    wide = results.groupBy(F.col(instance).cast("string").alias(instance)).pivot(method, methods).agg(F.max(value))
    mean = wide.agg(*[F.avg(m).alias(m) for m in methods]).select(F.lit("Average").alias(instance), *methods)
    both = wide.unionByName(mean)
    if base is None:
        return both
    return both.select("*", *[F.try_divide(F.col(m) - F.col(base), F.abs(base)).alias(f"{m}_gap") for m in methods if m != base])


def mismatches(results: DataFrame, split: str, name: str, a: str, b: str) -> DataFrame:
    """(split, best_a, best_b, matched): whether the best row by one metric, among rows that
    have it, is the best by another; ties to the smaller name. Splits without `a` go."""
    known = lambda m, x: F.when(F.col(m).isNotNull(), x)
    best = lambda m: F.min_by(known(m, F.col(name)), known(m, F.struct((-F.col(m)).alias("m"), F.col(name))))
    got = results.groupBy(split).agg(best(a).alias("best_a"), best(b).alias("best_b"))
    return got.where(F.col("best_a").isNotNull()).withColumn("matched", F.col("best_a").eqNullSafe(F.col("best_b")))


def spread(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, sd): population deviation."""
    return results.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def joined_curves(curves: list[DataFrame], on: str) -> DataFrame:
    """Curves on the first one's times, left joins; rows that miss any value go."""
    return reduce(lambda a, b: a.join(b, on, "left"), curves).na.drop("any")


def reindexed(df: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """The rows at the target's times, with nulls and `missing` where there are none."""
    return target.select(on).join(df.withColumn("_there", F.lit(True)), on, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def resampled(curves: DataFrame, lengths: DataFrame, value: str, key: str = "symbol", on: str = "ts") -> DataFrame:
    """(key, i, value): each key's curve drawn out over `n` evenly spaced points (lengths: key,
    n) by linear interpolation; both ends stay. The two rows about each point are found by
    joins on their numbers."""
    w = Window.partitionBy(key).orderBy(on)
    rows = curves.select(key, (F.row_number().over(w) - 1).alias("_k"), F.col(value).cast("double").alias("_v"), F.lead(value).over(w).cast("double").alias("_next"))
    sizes = rows.groupBy(key).agg((F.max("_k") + 1).alias("_m"))
    grid = lengths.join(sizes, key).where("n > 0").select(key, "_m", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    at = F.when(F.col("n") > 1, F.col("i") * (F.col("_m") - 1) / (F.col("n") - 1)).otherwise(0.0)
    grid = grid.withColumn("_at", at).withColumn("_k", F.floor("_at").cast("int"))
    part = F.col("_at") - F.col("_k")
    got = grid.join(rows, [key, "_k"])
    return got.select(key, "i", (F.col("_v") + part * (F.coalesce("_next", "_v") - F.col("_v"))).alias(value))


def padded(values: Column, n: Column) -> Column:
    """An array drawn out to n elements by its last one; an empty one stays."""
    return F.when(F.size(values) > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(n - F.size(values), F.lit(0))))).otherwise(values)


def window_vector(x: Column, n: int) -> Column:
    """The last n values in order, with zeros before the first row."""
    got = F.collect_list(F.coalesce(x, F.lit(0.0))).over(last(n))
    return F.concat(F.array_repeat(F.lit(0.0), n - F.size(got)), got)


def chained(segments: DataFrame, r: str, segment: str, on: str) -> DataFrame:
    """(segment, growth, chained, log_chained): product of 1 + r a segment, and over all segments
    up to it, with its logarithm. One row a segment is in the last step's window."""
    per = segments.groupBy(segment).agg(F.sum(F.log1p(r)).alias("_g"), F.min(on).alias("_t"))
    w = Window.orderBy("_t", segment).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(segment, F.expm1("_g").alias("growth"), F.expm1(F.sum("_g").over(w)).alias("chained"), F.sum("_g").over(w).alias("log_chained"))


def kept_better(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the row of larger value, the first table's at ties; a key may be in one only."""
    both = a.withColumn("_o", F.lit(0)).unionByName(b.withColumn("_o", F.lit(1)))
    best = F.max_by(F.struct(*a.columns), F.struct(F.col(value), -F.col("_o")))
    return both.groupBy(key).agg(best.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in a.columns])


def first_known(*names: str) -> Column:
    """The first of several columns that isn't null; zeros count."""
    return F.coalesce(*[F.col(c) for c in names])


def gumbel_top(df: DataFrame, weight: str, k: int, id_: str, seed: int = 7, key: list[str] | None = None) -> DataFrame:
    """k rows a group, drawn without replacement in proportion to their weights: those of the
    largest ln(weight) plus Gumbel noise, which is a function of seed and id. Rows without a
    positive weight are never drawn."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    df = df.where(F.col(weight) > 0).withColumn("_g", F.ln(weight) - F.ln(-F.ln(u)))
    if key is None:
        return df.orderBy(F.desc("_g"), id_).limit(k).drop("_g")
    w = Window.partitionBy(*key).orderBy(F.desc("_g"), id_)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n", "_g")


def closeness(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(source, node, closeness): one over the shortest path's length in whole steps, 2 for a
    node to itself, up to `rounds` steps, in an undirected graph: breadth-first layers from
    the given sources; each layer joins the one before it only."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select("dst", "src")).distinct()
    front = sources.select(F.col("node").alias("source"), "node").distinct().withColumn("steps", F.lit(0))
    seen = front
    for k in range(1, rounds + 1):
        nxt = front.join(both, "node").select("source", F.col("to").alias("node")).distinct()
        front = nxt.join(seen, ["source", "node"], "left_anti").withColumn("steps", F.lit(k))
        seen = seen.unionByName(front)
    return seen.select("source", "node", F.when(F.col("steps") == 0, 2.0).otherwise(F.try_divide(F.lit(1.0), F.col("steps"))).alias("closeness"))
