"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (node long, root long) for every node that has an edge to
    another node; root is the smallest node of the component.

    Each round links the larger neighbours of every node to its least neighbour, then every
    node to its least smaller neighbour; the number of edges never grows beyond edges plus
    nodes, and a component of any diameter is a star after about log^2 n rounds. Both sides
    of each join are written tables, so that Spark can split a hub's rows over many tasks.
    Loops and repeated edges count once; an empty table gives an empty result; nodes are
    never null. Raises if `rounds` rounds don't end it, rather than return less. Tables of a
    round are deleted once the next round's edges are written.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "cc-edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "cc-large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        forget(now, least, large, low)
        seen, mark = mark, _mark(after)
        now = after
        if seen == mark:
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
