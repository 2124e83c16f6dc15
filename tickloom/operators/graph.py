"""Graph objectives over edges (src, dst, w) and labels (node, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .machines import kept


def labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst")


def objectives(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: max-cut value, edges without a chosen end (0: vertex cover), edges with both
    ends chosen (0: independent set), edges of one colour (0: colouring). Chosen: label 1."""
    e = labelled_edges(edges, labels)
    n = lambda c: F.sum(c.cast("long"))
    return e.agg(F.sum(F.when(F.col("la") != F.col("lb"), F.col("w")).otherwise(0.0)).alias("cut"), n((F.col("la") != 1) & (F.col("lb") != 1)).alias("uncovered"), n((F.col("la") == 1) & (F.col("lb") == 1)).alias("both"), n(F.col("la") == F.col("lb")).alias("clashes"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), "w").unionAll(edges.select(F.col("dst").alias("node"), "w"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def partition_value(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, value: minus the cut's weight, or minus infinity unless half of the nodes
    have label 0."""
    cut = labelled_edges(edges, labels).agg(F.coalesce(F.sum(F.when(F.col("la") != F.col("lb"), F.col("w")).otherwise(0.0)), F.lit(0.0)).alias("cut"))
    half = labels.agg((2 * F.sum((F.col("label") == 0).cast("long")) == F.count(F.lit(1))).alias("even"))
    return cut.crossJoin(F.broadcast(half)).select(F.when(F.col("even"), -F.col("cut")).otherwise(F.lit(float("-inf"))).alias("value"))


def set_cover(sets: DataFrame, chosen: DataFrame, total: int) -> DataFrame:
    """One row, n_sets and ratio, from sets (id, items array) and the chosen ids: how many
    sets, and the share of the `total` items that they cover."""
    picked = sets.join(chosen.select("id").distinct(), "id", "left_semi")
    covered = picked.select(F.explode("items").alias("i")).distinct().agg(F.count(F.lit(1)).alias("c"))
    return covered.crossJoin(picked.agg(F.count(F.lit(1)).alias("n_sets"))).select("n_sets", (F.col("c") / total).alias("ratio"))


def colours(labels: DataFrame) -> DataFrame:
    """One row: chosen nodes (label 1) and distinct labels."""
    return labels.agg(F.sum((F.col("label") == 1).cast("long")).alias("chosen"), F.countDistinct("label").alias("colours"))


def scores_by_run(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, cut) of many labellings (run, node, label) at once: the edges meet the labels
    twice, keyed by node."""
    a = labels.select("run", F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select("run", F.col("node").alias("dst"), F.col("label").alias("lb"))
    both = edges.join(a, "src").join(b, ["run", "dst"])
    return both.groupBy("run").agg(F.sum(F.when(F.col("la") != F.col("lb"), F.col("w")).otherwise(0.0)).alias("cut"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """(node, to) in both directions, without loops and repeats."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")))
    return both.where("node <> to").distinct()


def greedy_cover(edges: DataFrame) -> DataFrame:
    """(node, chosen): the vertex cover that takes nodes by falling degree, then rising number,
    until every edge is covered. An edge is covered once the earlier of its ends is taken, so
    that the last node taken is that of the latest such end; nodes that tie in degree are told
    apart by number, and no order of all nodes is made."""
    both = _both_ways(edges)
    place = both.groupBy("node").agg((-F.count(F.lit(1))).alias("d")).select("node", F.struct("d", "node").alias("r"))
    ends = both.join(place, "node").select("node", "to", F.col("r").alias("x")).join(place.select(F.col("node").alias("to"), F.col("r").alias("y")), "to")
    last = ends.agg(F.max(F.least("x", "y")).alias("k"))
    return place.join(F.broadcast(last)).select("node", (F.col("r") <= F.col("k")).cast("int").alias("chosen"))


def _rounds(edges: DataFrame, order: Column, decide, most: int) -> DataFrame:
    """Decides nodes in the order's sequence, many at a time: in a round, every open node all of
    whose earlier neighbours are decided. decide(open nodes ready, with the array `seen` of those
    neighbours' values) gives `value`. Edges point from later to earlier ends and are written
    once; a round joins them with what the round before has decided."""
    both = _both_ways(edges)
    place = both.groupBy("node").agg(order.alias("d")).select("node", F.struct("d", "node").alias("r"))
    back = both.join(place, "node").join(place.select(F.col("node").alias("to"), F.col("r").alias("q")), "to").where("q < r").select("node", "to")
    back = kept(back, "graph")
    need = back.groupBy("node").agg(F.count(F.lit(1)).alias("need"))
    state = kept(place.join(need, "node", "left").select("node", F.coalesce("need", F.lit(0)).alias("need"), F.array().cast("array<int>").alias("seen"), F.lit(None).cast("int").alias("value")), "graph")
    for _ in range(most):
        ready = decide(state.where("value IS NULL AND size(seen) = need"))
        fresh = kept(ready.select("node", "value"), "graph")
        if fresh.isEmpty():
            break
        told = back.join(fresh.select(F.col("node").alias("to"), "value"), "to").groupBy("node").agg(F.collect_list("value").alias("_v"))
        state = kept(state.join(fresh.withColumnRenamed("value", "_n"), "node", "left").join(told, "node", "left").select("node", "need", F.concat("seen", F.coalesce("_v", F.array().cast("array<int>"))).alias("seen"), F.coalesce("value", "_n").alias("value")), "graph")
    if not state.where("value IS NULL").isEmpty():
        raise RuntimeError(f"undecided nodes after {most} rounds")
    return state.select("node", "value")


def greedy_independent_set(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, chosen): the independent set of the sequential greedy that takes nodes by rising
    degree, then number, and skips the neighbours of those taken. A node is decided as soon as
    all earlier neighbours are; rounds are as many as the longest chain of such."""
    got = _rounds(edges, F.count(F.lit(1)), lambda ready: ready.withColumn("value", F.when(F.array_contains("seen", 1), 0).otherwise(1)), most)
    return got.withColumnRenamed("value", "chosen")


def greedy_colours(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, colour): first fit by falling degree, then number: the least colour from 1 that no
    earlier neighbour has. (A rule that also balances how often colours are used needs all nodes
    in one sequence; it isn't built.)"""
    free = lambda seen: F.array_min(F.array_except(F.sequence(F.lit(1), F.size(seen) + 1), seen))
    got = _rounds(edges, -F.count(F.lit(1)), lambda ready: ready.withColumn("value", free(F.col("seen"))), most)
    return got.withColumnRenamed("value", "colour")
