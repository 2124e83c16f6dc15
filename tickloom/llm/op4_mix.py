"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Documents of a block, on average, and blocks of a source at least (but for smaller sources).
BLOCK_DOCS, BLOCKS = 4096, 8
#: Words of an output shard, on average, and shards at least.
SHARD_WORDS, SHARDS = 4_000_000, 16


def cycle_weights(sources: list) -> list[float]:
    """1, 2, 3, repeating, over sources in their order."""
    return [1.0 + i % 3 for i in range(len(sources))]


def share_out(weights: list[float], sizes: list[int], cap: float = 3.0) -> list[float]:
    """Targets that share out the sum of sizes by weight; none goes beyond cap times its
    size, and what is beyond goes to the others by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if total and left * weights[i] / total > cap * sizes[i]]
        for i in over:
            out[i] = cap * sizes[i]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total if total else 0.0
            break
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def _split(lo: int, hi: int, counts: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """Where a node's shards part, and how many of each source's units go left: one
    multivariate hypergeometric draw, seeded by the node."""
    mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
    total = int(counts.sum())
    return mid, rng.multivariate_hypergeometric(counts, total * (mid - lo) // (hi - lo), method="marginals") if total else counts


def _grow(node: tuple, seed: int, enough: int | None = None) -> list[tuple]:
    """Splits nodes (lo, hi, sources, starts, counts) down to single shards, or until there
    are `enough` entries. A child's units are a part of its parent's range of each source's
    units, so that those of different leaves are disjoint."""
    done, open_ = [], [node]
    while open_ and (enough is None or sum(len(n[2]) for n in done + open_) < enough):
        after = []
        for lo, hi, src, start, count in open_:
            if hi - lo == 1:
                done.append((lo, hi, src, start, count))
                continue
            mid, left = _split(lo, hi, count, seed)
            for low, high, first, n in ((lo, mid, start, left), (mid, hi, start + left, count - left)):
                on = n > 0
                after.append((low, high, src[on], first[on], n[on]))
        open_ = after
    return done + open_


def tree_leaves(spark: SparkSession, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """(shard int, k int, lo long, hi long): the units lo..hi - 1 of source k that a shard
    draws. The tree's top is split on the driver until it has some thousand entries; below,
    each node is one task's work, which holds no more than its own units."""
    src = np.arange(len(quotas))
    top = _grow((0, shards, src, np.zeros(len(src), np.int64), np.array(quotas, np.int64)), seed, max(4096, 2 * len(src)))
    rows = [(int(lo), int(hi), int(k), int(a), int(n)) for lo, hi, ks, starts, counts in top for k, a, n in zip(ks, starts, counts, strict=True) if n]
    nodes = spark.createDataFrame(rows, "node int, stop int, k int, start long, n long")

    def below(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        found = _grow((int(key[0]), int(key[1]), pdf["k"].to_numpy(), pdf["start"].to_numpy(), pdf["n"].to_numpy()), seed)
        parts = [pd.DataFrame({"shard": lo, "k": ks, "lo": a, "hi": a + n}) for lo, _, ks, a, n in found]
        return pd.concat(parts) if parts else pd.DataFrame({"shard": [], "k": [], "lo": [], "hi": []})

    leaves = nodes.where("stop - node = 1").select(F.col("node").alias("shard"), "k", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    if all(r[1] - r[0] == 1 for r in rows):
        return leaves
    return leaves.unionByName(nodes.where("stop - node > 1").groupBy("node", "stop").applyInPandas(below, "shard int, k int, lo long, hi long"))


def _first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Takes documents of the border's blocks in permuted order while they fit what is left;
    the smallest that doesn't fit is taken too if that comes nearer."""
    pdf = pdf.sort_values(["_o", "doc_id", "size"], kind="stable")
    left, take, spare = float(pdf["_left"].iloc[0]), [], None
    for i, words in enumerate(pdf["_words"]):
        take.append(words <= left)
        if words <= left:
            left -= words
        elif spare is None or words < spare[0]:
            spare = (words, i)
    if spare and spare[0] - left < left:
        take[spare[1]] = True
    return pdf[take][["_k", "doc_id", "size"]]


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast, where the rows (some hundred bytes each) are few."""
    return F.broadcast(df) if rows <= 50_000 else df


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Mix:
    """What each output shard draws: the recipe by source, each block's draws, and the
    documents that the owner of a source's border block takes."""

    def __init__(self, docs: DataFrame, weights: Callable[[list], list[float]] = cycle_weights, cap: int = 3, shards: int | None = None, seed: int = 11):
        spark, self.seed = docs.sparkSession, seed
        rows = docs.select("doc_id", "source", _size().alias("size"))
        self.keyed = written(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "mix-sizes")
        recipe = self.keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("w"), F.count(F.lit(1)).alias("n")).collect()
        recipe.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [int(r["w"]) for r in recipe]
        targets, plan = share_out(weights([r["source"] for r in recipe]), sizes, cap), []
        for k, (r, w, t) in enumerate(zip(recipe, sizes, targets, strict=True)):
            full = min(cap, int(t // w)) if w else 1
            rest = max(0.0, float(t - full * w)) if full < cap and w else 0.0
            n = int(r["n"])
            blocks = max(1, min(n, max(BLOCKS, -(-n // BLOCK_DOCS))))
            plan.append((k, r["source"], w, float(t), full, rest, blocks, max(0, BLOCK_DOCS // max(1, -(-n // blocks)) - 1)))
        self.recipe = _small(spark.createDataFrame(plan, "_k int, _s string, source_size long, target double, _full int, _rest double, _nb int, _more int"), len(plan))
        words = F.col("size") * F.col("n_rows")
        blocks = self.place(self.keyed).groupBy("_k", "_b", "_full", "_rest", "_more").agg(F.sum(words).alias("_w"))
        order = Window.partitionBy("_k").orderBy(F.xxhash64(F.lit(seed + 1), "_k", "_b"), "_b")
        blocks = blocks.withColumn("_rank", (F.row_number().over(order) - 1).cast("long")).withColumn("_to", F.sum("_w").over(order))
        # 2: the last, partial copy takes the block; 1: its border runs through it; 0: it stays out.
        state = F.when(F.col("_rest") <= 0, 0).when(F.col("_to") <= F.col("_rest"), 2).when(F.col("_to") - F.col("_w") < F.col("_rest"), 1).otherwise(0)
        blocks = blocks.withColumn("_state", state).withColumn("_left", F.col("_rest") - F.col("_to") + F.col("_w"))
        # With blocks of few documents the border takes in the next ones, up to BLOCK_DOCS documents.
        whole = Window.partitionBy("_k")
        at = F.min(F.when(F.col("_state") == 1, F.col("_rank"))).over(whole)
        blocks = blocks.withColumn("_at", at).withColumn("_left", F.max(F.when(F.col("_state") == 1, F.col("_left"))).over(whole))
        more = (F.col("_rank") > F.col("_at")) & (F.col("_rank") <= F.col("_at") + F.col("_more"))
        blocks = written(blocks.withColumn("_state", F.when(more, 1).otherwise(F.col("_state"))).drop("_at", "_more"), "mix-blocks")
        quota = {r["_k"]: r for r in blocks.groupBy("_k").agg(F.sum(F.col("_full") + (F.col("_state") > 0).cast("int")).alias("q"), F.count(F.lit(1)).alias("n")).collect()}
        n = shards or max(SHARDS, -(-sum(sizes) // SHARD_WORDS))
        leaves = tree_leaves(spark, [int(quota[k]["q"]) if k in quota else 0 for k in range(len(plan))], n, seed)
        counts = _small(spark.createDataFrame([(k, int(r["n"])) for k, r in quota.items()], "k int, blocks long"), len(quota))
        # Unit u of a source is its block of rank u mod blocks, in copy u div blocks.
        units = leaves.join(counts, "k").select(F.col("k").alias("_k"), "shard", "blocks", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("u"))
        units = units.select("_k", "shard", (F.col("u") % F.col("blocks")).alias("_rank"), F.expr("cast(u div blocks as int)").alias("copy"))
        drawn = blocks.join(units, ["_k", "_rank"])
        border = (F.col("copy") == F.col("_full")) & (F.col("_state") == 1)
        drawn = drawn.groupBy("_k", "_b").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", border.alias("border")))).alias("_draws"))
        self.draws = written(drawn, "mix-draws")
        self.n_blocks = sum(int(r["n"]) for r in quota.values())
        edge = _small(blocks.where("_state = 1").select("_k", "_b", "_left"), sum(1 + r[-1] for r in plan))
        edge = self.place(self.keyed).join(edge, ["_k", "_b"]).select("_k", "_b", "doc_id", "size", words.alias("_words"), "_left", F.xxhash64(F.lit(seed + 2), "doc_id", "size").alias("_o"))
        kind = self.keyed.schema["doc_id"].dataType.simpleString()
        self.chosen = written(edge.groupBy("_k").applyInPandas(_first_fit, f"_k int, doc_id {kind}, size long"), "mix-border")

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds source number and block, and the source's recipe. A block is a hash of id and
        size, so that a repeated id spreads over blocks."""
        rows = rows.join(self.recipe, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(self.seed), "doc_id", "size"), F.col("_nb")).cast("int"))

    def draw(self, rows: DataFrame) -> DataFrame:
        """Placed rows with their _draws: array of (copy, shard, border), empty if none."""
        chosen = self.chosen.select(F.col("_k").alias("_ck"), F.col("doc_id").alias("_ci"), F.col("size").alias("_cs"), F.lit(True).alias("_taken"))
        on = (F.col("_k") == F.col("_ck")) & F.col("doc_id").eqNullSafe(F.col("_ci")) & (F.col("size") == F.col("_cs"))
        rows = rows.join(_small(self.draws, self.n_blocks), ["_k", "_b"], "left").join(chosen, on, "left")
        mine = F.filter("_draws", lambda d: ~d["border"] | F.col("_taken").isNotNull())
        return rows.withColumn("_draws", F.when(F.col("_draws").isNotNull(), mine).otherwise(F.array().cast("array<struct<copy:int,shard:int,border:boolean>>"))).drop("_ck", "_ci", "_cs", "_taken")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """What the mix draws of each document.

    Returns doc_id, source, size long (words; null text: 0), n_rows long (rows with these
    three values alike: they count as one unit), source_size long, target double, copies int
    (draws over all shards), shards array<int> (the shard of each draw). One row for each
    distinct (doc_id, source, size). Nulls in doc_id or source are values of their own (null
    source: last). Documents without words fit any quota. An empty table gives an empty
    result.

    A source's documents fall into hashed blocks of about BLOCK_DOCS documents, BLOCKS of them at
    least, which a seeded hash permutes. Its units are whole copies of all its blocks, then the blocks of
    one more, partial copy as far as its target goes. The splitting tree gives each shard
    its exact quota of every source's units, and the shard draws that many of the permuted
    ones, none drawn twice; of the block at the border (of small blocks, of as many as hold
    BLOCK_DOCS documents), the shards that own it take documents by first fit. Through the driver pass one row a source (size, target, quota)
    and the top of the tree; documents, blocks and leaves don't. No task gathers more than a
    block's documents, a source's blocks or a node's units.
    """
    if docs.isEmpty():
        schema = "long size, long n_rows, long source_size, double target, int copies, array<int> shards"
        kinds = [x.split() for x in schema.split(", ")]
        return docs.select("doc_id", "source", *[F.lit(None).cast(t).alias(n) for t, n in kinds]).limit(0)
    m = Mix(docs, **options)
    drawn = m.draw(m.place(m.keyed))
    return drawn.select("doc_id", "source", "size", "n_rows", "source_size", "target", F.size("_draws").alias("copies"), F.transform("_draws", lambda d: d["shard"]).alias("shards"))


def mix(docs: DataFrame, seed: int = 11, sort: bool = True, **options) -> DataFrame:
    """The mixed documents: each row of `docs` once for each draw, with _shard int and
    _order long (columns of `docs` with these names are replaced; other names don't matter,
    as rows travel as one struct). sort: shards lie together, each shuffled locally by a
    seeded hash, so that writing the result writes the shards. Nulls, repeats and empty
    tables as in mix_plan."""
    columns = [c for c in docs.columns if c not in ("_shard", "_order")]
    names = [F.col(f"_row.`{c}`").alias(c) for c in columns]
    if docs.isEmpty():
        return docs.select(*columns, F.lit(0).alias("_shard"), F.lit(0).cast("long").alias("_order"))
    m = Mix(docs, seed=seed, **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", "source", _size().alias("size"))
    drawn = m.draw(m.place(packed)).select("_row", "doc_id", "size", F.explode("_draws").alias("_d"))
    order = F.xxhash64(F.lit(seed + 3), F.col("_d.copy"), "doc_id", "size")
    out = drawn.select("_row", F.col("_d.shard").alias("_shard"), order.alias("_order"))
    if sort:
        out = out.repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order")
    return out.select(*names, "_shard", "_order")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_plan over all of `documents`: weights 1, 2, 3, at most three copies. `taken` counts
    the draws; shards has the shard of each."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    rows = plan.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", taken, "shards")
