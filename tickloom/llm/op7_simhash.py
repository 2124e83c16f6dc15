"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import table, text_batches, utf8, written
from .components import connected_components

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: the words of its A-Z-lowered form, their shingles
    space-joined, repeats included; a bit is 1 if it is set in over half the hashes."""
    words = text.lower().split()  # on bytes: ASCII letters and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    found = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """(id, fp long) and the long column `extra`, if named: the fingerprint of each row as a
    signed long. Null texts have no words."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=[id_col, "fp", *([extra] if extra else [])])

    rows = docs.select(F.col(id_col), F.col(text_col), *([F.col(extra)] if extra else []))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long" + (f", `{extra}` long" if extra else ""))


def ball(radius: int, bits: int = 64) -> list[int]:
    """Masks of at most `radius` bits, as signed longs."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: Table rows of a segment value from which on it counts as crowded.
CROWDED = 64
#: Crowded segment values that are broadcast; more of them go by shuffles.
BROADCAST = 200_000


def _segments() -> Column:
    """(seg, val): the fingerprint's two 32-bit segments, as non-negative longs."""
    half = lambda i, v: F.struct(F.lit(i).alias("seg"), v.alias("val"))
    return F.array(half(0, F.shiftrightunsigned("fp", 32)), half(1, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))


def links(fps: DataFrame, max_distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Distinct fingerprints (fp long) -> edges (u, v) whose components are those of all
    pairs at `max_distance` or fewer differing bits.

    Multi-index hashing: a table keyed (segment, segment value) holds each fingerprint under
    its two 32-bit segments. Two fingerprints within max_distance bits have a segment that
    differs in max_distance / 2 bits or fewer, so that each one looks up the Hamming ball of
    that radius around each of its segments (only values from its own upwards: the other
    fingerprint of a pair looks down no more than it), and complete distances are verified.

    A segment value that over `crowded` fingerprints share would pair all of them. Those who
    would meet there meet by whole values instead: each is entered under every value in the
    ball of half the distance around it, and the two of a pair meet at their midpoint, as do
    at most as many as the ball has members (65 at distance 2). Nothing is left out, and
    nothing grows with the square of a group.

    Spark sizes exploded rows by those before, and so would broadcast the probes of a few MB of
    fingerprints, 18 rows each: their joins are merge joins at any size.
    """
    if max_distance not in (0, 2, 4):
        raise ValueError("max_distance: 0, 2 or 4")
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fps = fps.select("fp").repartition(parts, "fp")
    table = fps.select("fp", F.explode(_segments()).alias("s")).select("s.seg", "s.val", "fp")
    around = F.array(*[F.lit(m).cast("long") for m in ball(max_distance // 2, 32)])
    up = lambda v: F.filter(F.transform(around, lambda m: v.bitwiseXOR(m)), lambda x: x >= v)
    probes = table.select("seg", F.explode(up(F.col("val"))).alias("val"), F.col("fp").alias("by"))
    full = written(table.groupBy("seg", "val").count().where(F.col("count") > crowded).select("seg", "val"), "simhash-crowded")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
    pairs = lambda df: df.where((F.col("u") != F.col("v")) & near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    found = lambda t, p: pairs(t.join(p.hint("merge"), ["seg", "val"]).select(F.col("by").alias("u"), F.col("fp").alias("v")))
    n = full.count()
    if not n:
        return found(table, probes).distinct()
    full = F.broadcast(full) if n <= BROADCAST else full.hint("merge")
    sparse = found(table.join(full, ["seg", "val"], "left_anti"), probes.join(full, ["seg", "val"], "left_anti"))
    meet = probes.join(full, ["seg", "val"], "left_semi").select(F.col("by").alias("fp")).distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in ball(max_distance // 2)])
    entered = meet.repartition(parts, "fp").select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    met = entered.groupBy("at").agg(F.collect_list("fp").alias("f")).where(F.size("f") > 1)
    dense = pairs(met.select(F.array_min("f").alias("u"), F.explode("f").alias("v")))
    return sparse.unionByName(dense).distinct()


def _roots(rows: DataFrame, max_distance: int, low: Column) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of every fingerprint and (root, low) of every component, from rows
    (fp, ...). Copies meet in the map-side combined aggregation by fingerprint, so that only
    distinct fingerprints are linked. Both joins are of tables with a row a fingerprint: merge
    joins, nothing of them goes through the driver."""
    fps = written(rows.groupBy("fp").agg(F.min(low).alias("low")), "simhash-fps")
    edges = written(links(fps, max_distance), "simhash-links")
    roots = connected_components(edges)
    placed = written(fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "simhash-placed")
    least = written(placed.groupBy("root").agg(F.min("low").alias("low")), "simhash-least")
    return placed.select("fp", "root"), least.hint("merge")


def simhash_groups(docs: DataFrame, max_distance: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint and near-duplicate component.

    Returns id, fp long, component_id: the least id reachable over links of at most
    `max_distance` differing bits, the row's own included. Empty, blank and null texts have
    fingerprint 0 and link like any other. Rows with a null id take part; they never give a
    component its id (null if no member has one). Repeated rows each get their row. An
    empty table gives an empty result. The last join takes a written table, whose hot keys
    Spark splits.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    placed, least = _roots(rows, max_distance, F.col(id_col))
    named = written(placed.join(least, "root").select("fp", F.col("low").alias("component_id")), "simhash-named")
    return rows.join(named.hint("merge"), "fp").select(id_col, "fp", "component_id")


def simhash_dedup(docs: DataFrame, max_distance: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one of each component: that of the least id (null ids last),
    among rows that share it that of the least text hash.

    A row is known by (id, 64-bit hash of the text): rows that repeat both are one, rows that
    repeat the id alone are judged by themselves. Null texts and null ids take part like any
    other. An empty table gives an empty result.
    """
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("h"))
    text_hash = F.xxhash64(F.lit(1), F.coalesce(F.col(text_col), F.lit("")))
    rows = written(fingerprints(docs.withColumn("h", text_hash), shingle, id_col, text_col, extra="h"), "simhash-rows")
    _, least = _roots(rows, max_distance, key)
    keep = written(least.select(F.col("low.i").alias("_ki"), F.col("low.h").alias("_kh")), "simhash-keep")
    on = F.col("_ri").eqNullSafe(F.col("_ki")) & (F.col("_rh") == F.col("_kh"))
    marked = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_ri"), text_hash.alias("_rh"))
    return marked.join(keep.hint("merge"), on, "left_semi").dropDuplicates(["_ri", "_rh"]).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups over all of `documents`, distance 2, three-word shingles."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
