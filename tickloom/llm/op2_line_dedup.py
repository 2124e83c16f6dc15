"""Line dedup: overlapping windows of consecutive lines, hashed and compared globally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


def line_dedup(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes later occurrences of every run of `window` consecutive lines.

    Lines are what newlines separate (an empty or null text is one empty line). Windows are
    ordered by (id, text hash, line); the first occurrence of a window stays, and each line
    that any later occurrence covers goes, same document included. Texts of fewer lines
    than `window` stay whole. Rows that repeat both id and text count as one document and
    get the same answer. A null id sorts first. Other columns of `docs` are not read.

    Returns id, n_lines int, n_removed int, n_spans int (maximal runs of removed lines),
    text string (the lines that stay, joined by newlines; empty if none).

    Only the 128-bit window hashes are shuffled for the comparison. Windows that occur once
    leave after the first aggregation, which combines on the map side; the join that marks
    later occurrences has a written table on one side, so that a window that a third of all
    documents share is split over many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_d"), text.alias("_t"))
    keyed = base.withColumn("_h", F.xxhash64("_t"))
    lines = F.split("_t", "\n", -1)
    # Pairs of one line's hash under two seeds; a window's hash takes those of its lines.
    hashed = keyed.select("_d", "_h", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(7), x).alias("q"))).alias("_l"))
    spots = hashed.where(F.size("_l") >= window).select(
        "_d", "_h", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_l") - window), lambda i: F.slice("_l", i + 1, window))).alias("_p", "_w")
    )
    spots = spots.select("_d", "_h", "_p", F.xxhash64("_w.p").alias("_a"), F.xxhash64("_w.q").alias("_b"))
    first = F.min(F.struct("_d", "_h", "_p"))
    again = written(spots.groupBy("_a", "_b").agg(first.alias("_f"), F.max(F.struct("_d", "_h", "_p")).alias("_z")).where("_f <> _z").drop("_z"), "lines-again")
    later = spots.join(again.hint("merge"), ["_a", "_b"]).where(F.struct("_d", "_h", "_p") != F.col("_f"))
    starts = later.groupBy("_d", "_h").agg(F.collect_set("_p").alias("_s"))
    starts = written(starts, "lines-later").select(F.col("_d").alias("_d2"), F.col("_h").alias("_h2"), "_s").hint("merge")
    joined = keyed.join(starts, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left")
    joined = joined.withColumn("_l", F.split("_t", "\n", -1))
    gone = F.array_distinct(F.flatten(F.transform("_s", lambda p: F.sequence(p, p + (window - 1)))))
    gone = F.coalesce(gone, F.array().cast("array<int>"))
    joined = joined.withColumn("_g", gone)
    joined = joined.withColumn("_k", F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_g")))
    return joined.select(
        F.col("_d").alias(id_col),
        F.size("_l").alias("n_lines"),
        F.size("_g").alias("n_removed"),
        F.size(F.array_except("_g", F.transform("_g", lambda p: p + 1))).alias("n_spans"),
        F.when(F.size("_g") == 0, F.col("_t")).otherwise(F.array_join(F.transform("_k", lambda i: F.get("_l", i)), "\n")).alias("text"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_dedup over all of `documents`, windows of three lines."""
    return line_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM d WHERE len(l) >= 3),
k AS (SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS win FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS n FROM k),
g AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
s AS (SELECT doc_id, count(*) AS n_removed,
             count(*) FILTER (WHERE (doc_id, i - 1) NOT IN (SELECT (doc_id, i) FROM g)) AS n_spans FROM g GROUP BY doc_id),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM d),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.l)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(n_spans, 0)::INT AS n_spans, coalesce(t.text, '') AS text
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
