"""Registered queries of feature tables and models. SQL can express neither eigenvectors nor
forests; tests hold the operators against NumPy and against planted features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import graph as G
from tickloom.operators import learning as L
from tickloom.operators import splits as P
from tickloom.operators import windows as W

from .registry import EDGES, edges, hourly_signed, out, query


def featured(spark, sf) -> DataFrame:
    return X.microstructure(hourly_signed(spark, sf).withColumn("duration_seconds", F.col("num_trades") * 60.0))


def labelled(spark, sf, ahead: int = 5) -> DataFrame:
    """Features of hourly bars, label 1 where the close is higher `ahead` rows later, idx in time
    order over all symbols and `until`, the idx at which the label is known."""
    f = X.microstructure(hourly_signed(spark, sf).withColumn("duration_seconds", F.col("num_trades") * 60.0))
    b = hourly_signed(spark, sf).select("symbol", "ts", (F.lead("close", ahead).over(W.order()) > F.col("close")).cast("int").alias("label"), F.lead("ts", ahead).over(W.order()).alias("_t1")).where("label IS NOT NULL")
    rows = f.join(b, ["symbol", "ts"])
    rows = rows.withColumn("_s", F.unix_timestamp(F.col("ts").cast("timestamp"))).withColumn("_e", F.unix_timestamp(F.col("_t1").cast("timestamp")))
    first = P.runs(rows.select("_s"), "_s")
    rows = rows.join(first.select("_s", F.col("start").alias("_from")), "_s").withColumn("idx", F.col("_from") + F.row_number().over(Window.partitionBy("_s").orderBy("symbol")) - 1)
    known = first.select(F.col("_s").alias("_e"), (F.col("start") + F.col("n") - 1).alias("until"))
    return rows.join(known, "_e", "left").withColumn("until", F.coalesce("until", "idx")).select("symbol", "ts", "idx", "until", "label", *X.MICRO)


@query("denoised_covariance")
def denoised_covariance(spark, sf):
    return out(L.denoised_covariance(featured(spark, sf), X.MICRO), "a", "b", "raw", "denoised")


@query("principal_components")
def principal_components(spark, sf):
    rows, _ = L.principal_components(featured(spark, sf), X.MICRO, 0.9)
    return out(rows, *[c for c in rows.columns if c in ("symbol", "ts") or c.startswith("pc")], digits=5)


@query("meta_label_folds")
def meta_label_folds(spark, sf):
    got = L.meta_labels(labelled(spark, sf), X.MICRO, folds=4, tests=2, trees=20)["folds"]
    return out(got, *got.columns)


@query("importance_mdi")
def importance_mdi(spark, sf):
    return L.importance_mdi(labelled(spark, sf), X.MICRO, trees=50)


@query("importance_mda")
def importance_mda(spark, sf):
    return L.importance_mda(labelled(spark, sf), X.MICRO, "idx", repeats=2, trees=50)


# Nodes in the order of a greedy choice, one at a time, with what has been chosen as a list.
UNDIRECTED = f"{EDGES}, u AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), nb AS (SELECT a AS node, list(b) AS l, count(*) AS deg FROM u GROUP BY a)"


@query("greedy_cover", f"WITH {UNDIRECTED}, r AS (SELECT node, row_number() OVER (ORDER BY deg DESC, node) AS r FROM nb), k AS (SELECT max(least(x.r, y.r)) AS k FROM u JOIN r x ON x.node = a JOIN r y ON y.node = b) SELECT node, (r <= k)::INT AS chosen FROM r, k")
def greedy_cover(spark, sf):
    return G.greedy_cover(edges(spark, sf))


@query(
    "greedy_independent_set",
    f"""WITH RECURSIVE {UNDIRECTED}, r AS MATERIALIZED (SELECT node, l, row_number() OVER (ORDER BY deg, node) AS r FROM nb),
    s AS (SELECT 0 AS r, []::BIGINT[] AS got UNION ALL SELECT r.r, CASE WHEN list_has_any(r.l, s.got) THEN s.got ELSE list_append(s.got, r.node) END FROM s JOIN r ON r.r = s.r + 1),
    z AS (SELECT unnest(got) AS node FROM s WHERE r = (SELECT max(r) FROM r))
    SELECT r.node, (z.node IS NOT NULL)::INT AS chosen FROM r LEFT JOIN z USING (node)""",
)
def greedy_independent_set(spark, sf):
    return G.greedy_independent_set(edges(spark, sf))


@query("greedy_colours")
def greedy_colours(spark, sf):
    return G.greedy_colours(edges(spark, sf))
