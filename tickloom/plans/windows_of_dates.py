"""Registered queries of embargoed folds and rolling training windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import splits as P

from .registry import query, read


@query(
    "embargoed_folds",
    """WITH e AS (SELECT event_id, epoch_us(ts)::DOUBLE / 1e6 AS t, epoch_us(ts)::DOUBLE / 1e6 + 7200 AS k FROM events),
    r AS (SELECT *, rank() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM e),
    f AS (SELECT *, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS own FROM r),
    s AS (SELECT own AS fold, min(t) AS a, max(t) AS z FROM f GROUP BY own)
    SELECT fold::INT AS fold, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(event_id)::BIGINT AS ids FROM f, s
    WHERE own = fold OR k < a - (z - a) * 0.05 OR k > z + (z - a) * 0.05 GROUP BY ALL""",
)
def embargoed_folds(spark, sf):
    """Labels are known two hours after the event."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    rows = read(spark, sf, "events").select("event_id", t.alias("t"), (t + 7200).alias("known"))
    return P.embargoed_folds(rows, "t", "known", 7, 0.05).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "rolling_windows",
    """WITH d AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS m FROM d),
    k AS (SELECT DISTINCT (i - 20) // 4 AS w, m FROM i WHERE i >= 20),
    r AS (SELECT w, 'train' AS role, w * 4 AS lo, 20 + w * 4 AS hi FROM k UNION ALL SELECT w, 'trade', 20 + w * 4, least(24 + w * 4, m) FROM k)
    SELECT w::INT AS "window", role, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, sum(n)::BIGINT AS n, round(sum(v), 4) AS total FROM r JOIN i ON i >= lo AND i < hi GROUP BY ALL""",
)
def rolling_windows(spark, sf):
    """Twenty days of training before each four days of trading; the days are one row each."""
    days = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    days = days.withColumn("idx", F.row_number().over(Window.orderBy("day")) - 1)
    rows = P.rolling_windows(20, days.count() - 20, 4)
    got = P.assign(days, spark.createDataFrame(rows, "window int, role string, lo long, hi long"))
    return got.groupBy("window", "role").agg(F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.sum("n").alias("n"), F.round(F.sum("v"), 4).alias("total"))
