"""Graph, solution and result-comment text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """`u v w` lines, 1-based on disk, 0-based here; the `n m` line and `//` lines are no
    edges."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("//")).select(parts.alias("p")).where(F.size("p") == 3)
    return lines.select((F.col("p")[0].cast("long") - 1).alias("src"), (F.col("p")[1].cast("long") - 1).alias("dst"), F.col("p")[2].cast("double").alias("w"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of `// key: value` lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").startswith("//"))
    return rows.select("file", F.regexp_extract("value", r"^//\s*([^:]+):", 1).alias("key"), F.trim(F.regexp_extract("value", r":\s*(.*)$", 1)).alias("value"))


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """`node label` lines, 1-based on disk, 0-based here."""
    lines = spark.read.text(path).where(~F.col("value").startswith("//")).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    return lines.select((F.col("p")[0].cast("long") - 1).alias("node"), F.col("p")[1].cast("int").alias("label"))
