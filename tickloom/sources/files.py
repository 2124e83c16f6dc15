"""File listings, arrays, result tables and text formats as DataFrames, and their writers."""

from __future__ import annotations

import io
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as B

#: Fixed value: the digits of the bit-vector codec, by value.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below a folder whose names match; contents aren't
    read. An empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def tick_files(spark: SparkSession, folder: str, symbol: str) -> DataFrame:
    """Tick files of a symbol, the exact name first, then the largest."""
    name = F.element_at(F.split("path", "/"), -1)
    found = listing(spark, folder, "*.scid").where(F.lower(name).startswith(symbol.lower()))
    return found.withColumn("exact", F.lower(name) == f"{symbol.lower()}.scid").orderBy(F.desc("exact"), F.desc("length"), "path")


def load_bars(spark: SparkSession, path: str, symbol: str, every: str | None = None, points: float | None = None) -> DataFrame:
    """A tick file as time bars (`every`, a Spark interval) or range bars of `points`."""
    if (every is None) == (points is None):
        raise ValueError("either every or points")
    t = spark.read.format("scid").load(path)
    t = t.select(F.lit(symbol).alias("symbol"), "ts", "seq", F.col("close").alias("price"), F.col("volume").alias("size"), F.col("delta").alias("signed"))
    return B.range_bars(t, points) if points is not None else B.time_bars(t, every)


def arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """(file, name, i, j, value) of numeric arrays of up to two dimensions in .npy and .npz
    files, one row a value; one file at a time is in memory. Other arrays, and pickled ones,
    are left out: nothing is unpickled. A .npy file's array has an empty name."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for name in getattr(got, "files", [""]):
                    try:
                        a = got[name] if name else got
                    except ValueError:  # an array of objects
                        continue
                    if a.ndim > 2 or a.dtype.kind not in "biuf":
                        continue
                    a = a.reshape(len(a) if a.ndim else 1, -1)
                    for at in range(0, len(a), max(1, 65_536 // max(1, a.shape[1]))):
                        part = a[at : at + max(1, 65_536 // max(1, a.shape[1]))]
                        i, j = np.indices(part.shape)
                        yield pd.DataFrame({"file": file, "name": name, "i": (i + at).ravel(), "j": j.ravel(), "value": part.astype(float).ravel()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, name string, i long, j long, value double")


def with_part(df: DataFrame, pattern: str, name: str = "split", kind: str = "int") -> DataFrame:
    """Adds the part of each row's file path that the pattern's first group matches, null where
    it doesn't."""
    return df.withColumn(name, F.expr(f"try_cast(nullif(regexp_extract(_metadata.file_path, r'{pattern}', 1), '') AS {kind})"))


def result_tables(spark: SparkSession, path: str, schema: str, pattern: str = r"split_(\d+)") -> DataFrame:
    """CSV files with a header line, one a split, in one table with a split column."""
    return with_part(spark.read.csv(path, schema=schema, header=True), pattern)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, step, score) of files named actor__<step>.pt or actor__<step>_<score>.pt,
    and of act.pth, one step after its folder's last."""
    files = listing(spark, folder, "act*").withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    pattern = r"^actor__(\d+)(?:_(-?\d+(?:\.\d+)?))?\.pt$"
    found = files.where(F.col("name").rlike(pattern)).select("path", "folder", F.regexp_extract("name", pattern, 1).cast("long").alias("step"), F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")).cast("double").alias("score"))
    last = found.groupBy("folder").agg(F.max("step").alias("_s"))
    final = files.where("name = 'act.pth'").join(last, "folder", "left").select("path", "folder", (F.coalesce("_s", F.lit(0)) + 1).alias("step"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(final)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.json(path, multiLine=True)


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, values): lines of whole numbers as arrays; line is the line's place by its
    offset's order within the file, from 0. Empty lines are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "t"))
    return text.where(F.trim("t") != "").select("file", "line", F.transform(F.split(F.trim("t"), r"\s+"), lambda x: x.cast("long")).alias("values"))


def knapsack(spark: SparkSession, path: str) -> DataFrame:
    """(file, capacity, item, weight, value) of files whose first line holds the number of
    items and the capacity."""
    lines = numbers(spark, path)
    head = lines.where("line = 0").select("file", F.col("values")[1].alias("capacity"))
    return lines.where("line > 0").join(head, "file").select("file", "capacity", (F.col("line") - 1).alias("item"), F.col("values")[0].alias("weight"), F.col("values")[1].alias("value"))


def covers(spark: SparkSession, path: str) -> DataFrame:
    """(file, total, id, items) of set-cover files: the first line holds the numbers of
    elements and sets, each other line a set's elements."""
    lines = numbers(spark, path)
    head = lines.where("line = 0").select("file", F.col("values")[0].alias("total"))
    return lines.where("line > 0").join(head, "file").select("file", "total", (F.col("line") - 1).alias("id"), F.col("values").alias("items"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.row, self.cell, self.table = [], None, None, -1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self.close_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.close_cell()
        elif tag in ("tr", "table"):
            self.close_row()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def close_row(self):
        self.close_cell()
        if self.row:
            self.rows.append((max(self.table, 0), self.row))
        self.row = None


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells): the rows of tables in a column of HTML texts; null and text
    without tables give none."""
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                parser = _Tables()
                parser.feed(text or "")
                parser.close()
                parser.close_row()
                out.extend((k, t, i, cells) for i, (t, cells) in enumerate(parser.rows))
            yield pd.DataFrame(out, columns=[key, "table", "row", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, table int, row int, cells array<string>")


def encode_bits(bits: Column, wrap: bool = True) -> Column:
    """A text of 0 and 1 as digits of 64, the first bit highest, padded on the left to whole
    digits; wrap: lines of 120 digits, after an empty first line if the text exceeds 64."""
    n = F.ceil(F.length(bits) / 6).cast("int")
    padded = F.lpad(bits, n * 6, F.lit("0"))
    digit = lambda i: F.substr(F.lit(DIGITS), F.conv(F.substr(padded, i * 6 + 1, F.lit(6)), 2, 10).cast("int") + 1, F.lit(1))
    text = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), digit), "")).otherwise("")
    if not wrap:
        return text
    lines = F.regexp_replace(text, "(.{120})(?=.)", "$1\n")
    return F.when(n > 64, F.concat(F.lit("\n"), lines)).otherwise(lines)


def decode_bits(text: Column, n: Column) -> Column:
    """The n bits of such a text; white space is ignored."""
    clean = F.regexp_replace(text, r"\s", "")
    six = lambda c: F.lpad(F.bin(F.instr(F.lit(DIGITS), c) - 1), 6, "0")
    bits = F.array_join(F.transform(F.filter(F.split(clean, ""), lambda c: c != ""), six), "")
    return F.substr(F.lpad(bits, F.greatest(n, F.length(bits)), F.lit("0")), F.greatest(n, F.length(bits)) - n + 1, n)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges (src, dst, w), 0-based here, as `n m` and 1-based `u v w` lines: the first line in
    the first file. An existing path is an error."""
    size = edges.agg(F.max(F.greatest("src", "dst")).alias("n"), F.count(F.lit(1)).alias("m"))
    head = size.select(F.concat_ws(" ", F.coalesce("n", F.lit(-1)) + 1, "m").alias("value"))
    lines = edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, F.col("w").cast("long")).alias("value"))
    head.union(lines).write.text(path)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends a stream's rows to CSV files with header lines."""
    return stream.writeStream.format("csv").option("header", "true").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def ring(history: DataFrame, size: int, step: str = "step") -> DataFrame:
    """The last `size` steps of an append-only history table, as a ring buffer keeps them."""
    last = history.agg(F.max(step).alias("_last"))
    return history.crossJoin(F.broadcast(last)).where(F.col(step) > F.col("_last") - size).drop("_last")  # a single row
