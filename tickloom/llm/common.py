"""Helpers that the training-data operators share: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session
    names none, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tickloom-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder. A lost executor
    costs only the tasks that read it. The shuffle files behind the table go as soon as it
    is written, not with some later garbage collection of the driver."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tickloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables, once what was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._tickloom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession) -> None:
    """Texts can be long: an Arrow batch ends at so many bytes (a longer text is a batch by
    itself), so that a Python worker holds a few MB of text at a time. A session setting, as
    Spark reads it when the job runs; one that the session has set itself stays."""
    if spark.conf.get(_BYTES, None) in (None, "-1", "268435456", "256MB"):
        spark.conf.set(_BYTES, "4MB")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def remainder(doc_id: Column, base: int) -> Column:
    """crc32 of doc_id as text modulo base; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % base


def sample(docs: DataFrame, labels: DataFrame, mark: str, usable: Column, most: dict[int, int]) -> list[tuple[int, str]]:
    """(label, text) of labelled rows to fit on: for each label at most `most` of the usable
    ids, those of least hash, with their whole texts of any length. One scan of `docs` against
    a broadcast of at most sum(most) ids."""
    ids = None
    for side, n in most.items():
        of = labels.where((F.col(mark) == side) & usable).select("doc_id").dropDuplicates()
        of = of.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(n).withColumn("_side", F.lit(side))
        ids = of if ids is None else ids.unionByName(of)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "_side", "text").collect()
    return [(r["_side"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["_side"], r["text"]))]
