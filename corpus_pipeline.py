"""A training-corpus pipeline over `documents`: each stage's rows are written as Parquet and
read again as the next one's.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: one document of each SimHash group stays, that of the least doc_id.
3. decontaminate: hit words' documents go, those with any ten-word window of `benchmark`.
4. mix: each document once for each copy that the source targets take of it.
5. tokens: token ids to sorted-string-table shards, read back: doc_id, start, n_tokens, ids_crc32.

Columns of `documents` alone go on, whatever others a table has. Nulls in any column, empty and
very long texts, repeated rows and empty tables pass through every stage: null texts count as
empty, which the quality curve scores like any text, which all share one SimHash, hold no
window, have no words and give the end id alone.

SQL can express neither zstandard sizes nor BPE, so that there is no ORACLE_SQL; tests hold
every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import table, written
from tickloom.llm.op4_mix import mix
from tickloom.llm.op6_quality import fit_quality, score_quality
from tickloom.llm.op7_simhash import simhash_dedup
from tickloom.llm.op8_decontaminate import decontaminate
from tickloom.llm.op9_tokens import token_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows of the stage's input, outside the held-out fold."""
    docs = docs.select(COLUMNS)
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep_only=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the least id stays (null ids last, then by text hash)."""
    return simhash_dedup(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is judged by its own text."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), mode="documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards lie together in the written table, each shuffled locally."""
    return mix(docs.select(COLUMNS)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in ascending id order, null ids first; copies are entries of their own."""
    return token_table(docs, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
