"""Exact dedup by Grace hashing: partition to spill files until each bucket fits a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import forget, table, text_batches, utf8, written

#: Bytes of distinct texts that one open-addressing table holds.
BUCKET_BYTES = 64 << 20
#: Buckets that one job settles; more bytes than these hold are partitioned further first.
BUCKETS = 8192
#: Levels of parts; beyond, what is left has few hashes, and buckets stream it past their tables.
DEEPEST = 6
#: Tasks that copies found within one input task, and longer texts than LONG_BYTES, are first dealt to.
SALTS = 64
LONG_BYTES = 1 << 16
#: Kinds of rows in a spill file: a document, a text that its table has settled, a text that goes on.
MEMBER, SETTLED, SPILLED = 0, 1, 2
#: Bytes of texts that an Arrow batch of spilled rows takes.
OUT_BYTES = 4 << 20

_ROW = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("sha", pa.binary()), ("h", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("n_top", pa.int64()), ("size", pa.int64()), ("part", pa.int32())])
_DDL = "kind tinyint, id bigint, sha binary, h bigint, text binary, n bigint, n_top bigint, size bigint, part int"


class OpenTable:
    """Open addressing with linear probing: a slot is taken by a text's hash, and an entry is
    found only if its complete content is the same. Per entry: copies, the largest id (null is
    least) and how many rows have it."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.shas: list[bytes] = []
        self.copies: list[int] = []
        self.top: list[int | None] = []
        self.tops: list[int] = []
        self.bytes = 0

    def _slot(self, h: int, text: bytes) -> int:
        """The slot that holds this text, or else the empty one where it belongs."""
        mask, slots = len(self.slots) - 1, self.slots
        at = (h ^ (h >> 29)) & mask
        while (e := slots[at]) >= 0 and not (self.hashes[e] == h and self.texts[e] == text):
            at = (at + 1) & mask
        return at

    def put(self, h: int, text: bytes, sha: bytes, copies: int, top: int | None, tops: int, room: float) -> bool:
        """Adds copies of a text; false if it isn't there and the table has no room for it."""
        at = self._slot(h, text)
        e = int(self.slots[at])
        if e >= 0:
            self.copies[e] += copies
            if top == self.top[e]:
                self.tops[e] += tops
            elif top is not None and (self.top[e] is None or top > self.top[e]):
                self.top[e], self.tops[e] = top, tops
            return True
        if self.texts and self.bytes + len(text) + 200 > room:
            return False
        self.slots[at] = len(self.texts)
        for column, value in zip((self.hashes, self.texts, self.shas, self.copies, self.top, self.tops), (h, text, sha, copies, top, tops), strict=True):
            column.append(value)
        self.bytes += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, (k, t) in enumerate(zip(self.hashes, self.texts, strict=True)):
                self.slots[self._slot(k, t)] = i
        return True

    def rows(self, kind: int, part: int) -> Iterator[pa.RecordBatch]:
        first, size = 0, 0
        for i, t in enumerate(self.texts):
            size += len(t) + 100
            if size >= OUT_BYTES or i + 1 == len(self.texts):
                cut = slice(first, i + 1)
                n = i + 1 - first
                lens = [len(x) for x in self.texts[cut]]
                yield _batch([kind] * n, self.top[cut], self.shas[cut], self.hashes[cut], self.texts[cut], self.copies[cut], self.tops[cut], lens, [part] * n)
                first, size = i + 1, 0


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _read(room: int):
    """First pass over the input: a member row for every document, and this task's texts, each
    once as far as a table holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), OpenTable()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t.lower() for t in utf8(b.column(1))]  # on bytes: A-Z only
            shas = [hashlib.sha256(t).digest() for t in texts]
            n = len(ids)
            none = [None] * n
            yield _batch([MEMBER] * n, ids, shas, none, none, none, none, none, none)
            for i, t, s in zip(ids, texts, shas, strict=True):
                h = xxh64_intdigest(t) - (1 << 63)
                if not held.put(h, t, s, 1, i, 1, room):
                    yield from held.rows(SPILLED, part)
                    held = OpenTable()
                    held.put(h, t, s, 1, i, 1, room)
        yield from held.rows(SPILLED, part)

    return run


def _settle(final: bool, room: int):
    """One bucket against one table. A text that the full table has no room for goes on to the
    next level's spill files (all its copies do, as it can't enter later), so that what the
    table holds at the end is settled; or, before that, where copies are only brought together
    (final is false), the table is handed on and emptied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), OpenTable()
        for b in batches:
            late = []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("h", "text", "sha", "n", "id", "n_top")), strict=True)):
                if not held.put(*row, room):
                    if final:
                        late.append(i)
                    else:
                        yield from held.rows(SPILLED, part)
                        held = OpenTable()
                        held.put(*row, room)
            if late:
                yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in _ROW], schema=_ROW).take(pa.array(late))
        yield from held.rows(SETTLED if final else SPILLED, part)

    return run


def _slice(level: int, n: int):
    """Which of n parts a text's hash falls into, by another hash at each level."""
    return F.pmod(F.xxhash64(F.lit(level), "h"), F.lit(n))


def _grace(spilled: DataFrame, level: int) -> list[DataFrame]:
    """Settled texts of spill files, as written tables: one job if its buckets can hold them,
    or else by parts that a further hash deals to files of their own. What a bucket can't hold
    is partitioned again. Only numbers of bytes come to the driver."""
    spark = spilled.sparkSession
    total = spilled.agg(F.sum(F.col("size") + 200)).first()[0] or 0
    if not total:
        return []
    buckets = -(-2 * total // BUCKET_BYTES)
    if buckets > BUCKETS and level < DEEPEST:
        n = int(min(1024, -(-buckets * 3 // (2 * BUCKETS))))
        parts = [written(spilled.where(_slice(level, n) == k), f"exact-part-{level}") for k in range(n)]
        found = [t for p in parts for t in _grace(p, level + 1)]
        forget(*parts)
        return found
    n = max(min(buckets, BUCKETS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spilled.repartition(int(n), F.xxhash64(F.lit(100 + level), "h"))
    out = written(dealt.mapInArrow(_settle(True, BUCKET_BYTES), _DDL), f"exact-level-{level}")
    return [out, *_grace(out.where(F.col("kind") == SPILLED), level + 1)]


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, classes) of texts that are equal after lower-casing A-Z.

    members: (id, sha binary), a row for every row of docs; classes: (sha, keep_id, n, n_top,
    text binary, normalised), a row for every distinct text. Both are read from written tables.
    """
    text_batches(docs.sparkSession)
    first = written(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_read(BUCKET_BYTES // 4), _DDL), "exact-read")
    spilled = first.where(F.col("kind") == SPILLED)
    crowded = (F.col("n") > 1) | (F.col("size") >= LONG_BYTES)
    met = spilled.where(crowded).repartition(F.col("h"), F.pmod("part", F.lit(SALTS))).mapInArrow(_settle(False, BUCKET_BYTES), _DDL)
    met = written(met, "exact-met")
    tables = _grace(spilled.where(~crowded).unionByName(met), 0)
    forget(met)
    classes = first.where("false")
    for t in tables:
        classes = classes.unionByName(t)
    classes = classes.where(F.col("kind") == SETTLED).select("sha", F.col("id").alias("keep_id"), "n", "n_top", "text")
    return first.where(F.col("kind") == MEMBER).select("id", "sha"), classes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows whose texts are identical after lower-casing A-Z (and nothing else).

    Of equal texts the row with the largest id stays; a null id is less than any other, and of
    rows that repeat id and text one stays. Null texts count as empty. Ids are integers. Other
    columns of docs are not read. An empty table gives no rows.

    Returns a row for every row of docs: id, keep_id, group_size long, kept boolean,
    text_sha256 string (lowercase hex, of the normalised text in UTF-8).

    Each input task lowers its texts and brings its own copies together in open-addressing
    tables, so that a text that a third of all rows share leaves a task once, not once a row.
    Those texts and the long ones then meet by (hash, salt), and after that every text's records
    by hash alone: one bucket a task, one table of at most BUCKET_BYTES a bucket, complete
    contents compared. Rows find their group by the SHA-256 of the text, in a merge join that
    adaptive execution splits where one group holds many rows; the rows that may stay come from
    the groups themselves.
    """
    members, classes = copy_classes(docs, id_col, text_col)
    sized = classes.select("sha", "keep_id", F.col("n").alias("group_size"), "n_top")
    # Copies of the row that stays are numbered in two steps, so that no array is long.
    step = 4096
    stay = sized.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_top") - 1) / step))).alias("k"))
    stay = stay.select("*", F.explode(F.sequence(F.col("k") * step, F.least(F.col("n_top"), (F.col("k") + 1) * step) - 1)).alias("i"))
    stay = stay.select(F.col("keep_id").alias("id"), "keep_id", "group_size", (F.col("i") == 0).alias("kept"), "sha")
    groups = sized.where("group_size > n_top").hint("merge")
    gone = members.join(groups, "sha").where(~F.col("id").eqNullSafe(F.col("keep_id")))
    gone = gone.select("id", "keep_id", "group_size", F.lit(False).alias("kept"), "sha")
    return stay.unionByName(gone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What stays: (id, text string, n_copies long), the normalised text of every group."""
    _, classes = copy_classes(docs, id_col, text_col)
    return classes.select(F.col("keep_id").alias(id_col), F.decode("text", "UTF-8").alias(text_col), F.col("n").alias("n_copies"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup over all of `documents`."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
