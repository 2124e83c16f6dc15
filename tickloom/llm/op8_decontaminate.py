"""Benchmark decontamination with a hash set of normalised benchmark n-grams."""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, utf8, written

#: A-Z lowered; every other ASCII byte but digits and letters becomes a blank.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of 0-9, a-z and non-ASCII characters, A-Z lowered."""
    return text.translate(_TABLE).split()


class GramIndex:
    """Hash set of the word windows of a bounded set of items."""

    def __init__(self, items: list[tuple], n: int = 10):
        self.n, self.vocab, self.names = n, {}, []
        grams: dict[tuple, set[int]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not ids:
                continue
            self.names.append(name)
            for at in range(max(1, len(ids) - n + 1)):
                grams.setdefault(tuple(ids[at : at + n]), set()).add(len(self.names) - 1)
        self.grams = {g: tuple(sorted(i)) for g, i in grams.items()}
        self.lengths = sorted({len(g) for g in grams})
        self.hashes = {k: np.unique(np.array([self._hash(g) for g in grams if len(g) == k], np.uint64)) for k in self.lengths}

    @staticmethod
    def _hash(gram: tuple) -> int:
        h = 0
        for x in gram:
            h = (h * int(_MUL) + x) & 0xFFFFFFFFFFFFFFFF
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Mask of the words that lie in an occurrence of a window, and the items hit."""
        size, found = len(words), set()
        cover = np.zeros(size + 1, np.int64)
        if not size or not self.grams:
            return cover[:size] > 0, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, size)
        if np.count_nonzero(ids) < self.lengths[0]:
            return cover[:size] > 0, found
        rolled = np.zeros(size, np.uint64)
        for k in range(1, min(self.n, size) + 1):
            rolled = rolled[: size - k + 1] * _MUL + ids[k - 1 :]
            table = self.hashes.get(k)
            if table is None:
                continue
            spot = np.minimum(np.searchsorted(table, rolled), len(table) - 1)
            for at in np.flatnonzero(table[spot] == rolled).tolist():
                hit = self.grams.get(tuple(ids[at : at + k].tolist()))  # verifies
                if hit is not None:
                    cover[at] += 1
                    cover[at + k] -= 1
                    found.update(hit)
        return np.cumsum(cover[:size]) > 0, found


def gram_indexes(benchmark: DataFrame, n: int = 10, part_words: int = 2_000_000, id_col: str = "item_id", text_col: str = "text"):
    """Yields one GramIndex after another, each over at most `part_words` words of items
    (a single longer item makes an index of its own). The items stream to the driver by
    partitions, and no more than one part and one item are held."""
    held, total = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    for name, text in rows.toLocalIterator():
        text = text.encode()
        count = len(words_of(text))
        if held and total + count > part_words:
            yield GramIndex(held, n)
            held, total = [], 0
        held.append((name, text))
        total += count
    if held:
        yield GramIndex(held, n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "report", part_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans every document for word windows of the benchmark.

    A window is n consecutive item words (a shorter item, but not an empty one, is one
    window). mode="report": adds to id n_words long, n_hit long, n_items long, items
    array<string> (distinct ids of items with an occurring window, sorted; null ids leave
    no name but do hit) and contaminated. mode="documents": the rows of `docs` that hold no
    window. mode="spans": `docs` with hit words cut from the text, each run with what
    separates its words. Null and empty texts have no words and stay. Every row is judged
    by itself, so that ties and repeated rows need no rule.

    A benchmark of at most `part_words` words is one broadcast hash set, and one map without
    a shuffle judges all. A larger one goes part by part: each part is broadcast by itself,
    its hits are written (one row a contaminated document, known by id and text hash), and
    the broadcast is destroyed before the next; the hits are then merged and joined.
    """
    if mode not in ("report", "documents", "spans"):
        raise ValueError("mode: report, documents or spans")
    spark = docs.sparkSession
    text_batches(spark)
    parts = gram_indexes(benchmark, n, part_words)
    first, second = next(parts, None), next(parts, None)
    if second is not None:
        return _by_parts(docs, chain([first, second], parts), mode, id_col, text_col)
    shared = spark.sparkContext.broadcast(first or GramIndex([], n))

    def judged(text: bytes):
        index, words = shared.value, words_of(text)
        mask, hit = index.scan(words)
        return words, mask, sorted({index.names[i] for i in hit} - {None})

    if mode == "report":

        def run(batches):
            for b in batches:
                out = [judged(t) for t in utf8(b.column(1))]
                cols = [b.column(0), pa.array([len(w) for w, _, _ in out], pa.int64()), pa.array([int(m.sum()) for _, m, _ in out], pa.int64()), pa.array([len(i) for _, _, i in out], pa.int64()), pa.array([i for _, _, i in out], pa.list_(pa.string())), pa.array([bool(m.any()) for _, m, _ in out], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "n_items", "items", "contaminated"])

        rows = docs.select(id_col, text_col)
        return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean")

    at = docs.columns.index(text_col)
    if mode == "documents":

        def keep(batches):
            for b in batches:
                yield b.filter(pa.array([not judged(t)[1].any() for t in utf8(b.column(at))], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    if mode == "spans":

        def cut(batches):
            for b in batches:
                texts = []
                for old, t in zip(b.column(at).to_pylist(), utf8(b.column(at)), strict=True):
                    _, mask, _ = judged(t)
                    texts.append(cut_spans(t, mask) if mask.any() else old)
                yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

        return docs.mapInArrow(cut, docs.schema)
    return docs


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _by_parts(docs: DataFrame, parts, mode: str, id_col: str, text_col: str) -> DataFrame:
    """decontaminate with one part of the benchmark live at a time."""
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.lit(8), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_i"), text_hash.alias("_h"), F.col(text_col).alias("_t"))
    kind = rows.schema["_i"].dataType.simpleString()
    found = None
    for index in parts:
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            for b in batches:
                keep, spans, items = [], [], []
                for at, t in enumerate(utf8(b.column(2))):
                    mask, hit = shared.value.scan(words_of(t))
                    if hit:
                        keep.append(at)
                        spans.append([{"lo": lo, "hi": hi} for lo, hi in _runs(mask)])
                        items.append(sorted({shared.value.names[i] for i in hit} - {None}))
                ids = b.select([0, 1]).take(pa.array(keep, pa.int64()))
                span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=["_i", "_h", "spans", "items"])

        got = rows.mapInArrow(scan, f"_i {kind}, _h long, spans array<struct<lo:int,hi:int>>, items array<string>")
        got = written(got.dropDuplicates(["_i", "_h"]), "bench-hits")
        shared.destroy()
        found = got if found is None else found.unionByName(got)
    merged = found.groupBy("_i", "_h").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    merged = merged.select(F.col("_i").alias("_mi"), F.col("_h").alias("_mh"), "_spans", "_items")
    on = F.col("_i").eqNullSafe(F.col("_mi")) & (F.col("_h") == F.col("_mh"))
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), text_hash.alias("_h"))
    if mode == "documents":
        return packed.join(merged, on, "left_anti").select("_row.*")
    joined = packed.join(merged, on, "left")
    text = F.col("_row").getField(text_col)
    if mode == "report":
        places = F.flatten(F.transform("_spans", lambda s: F.sequence(s["lo"], s["hi"] - 1)))
        n_hit = F.coalesce(F.when(F.col("_spans").isNotNull(), F.size(F.array_distinct(places))), F.lit(0)).cast("long")
        items = F.coalesce("_items", F.array().cast("array<string>"))
        words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        return joined.select(F.col("_i").alias(id_col), words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, spans, strict=True):
            raw = t.encode()
            mask = np.zeros(len(words_of(raw)), bool)
            for s in found:
                mask[s["lo"] : s["hi"]] = True
            out.append(cut_spans(raw, mask))
        return pd.Series(out, dtype=object)

    hit = joined.where(F.col("_spans").isNotNull()).select(F.col("_row").withField(text_col, cut(text, F.col("_spans"))).alias("_row"))
    return joined.where(F.col("_spans").isNull()).select("_row").unionByName(hit).select("_row.*")


def cut_spans(text: bytes, mask: np.ndarray) -> str:
    """The text without its marked words; what separates the words of a marked run goes too."""
    flat = np.frombuffer(text.translate(_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    starts, ends, out, at = edge[0::2], edge[1::2], [], 0
    run = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    for first, last in zip(run[0::2], run[1::2], strict=True):
        out.append(text[at : starts[first]])
        at = ends[last - 1]
    return (b"".join(out) + text[at:]).decode()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate over all of `documents` and `benchmark`, windows of ten words."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", named, "contaminated")


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, l WHERE len(w) >= n)),
m AS (SELECT o.doc_id, o.p, o.n, g.item_id FROM o JOIN g ON o.win = g.win AND o.n = g.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
