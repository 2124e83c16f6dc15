"""Exact substring dedup with suffix arrays in content-addressed buckets."""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, utf8, written
from .suffixes import repeated_starts

#: Bytes of an anchor gram.
GRAM = 32
#: Distinct blocks of one core beyond which they are cut into parts.
CROWD = 512
#: Bytes of one suffix array, about.
ARRAY_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, size: int) -> np.ndarray:
    """base ** 0 ... base ** (size - 1) modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(size - 1, 0), base, np.uint64), dtype=np.uint64)))


class Rolling:
    """Hashes of the substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + 1) * _powers(_BASE, len(data)), dtype=np.uint64)))
        self.inverse = _powers(_INVERSE, len(data) + 1)

    def each(self, size: int) -> np.ndarray:
        """Those of `size` bytes, in order of their starts."""
        with np.errstate(over="ignore"):
            h = (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, doc: np.ndarray, width: int):
    """For texts laid end to end (`doc`: where each starts, and the end): runs of starts of
    `width`-byte strings that share an anchor, the least hashed gram inside the string,
    leftmost if tied. Equal strings have their anchor at the same place.

    Returns (text number, first start, last start, anchor place, anchor hash), places in
    the whole array.
    """
    size, grams = len(data), width - GRAM + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if size < width:
        return none
    hashes = Rolling(data).each(GRAM)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= grams:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: size - width + 1], least[grams - span : grams - span + size - width + 1])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Starts of each text's first string and of its last; strings of different texts share no run.
    held = np.flatnonzero(np.diff(doc) >= width)
    if not len(held):
        return none
    low, high = doc[held], doc[held + 1] - width
    new = np.concatenate(([True], place[1:] != place[:-1]))
    new[low] = True
    first = np.flatnonzero(new)
    till = np.append(first[1:], len(place)) - 1
    text = np.searchsorted(low, first, side="right") - 1
    inside = (text >= 0) & (first <= high[text])
    first, till, text = first[inside], till[inside], text[inside]
    return held[text], first, np.minimum(till, high[text]), place[first], hashes[place[first]]


def _encoded(width: int):
    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = utf8(b.column(2))
            out: list[tuple] = []
            for lo, hi in _slices(texts):
                part = texts[lo:hi]
                doc = np.cumsum([0, *map(len, part)])
                data = np.frombuffer(b"".join(part), np.uint8)
                own, first, last, place, hashes = anchors(data, doc, width)
                cut = np.searchsorted(own, np.arange(len(part) + 1))
                for i, t in enumerate(part):
                    on = slice(cut[i], cut[i + 1])
                    out.append((zip_.compress(t), hashes[on].view(np.int64), (first[on] - doc[i]).astype(np.int32), (last[on] - doc[i]).astype(np.int32)))
            cols = [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.binary())]
            cols += [pa.array([x[i] for x in out], pa.list_(pa.int64() if i == 1 else pa.int32())) for i in range(1, 4)]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "zip", "hash", "first", "last"])

    return run


def _slices(texts: list[bytes], most: int = 1 << 20):
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _sizes(lists: pa.Array) -> np.ndarray:
    """Items of each list, none for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(width: int):
    """The marked anchors' runs as blocks: (rid, start, core, h1, h2, bytes). A block holds
    the bytes of all strings of the run; its core is the anchor's hash. Bytes are null where
    this task has sent the same block before."""

    def run(batches):
        unzip, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            rows: list[tuple] = []
            each, marks = _sizes(b.column(2)), _sizes(b.column(5))
            at = np.repeat(np.cumsum(each) - each, marks) + b.column(5).flatten().to_numpy()
            runs = zip(*(b.column(i).flatten().to_numpy()[at].tolist() for i in (2, 3, 4)), strict=True)
            for rid, packed, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), marks.tolist(), strict=True):
                text = unzip.decompress(packed)
                for core, first, last in islice(runs, n):
                    part = text[first : last + width]
                    h = xxhash.xxh3_128_digest(part)
                    new = h not in seen
                    if new:
                        seen.add(h)
                    rows.append((rid, first, core, h, part if new else None))
                if len(rows) > 20_000:
                    yield _block_batch(rows)
                    rows = []
                if len(seen) > 1_000_000:
                    seen.clear()
            yield _block_batch(rows)

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    whole = np.frombuffer(b"".join(r[3] for r in rows), "<i8").reshape(-1, 2)
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array([r[4] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["rid", "start", "core", "h1", "h2", "bytes"])


def _sorted_hits(width: int):
    """Suffix arrays over whole cores (rows come sorted by core): (h1, h2, mask), a bit for
    each start that hits, for blocks with any. Several cores share an array: equal strings
    lie in one. A block that occurs more than once hits at every start, so that a core
    of such blocks alone is not sorted."""

    def emit(rows: list[tuple]):
        open_cores = {r[0] for r in rows if r[4] == 1}
        hits = iter(repeated_starts([r[3] for r in rows if r[0] in open_cores], width))
        out = []
        for core, h1, h2, data, n in rows:
            mask = next(hits) if core in open_cores else None
            if n > 1:
                mask = np.ones(len(data) - width + 1, bool)
            if mask.any():
                out.append((h1, h2, np.packbits(mask).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i == 2 else pa.int64()) for i in range(3)], names=["h1", "h2", "mask"])

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held > ARRAY_BYTES and r[0] != rows[-1][0]:
                    yield emit(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3])
        if rows:
            yield emit(rows)

    return run


def _parts(width: int, size: int):
    """Blocks cut by the offset of the anchor in their strings, ranges of `size` offsets:
    (p1, p2, off, core, h1, h2, bytes, n), the parent block, where the part starts in it,
    and the part as a block. Its core is a hash of the bytes that all strings of the range
    hold around the anchor, so that equal strings lie in parts of one core."""

    def run(batches):
        for b in batches:
            blocks = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            for lo, hi in _slices([x[2] for x in blocks]):
                yield cut(blocks[lo:hi])

    def cut(blocks: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([0, *[len(x[2]) for x in blocks]])
        own, _, _, place, _ = anchors(np.frombuffer(b"".join(x[2] for x in blocks), np.uint8), ends, width)
        rows = []
        for k, at in zip(own.tolist(), (place - ends[own]).tolist(), strict=True):
            p1, p2, data, n = blocks[k]
            least = at - len(data) + width  # offsets in this block: least ... at
            for node in range(least // size, at // size + 1):
                lo, hi = node * size, min(node * size + size - 1, width - GRAM)
                off = at - min(at, hi)
                part = data[off : at - max(least, lo) + width]
                core = xxhash.xxh3_64_intdigest(data[at - lo : at - hi + width], node)
                rows.append((p1, p2, off, core, xxhash.xxh3_128_digest(part), part, n))
        whole = np.frombuffer(b"".join(r[4] for r in rows), "<i8").reshape(-1, 2)
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(np.array([r[3] for r in rows], np.uint64).view(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array([r[5] for r in rows], pa.binary()), pa.array([r[6] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["p1", "p2", "off", "core", "h1", "h2", "bytes", "n"])

    return run


def _block_hits(same: DataFrame, width: int) -> DataFrame:
    """(h1, h2, off int, mask): for distinct blocks, the starts that hit, a bit for each from
    `off` on; a block may have several rows.

    Cores of at most CROWD distinct blocks are suffix-sorted. The blocks of a larger core are
    cut into parts, of 64 offsets of the anchor, then 16, 4 and 1: parts inside what the
    texts share are equal and combine, those beyond it differ in their core, and only the parts
    across its border are cut again. Parts of one offset are single strings, equal within
    their core, so that no core is too large at the end.
    """
    sizes = [4**k for k in range(16, -1, -1) if 4**k <= width - GRAM]
    found, cuts = [], []
    for level in range(len(sizes) + 1):
        crowds = written(same.groupBy("core").count().where(F.col("count") > CROWD).select("core"), "suffix-crowds")
        cold = same.join(crowds.hint("merge"), "core", "left_anti").repartition("core").sortWithinPartitions("core")
        hits = cold.select("core", "h1", "h2", "bytes", "n").mapInArrow(_sorted_hits(width), "h1 long, h2 long, mask binary")
        found.append(written(hits.select("h1", "h2", F.lit(0).alias("off"), "mask"), "suffix-found"))
        if level == len(sizes) or crowds.isEmpty():
            break
        crowded = same.join(crowds.hint("merge"), "core", "left_semi").select("h1", "h2", "bytes", "n")
        parts = written(crowded.mapInArrow(_parts(width, sizes[level]), "p1 long, p2 long, off int, core long, h1 long, h2 long, bytes binary, n long"), "suffix-parts")
        cuts.append(parts.select("p1", "p2", F.col("off").alias("by"), "h1", "h2"))
        same = written(parts.groupBy("core", "h1", "h2").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n")), "suffix-same")
    hits = found.pop()
    while cuts:
        up = cuts.pop().join(hits.hint("merge"), ["h1", "h2"])
        hits = written(found.pop().unionAll(up.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("by") + F.col("off")).alias("off"), "mask")), "suffix-hits")
    return hits


def _finish(width: int):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            runs = zip(*(f.to_pylist() for f in b.column(2).flatten().flatten()), strict=True)
            for packed, n in zip(b.column(1).to_pylist(), _sizes(b.column(2)).tolist(), strict=True):
                text = unzip.decompress(packed)
                if not n:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text.decode()))
                    continue
                starts, masks = zip(*islice(runs, n), strict=True)
                sizes = 8 * np.fromiter(map(len, masks), np.int64, n)
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(masks), np.uint8)))
                at = bits + np.repeat(np.array(starts) - np.cumsum(sizes) + sizes, sizes)[bits]
                edge = np.bincount(at, minlength=len(text) + 1) - np.bincount(at + width, minlength=len(text) + 1)
                gone = np.cumsum(edge)[: len(text)] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int(((~gone[:-1]) & gone[1:]).sum())
                out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [b.column(0), *[pa.array([x[i] for x in out], kinds[i]) for i in range(5)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return run


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte that lies in a string of `width` bytes which also starts anywhere
    else in the texts (UTF-8), the same text included.

    Returns doc_id long, n_bytes long, n_removed long, n_spans long (maximal removed runs),
    kept_sha256 string (of what stays), text string (what stays, less what is left of cut
    characters). Null texts count as empty. Strings are judged on the input and never cross
    texts. Repeated rows are texts of their own and cover each other. Texts shorter than
    `width` lose nothing. Null ids pass through. width > GRAM.

    Each string of `width` bytes has an anchor (its least hashed gram). Strings whose
    anchor's hash occurs once in all texts can't repeat; this first filter moves 8 bytes
    for about 85 bytes of text. The strings of each other anchor occurrence make a block, and
    blocks with the same anchor hash (core) one bucket, where a suffix array (two-stage sorting) and
    its adjacent common prefixes tell which strings repeat. Blocks that are equal as a
    whole (copies) combine on the map side and are sorted once. A core with very many
    distinct blocks, a passage that many texts hold in different surroundings, doesn't go
    to one task: its blocks are cut into smaller ones with more bytes in their core, until
    no core is large (_block_hits).
    The last step puts hits into their texts; its hot keys are texts, of bounded size.
    """
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    text_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = written(rows.mapInArrow(_encoded(width), "rid long, doc_id long, zip binary, hash array<long>, first array<int>, last array<int>"), "suffix-texts")
    spots = texts.select("rid", F.posexplode("hash").alias("k", "h"))
    again = written(spots.groupBy("h").count().where("count > 1").select("h"), "suffix-anchors")
    marked = spots.join(again.hint("merge"), "h").groupBy("rid").agg(F.collect_list("k").alias("marked"))
    parts = texts.select("rid", "zip", "hash", "first", "last").join(marked.hint("merge"), "rid")
    kind = "rid long, start int, core long, h1 long, h2 long, bytes binary"
    blocks = written(parts.select("rid", "zip", "hash", "first", "last", "marked").mapInArrow(_blocks(width), kind), "suffix-blocks")
    same = written(blocks.groupBy("core", "h1", "h2").agg(F.first("bytes", ignorenulls=True).alias("bytes"), F.count(F.lit(1)).alias("n")), "suffix-same")
    every = _block_hits(same, width)
    placed = blocks.select("rid", "start", "h1", "h2").join(every.hint("merge"), ["h1", "h2"])
    per_text = placed.groupBy("rid").agg(F.collect_list(F.struct((F.col("start") + F.col("off")).alias("start"), "mask")).alias("hits"))
    whole = texts.select("rid", "doc_id", "zip").join(per_text.hint("merge"), "rid", "left").select("doc_id", "zip", "hits")
    return whole.mapInArrow(_finish(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix_dedup over all of `documents`, strings of 200 bytes."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("text")
