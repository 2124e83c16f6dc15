"""Token-ID output as sorted-string-table shards, and reading them back."""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, text_batches, utf8
from .sstable import Reader, Writer

#: Pieces whose ids an encoder remembers: two generations of half as many each.
REMEMBERED = 800_000
#: Text bytes that are cut and looked up at a time; longer texts are sliced between words.
SLICE_BYTES = 4 << 20
#: Classes of characters; every character of a piece, but for its leading blank, has one.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: First code point that the cutter leaves to the library.
BEYOND = 0x250


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Class of each code point below BEYOND."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(BEYOND)]
    out = np.array([{"L": LETTER, "N": NUMBER}.get(k, OTHER) for k in kinds], np.uint8)
    out[[c for c in range(BEYOND) if chr(c) in "\t\n\v\f\r \x85\xa0"]] = SPACE
    return out


def piece_starts(raw: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer's pieces start, as byte positions of UTF-8 text
    below BEYOND; `first` are the starts of its texts (none empty).

    A piece is a run of letters, numbers or other marks with the one blank (0x20) before
    it; or white space: a run that ends its text, a run but for its last character, and that
    character if it isn't a blank; or an apostrophe with s, d, m, t, ll, ve or re where no
    blank precedes it.
    """
    n, lead = len(raw), np.flatnonzero(raw >= 0xC0)
    kind = np.where(raw < 0x80, classes[raw & 0x7F], 0).astype(np.uint8)
    two = classes[((raw[lead].astype(np.int32) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)]
    kind[lead], kind[lead + 1] = two, two
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[first] = True
    # The last character of white space before anything else: it goes with what follows, or alone.
    begins = np.zeros(n + 1, bool)
    begins[first], begins[n] = True, True
    after = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & ~begins[1:n]) + 1  # starts of runs that follow white space in the text
    last = after - 1 - (raw[after - 1] >= 0x80)
    blank = raw[last] == 0x20
    start[after[blank]] = False
    start[last] = True
    # Apostrophes.
    mark = np.flatnonzero((raw[:-1] == 0x27) & (kind[1:] == LETTER) & start[:-1])
    mark = mark[~begins[mark + 1]]
    if len(mark):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        b, c = padded[mark + 1], padded[mark + 2]
        inside = ~begins[np.minimum(mark + 2, n)]
        one = np.isin(b, np.frombuffer(b"sdmt", np.uint8))
        pair = inside & (((b == 0x6C) & (c == 0x6C)) | ((b == 0x76) & (c == 0x65)) | ((b == 0x72) & (c == 0x65)))
        for hit, size in ((one, 2), (pair & ~one, 3)):
            at = mark[hit]
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


def _border(text: bytes, low: int, at: int) -> int:
    """The last place in low + 1..at, or else the first beyond, where pieces always part: a
    blank between two ASCII characters that are no white space. The text's end if there is
    none."""
    gap, back = re.compile(rb"[!-~] (?=[!-~])"), max(low, at - (1 << 16))
    found = [m.start() + 1 for m in gap.finditer(text, back, at)]
    if found:
        return found[-1]
    later = gap.search(text, at - 1 if at - 1 > low else low)
    return later.start() + 1 if later else len(text)


class Encoder:
    """The tokenizers library behind a memory of pieces.

    Byte-level BPE encodes each piece that the pre-tokenizer cuts by itself, so that the
    library needs to see each distinct piece once only. The pieces of many texts are cut
    with array operations and made distinct by Arrow's dictionary; new ones go to the
    library, many to a call. Pieces are cut here where that is certain to agree with the
    library: texts below BEYOND without the string of an added token. Every other text goes
    to the library whole, as does every text of a tokenizer with another pre-tokenizer or a
    normaliser.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = [a.encode() for a in added]
        self.wide = re.compile(rb"[\xca-\xff]|\xc9[\x90-\xbf]")
        self.classes = _classes()
        #: Ids whose string starts with a blank: where joined pieces part.
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> bool:
        """Whether the library has to see the whole text."""
        if not self.plain or any(a in text for a in self.added):
            return True
        return int(np.frombuffer(text, np.uint8).max()) >= 0xC9 and self.wide.search(text) is not None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces. Those with a leading blank are joined, 1,000 to a call: the joined
        text is cut into the same pieces, and each one's ids start where a blank does."""
        out: dict[bytes, bytes] = {}
        joined = [p for p in pieces if p[:1] == b" " and p[1:2].strip()]
        single = [p for p in pieces if not (p[:1] == b" " and p[1:2].strip())]
        for at in range(0, len(joined), 1000):
            part = joined[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) != len(part):  # another alphabet: one by one
                single += part
                continue
            raw, edge = ids.tobytes(), np.append(cut, len(ids)) * self.width
            edge = edge.tolist()
            out.update((p, raw[edge[i] : edge[i + 1]]) for i, p in enumerate(part))
        for at in range(0, len(single), 1000):
            part = single[at : at + 1000]
            out.update(zip(part, self._library([p.decode() for p in part]), strict=True))
        return out

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.young) + len(pieces) > REMEMBERED // 2:
            self.young, self.old = {}, self.young
        got = list(map(self.young.get, pieces))
        if None in got:
            lost = [p for p, v in zip(pieces, got, strict=True) if v is None]
            kept = {p: v for p, v in zip(lost, map(self.old.get, lost), strict=True) if v is not None}
            fresh = self._new([p for p in lost if p not in kept])
            self.young.update(kept)
            self.young.update(fresh)
            got = [self.young[p] if v is None else v for p, v in zip(pieces, got, strict=True)]
        return got

    def _sliced(self, parts: list[bytes]) -> list[bytes]:
        """Ids of short texts, none of them empty or for the library."""
        raw = b"".join(parts)
        first = np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(raw, np.uint8)
        starts = piece_starts(data, self.classes, first[:-1])
        edge = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self._look_up(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(starts) + 1]
        flat = ids.buffers()[2]
        flat = flat.to_pybytes() if flat is not None else b""
        cut = at[np.searchsorted(edge, first)].tolist()
        return [flat[cut[i] : cut[i + 1]] for i in range(len(parts))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian integers of `width` bytes."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            for (i, _), v in zip(held, self._sliced([p for _, p in held]) if held else [], strict=True):
                out[i].append(v)
            held.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if self._whole(t):
                out[i] = self._library([t.decode()])  # one at a time: a long text's encoding is large
                continue
            at = 0
            while at < len(t):
                end = len(t) if len(t) - at <= SLICE_BYTES else _border(t, at, at + SLICE_BYTES)
                held.append((i, t[at:end]))
                size += end - at
                at = end
                if size >= SLICE_BYTES:
                    flush()
                    size = 0
        flush()
        return [b"".join(v) for v in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text's ids and `end_id` to sorted-string-table shards under the URI
    `path`, in ascending id order over all shards.

    Null texts count as empty, null ids come first. Rows that share an id are entries of
    their own, in the order of their text's hash, and may lie in adjacent shards. Returns
    the manifest, one row a shard: shard int, file string, n_docs long, n_ids long. An
    empty table gives no or empty shards.

    One shuffle, by ranges of (id, text hash): a repeated id doesn't load one task. A task
    holds a few texts, one block and its shard's keys. It writes to a file named by its own
    attempt, and only the manifest publishes names, so that a task run again, after an
    executor is lost, never meets its predecessor's file; nothing is renamed.
    """
    text_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    rows = rows.repartitionByRange("_i", "_h").sortWithinPartitions("_i", "_h").select("_i", "_t")

    def run(batches):
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        with fs.open_output_stream(f"{root}/{name}") as out:
            w = Writer(out, enc.width)
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), enc.encode(utf8(b.column(1))), strict=True):
                    w.add(i, v + end)
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": pa.array([w.count], pa.int64()), "n_ids": pa.array([w.ids], pa.int64())})

    return rows.mapInArrow(run, "shard int, file string, n_docs long, n_ids long")


def drop_unlisted(path: str, manifest: list) -> None:
    """Removes what failed attempts left: shard files that the manifest doesn't name."""
    fs, root = _open(path)
    from pyarrow.fs import FileSelector

    listed = {r["file"] for r in manifest}
    for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
        if f.base_name not in listed:
            fs.delete_file(f.path)


def read_tokens(spark: SparkSession, path: str, manifest: list, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Reads the shards of a collected manifest (one row a shard) back, a block at a time.

    Returns id, start long (ids of all documents before it), n_tokens long, ids_crc32 long
    (crc32 of the ids as little-endian unsigned 32-bit integers) and, unless with_ids is
    False, ids array<int>.
    """
    plan, total = [], 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        plan.append((r["file"], total))
        total += r["n_ids"]
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not plan:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, root = _open(path)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    reader, rows = Reader(f), []
                    for doc_id, value in reader.scan():
                        ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *[ids.view("<i4")] * with_ids))
                        start += len(ids)
                        if len(rows) == 256:
                            yield _batch(rows, id_col, with_ids)
                            rows = []
                    yield _batch(rows, id_col, with_ids)

    files = spark.createDataFrame(plan, "file string, start long").repartition(len(plan))
    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], id_col: str, with_ids: bool) -> pa.RecordBatch:
    cols, names = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], [id_col, "start", "n_tokens", "ids_crc32"]
    if with_ids:
        offsets = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))).astype(np.int32)
        values = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """write_tokens to a new folder of the shared directory, then read_tokens."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    manifest = write_tokens(docs, path, tokenizer, end_id).collect()  # one row a shard
    drop_unlisted(path, manifest)
    return read_tokens(spark, path, manifest, with_ids=with_ids)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_table over all of `documents` with the 50k byte-level BPE, end id 0."""
    return token_table(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
