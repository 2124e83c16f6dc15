"""Sorted-string-table files of token ids.

    data blocks | index | Bloom filter | footer

A data block holds entries in ascending key order. An entry is: shared key bytes (u8),
other key bytes (u8), value bytes (u32), the other key bytes, the value. Blocks are
zstandard frames, and the sparse index has for each the last key, offset, length, crc32,
entries and ids. A key is 9 bytes: 0 for null or 1, then the identifier as a big-endian
signed integer with its sign bit turned. A value is the ids as little-endian unsigned
integers, 2 bytes each where the vocabulary allows, else 4.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard
from xxhash import xxh64_intdigest

MAGIC = b"TKSSTAB1"
_ENTRY, _INDEX, _FOOT = struct.Struct("<BBI"), struct.Struct("<9sQIIIQ"), struct.Struct("<QQQQQQBB8s")
FOOTER = _FOOT.size


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int, k: int) -> list[int]:
    a, b = xxh64_intdigest(key, 1), xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(k)]


class Writer:
    """Writes entries, which come in ascending key order, to a binary stream; holds one
    block, the sparse index and the keys of the Bloom filter."""

    def __init__(self, out, width: int = 2, block_bytes: int = 64 << 10, bits_per_key: int = 10, probes: int = 7):
        self.out, self.width, self.block_bytes, self.bits_per_key, self.probes = out, width, block_bytes, bits_per_key, probes
        self.at, self.index, self.keys, self.buf, self.size = 0, [], [], [], 0
        self.last, self.count, self.ids, self.in_block, self.block_ids = b"", 0, 0, 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, shared = key_of(doc_id), 0
        if self.in_block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.buf += [_ENTRY.pack(shared, 9 - shared, len(ids)), key[shared:], ids]
        self.size += len(ids) + 15 - shared
        self.last, self.count, self.in_block = key, self.count + 1, self.in_block + 1
        self.ids += len(ids) // self.width
        self.block_ids += len(ids) // self.width
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.in_block:
            data = self.zip.compress(b"".join(self.buf))
            self.index.append((self.last, self.at, len(data), zlib.crc32(data), self.in_block, self.block_ids))
            self._put(data)
            self.buf, self.size, self.in_block, self.block_ids = [], 0, 0, 0

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(_INDEX.pack(*x) for x in self.index))
        bits = max(64, len(self.keys) * self.bits_per_key)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits, self.probes)] = True
        bloom_at = self.at
        self._put(np.packbits(bloom).tobytes())
        self._put(_FOOT.pack(index_at, len(self.index), bloom_at, bits, self.count, self.ids, self.probes, self.width, MAGIC))


class Reader:
    """Reads a file by seeks: footer, index and filter first, then a block at a time."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - FOOTER)
        index_at, blocks, bloom_at, self.bits, self.count, self.ids, self.probes, self.width, magic = _FOOT.unpack(file.read(FOOTER))
        if magic != MAGIC:
            raise ValueError("not a sorted string table")
        file.seek(index_at)
        raw = file.read(bloom_at - index_at)
        self.index = [_INDEX.unpack_from(raw, i * _INDEX.size) for i in range(blocks)]
        self.last_keys = [x[0] for x in self.index]
        self.bloom = np.unpackbits(np.frombuffer(file.read((self.bits + 7) // 8), np.uint8))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, crc, _, _ = self.index[i]
        self.file.seek(at)
        data = self.file.read(size)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged block")
        data, at, key = zstandard.ZstdDecompressor().decompress(data), 0, b""
        while at < len(data):
            shared, other, size = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.index)):
            for key, value in self._block(i):
                yield id_of(key), value

    def might_hold(self, doc_id: int | None) -> bool:
        return bool(self.bloom[_probes(key_of(doc_id), self.bits, self.probes)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with that identifier: filter, then binary search of the
        sparse index, then one block (more if entries with this key run on)."""
        key, found = key_of(doc_id), []
        if not self.might_hold(doc_id):
            return found
        for i in range(bisect_left(self.last_keys, key), len(self.index)):
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self._block(i) if k == key]
            if self.last_keys[i] > key:
                break
        return found
