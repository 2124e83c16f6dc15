"""Python data source for tick files of packed records.

Layout (fixed values of the format): a header that begins with the magic SCID, then
header size u32 at 4, record size u32 at 8, version u16 at 12; records of 40 bytes or more,
little-endian: time i64 (microseconds since 1899-12-30), open, high, low, close f32, trades
i32, volume, bid volume, ask volume u32.
"""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MAGIC = b"SCID"
RECORD = np.dtype([("time", "<i8"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("num_trades", "<i4"), ("volume", "<u4"), ("bid_volume", "<u4"), ("ask_volume", "<u4")])
#: Microseconds from 1899-12-30 to 1970-01-01: 25569 days.
EPOCH = 25569 * 86_400 * 1_000_000
SCHEMA = "ts timestamp, seq long, open double, high double, low double, close double, num_trades int, volume double, bid_volume double, ask_volume double, delta double"


def _open(path: str):
    from pyarrow import fs

    if "://" not in path:
        return open(path, "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def header(path: str) -> dict:
    """Sizes and number of records, from the header and the file's length."""
    with _open(path) as f:
        head = f.read(56)
        f.seek(0, 2)
        end = f.tell()
    if head[:4] != MAGIC:
        raise ValueError(f"{path}: not a tick file")
    size, record, version = struct.unpack_from("<IIH", head, 4)
    return {"header_size": size, "record_size": record, "version": version, "records": (end - size) // record}


def decode(data: bytes, record_size: int, first: int) -> pa.RecordBatch:
    """Records as an Arrow batch: an open of 0 is the close, records without volume go,
    delta = ask - bid."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, record_size)[:, : RECORD.itemsize]
    r = np.frombuffer(np.ascontiguousarray(raw).tobytes(), RECORD)
    keep = r["volume"] > 0
    seq, r = np.arange(first, first + len(r))[keep], r[keep]
    col = lambda n: pa.array(r[n].astype(np.float64))
    opened = np.where(r["open"] == 0, r["close"], r["open"]).astype(np.float64)
    cols = [pa.array(r["time"] - EPOCH, pa.timestamp("us", "UTC")), pa.array(seq, pa.int64()), pa.array(opened), col("high"), col("low"), col("close"), pa.array(r["num_trades"]), col("volume"), col("bid_volume"), col("ask_volume"), pa.array(r["ask_volume"].astype(np.float64) - r["bid_volume"])]
    return pa.RecordBatch.from_arrays(cols, names=["ts", "seq", "open", "high", "low", "close", "num_trades", "volume", "bid_volume", "ask_volume", "delta"])


def _place(path: str, head: dict, micros: int) -> int:
    """Number of the first record at or after a time, by bisection: records are in time order."""
    low, high = 0, head["records"]
    with _open(path) as f:
        while low < high:
            mid = (low + high) // 2
            f.seek(head["header_size"] + mid * head["record_size"])
            if struct.unpack("<q", f.read(8))[0] - EPOCH < micros:
                low = mid + 1
            else:
                high = mid
    return low


def bounds(path: str, head: dict, options: dict) -> tuple[int, int]:
    """First and last + 1 record of the options from and to (ISO times, UTC unless they say
    otherwise; from is included, to isn't); all records without them."""

    def place(name: str, default: int) -> int:
        if name not in options:
            return default
        at = datetime.fromisoformat(options[name])
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        return _place(path, head, (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1))

    first = place("from", 0)
    return first, max(first, place("to", head["records"]))


def span(path: str) -> tuple | None:
    """Times of the first and the last record, without a scan; None if there are no records."""
    head = header(path)
    if not head["records"]:
        return None
    out = []
    with _open(path) as f:
        for i in (0, head["records"] - 1):
            f.seek(head["header_size"] + i * head["record_size"])
            out.append(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=struct.unpack("<q", f.read(8))[0] - EPOCH))
    return tuple(out)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ScidReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tail, self.rows = options["path"], int(options.get("tail", 0)), int(options.get("partitionrecords", 4_000_000))
        self.head = header(self.path)
        self.bounds = bounds(self.path, self.head, options)

    def partitions(self):
        first, n = self.bounds
        first = max(first, n - self.tail) if self.tail else first
        return [Range(i, min(i + self.rows, n)) for i in range(first, n, self.rows)] or [Range(0, 0)]

    def read(self, part: Range):
        size = self.head["record_size"]
        with _open(self.path) as f:
            f.seek(self.head["header_size"] + part.first * size)
            for at in range(part.first, part.last, 100_000):
                n = min(100_000, part.last - at)
                yield decode(f.read(n * size), size, at)


class ScidTail(SimpleDataSourceStreamReader):
    """Whole records appended since the last offset, which is a record number."""

    def __init__(self, options: dict):
        self.path, self.most, self.options = options["path"], int(options.get("maxrecords", 100_000)), options

    def initialOffset(self):
        return {"record": bounds(self.path, header(self.path), self.options)[0]}

    def _end(self, head: dict) -> int:
        """The end of a replay is fixed by `to`; a tail has none."""
        return bounds(self.path, head, self.options)[1] if "to" in self.options else head["records"]

    def _rows(self, first: int, last: int, head: dict):
        with _open(self.path) as f:
            f.seek(head["header_size"] + first * head["record_size"])
            batch = decode(f.read((last - first) * head["record_size"]), head["record_size"], first)
        return iter([tuple(r.values()) for r in batch.to_pylist()])

    def read(self, start):
        head, first = header(self.path), start["record"]
        last = max(first, min(self._end(head), first + self.most))
        return self._rows(first, last, head), {"record": last}

    def readBetweenOffsets(self, start, end):
        return self._rows(start["record"], end["record"], header(self.path))


class ScidDataSource(DataSource):
    """spark.dataSource.register(ScidDataSource); spark.read.format("scid").load(path).
    Options: from and to (times; both take files whose records are in time order), tail (last
    records only), partitionRecords, maxRecords (stream, a micro-batch: with from and to it
    replays a slice)."""

    @classmethod
    def name(cls):
        return "scid"

    def schema(self):
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema):
        return ScidReader(self._options())

    def simpleStreamReader(self, schema):
        return ScidTail(self._options())
