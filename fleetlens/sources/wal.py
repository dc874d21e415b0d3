"""Write-ahead log segments: frames read as rows, and rows written as frames for round trips.

A frame, all numbers little-endian: length of what follows (u32), magic, version (u16), kind (u8), zero (u8), log index
(u64), payload length (u32), payload, SHA-256 of everything between the length and itself.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format.
MAGIC, VERSION = b"MRW1", 1
PREPARE, COMMIT, SNAPSHOT = 1, 2, 3
HEAD = struct.Struct("<4sHBBQI")
SUM_BYTES = 32
SCHEMA = "path string, offset long, kind int, log_index long, payload binary"


class CorruptFrame(ValueError):
    def __init__(self, path: str, offset: int) -> None:
        super().__init__(f"{path}: corrupt frame at byte {offset}")
        self.offset = offset


def frame(kind: int, log_index: int, payload: bytes) -> bytes:
    body = HEAD.pack(MAGIC, VERSION, kind, 0, log_index, len(payload)) + payload
    return struct.pack("<I", len(body) + SUM_BYTES) + body + hashlib.sha256(body).digest()


def frames(data: bytes, path: str = "", most: int = 1 << 26) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, kind, log index, payload) of each frame; a short tail ends the log, anything else wrong is CorruptFrame."""
    view, at = memoryview(data), 0
    while len(view) - at >= 4:
        (length,) = struct.unpack_from("<I", view, at)
        if len(view) - at - 4 < length:
            return
        body = view[at + 4 : at + 4 + max(length - SUM_BYTES, 0)]
        if len(body) < HEAD.size or hashlib.sha256(body).digest() != bytes(view[at + 4 + len(body) : at + 4 + length]):
            raise CorruptFrame(path, at)
        magic, version, kind, zero, index, size = HEAD.unpack_from(body)
        if (magic, version, zero) != (MAGIC, VERSION, 0) or kind not in (PREPARE, COMMIT, SNAPSHOT) or size > most or size != len(body) - HEAD.size:
            raise CorruptFrame(path, at)
        yield at, kind, index, bytes(body[HEAD.size :])
        at += 4 + length


def read_frames(spark: SparkSession, path: str, rows_a_batch: int = 1024) -> DataFrame:
    """A row for each frame of the segments under path (any store Spark reads); segments are read in parallel.

    A segment is one task's input, as frames carry no marks to start from in its middle; logs roll to new segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("kind", pa.int32()), ("log_index", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held: list[tuple] = []
                for found in frames(data.as_py() or b"", name):
                    held.append((name, *found))
                    if len(held) == rows_a_batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def committed(read: DataFrame) -> DataFrame:
    """log_index and payload of prepared entries whose commit is in the log."""
    done = read.where(f"kind = {COMMIT}").select("log_index").distinct()
    return read.where(f"kind = {PREPARE}").join(done, "log_index", "left_semi").select("log_index", "payload")
