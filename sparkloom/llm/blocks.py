"""Blocks of 64-bit hashes on their way through a shuffle, and bitmaps of a fixed size built from them.

Hashes travel as binary blocks, one row per Arrow batch and bucket, so that neither the JVM nor Python handles them one by one.
A bucket is a range of the hash's upper bits, thus also a range of a bitmap's slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.wordhash import tidy

BLOCK_SCHEMA = "bucket int, data binary"


def pack(records: np.ndarray) -> bytes:
    """Byte planes, field by field: the planes that hold nothing but zeros or slowly growing values shrink in the shuffle's compression."""
    return b"".join(np.ascontiguousarray(records[f]).view(np.uint8).reshape(len(records), -1).T.tobytes() for f in records.dtype.names)


def unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(data) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        size = dtype[f].itemsize
        out[f] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(dtype[f])
        at += n * size
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The upper 32 bits, scaled to 0 ... buckets - 1."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def to_blocks(h: np.ndarray, records: np.ndarray, buckets: int, sorted_already: bool = False, planes: bool = False) -> pa.RecordBatch:
    """One row per bucket with the records (a structured or plain array parallel to h) of that bucket. Planes suit records in an order of
    their own; records that repeat their neighbour's fields shrink more as they are."""
    b = bucket_of(h, buckets)
    if not sorted_already:
        order = np.argsort(b, kind="stable")
        b, records = b[order], records[order]
    edge = np.flatnonzero(np.diff(b)) + 1
    first = np.concatenate([[0], edge]) if len(b) else np.zeros(0, np.int64)
    last = np.concatenate([edge, [len(b)]]) if len(b) else np.zeros(0, np.int64)
    data = [pack(records[x:y]) if planes else records[x:y].tobytes() for x, y in zip(first, last, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(b[first].astype(np.int32) if len(b) else [], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def read_blocks(batches: Iterator[pa.RecordBatch], dtype, planes: bool = False) -> np.ndarray:
    """All records of a task."""
    parts = [unpack(x.as_py(), dtype) if planes else np.frombuffer(x.as_py(), dtype) for b in batches for x in b.column("data")]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def slots_of(h: np.ndarray, slot_bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - slot_bits)).astype(np.int64)


def test_bits(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def collect_bitmap(blocks: DataFrame, buckets: int, slot_bits: int, repeated: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """A bitmap of 2**slot_bits slots (bytes of eight), set for the hashes that `repeated` finds in a bucket's blocks. Tasks send their slots
    as compressed pieces of 4 KB; the whole has a fixed size however many rows there are."""
    piece_bits = 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unique(slots_of(repeated(batches), slot_bits))
        piece = slots >> piece_bits
        edge = np.flatnonzero(np.diff(piece)) + 1
        at, data = [], []
        for part in np.split(slots, edge) if len(slots) else []:
            own = np.zeros(1 << (piece_bits - 3), np.uint8)
            place = part & ((1 << piece_bits) - 1)
            np.bitwise_or.at(own, place >> 3, (1 << (place & 7)).astype(np.uint8))
            at.append(int(part[0]) >> piece_bits)
            data.append(zlib.compress(own.tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    bitmap = np.zeros(1 << (slot_bits - 3), np.uint8)
    size = 1 << (piece_bits - 3)
    for at, data in blocks.repartition(buckets, "bucket").mapInArrow(tidy(run), BLOCK_SCHEMA).toLocalIterator(prefetchPartitions=True):
        bitmap[at * size : (at + 1) * size] |= np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
    return bitmap
