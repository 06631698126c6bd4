"""Documents packed into blocks that ask partitioned tables, and what the two send each other.

A block is one row with the compressed texts of some documents. What it wants to know of its keys (n-grams, anchors) it
asks in packed rows, one for each bucket that it has keys of, so there are never more rows than keys, and a frequent key
costs one entry a block. A bucket answers every block in the order of its question. Blocks, questions and answers are
written tables in the shared folder, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, partitions, text_buffer, written

#: Rows between the steps: of a block or for it; what it is (0: its texts, with their KB in bucket); the bucket; data.
ROWS = "block long, kind int, bucket int, a binary, b binary, c binary"
NAMES = ["block", "kind", "bucket", "a", "b", "c"]
#: Bytes of text in a block, text behind a bucket, and keys that are merged at once.
BLOCK, BUCKET, MERGED = 4 << 20, 24 << 20, 1 << 20
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

Row = tuple  # of NAMES


def batch(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=NAMES)


def pack(docs: DataFrame, name: str, flag: str = "false", id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The written blocks of docs. flag: SQL over doc_id, kept as a bit of each document; null counts as false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for piece in batches:
            ids, null, flags = (np.array(piece.column(k).to_pylist()).astype(np.int64) for k in range(3))
            buf, off = text_buffer(piece.column(3))
            for i, j in blocks(off, size):
                head = np.concatenate([ids[i:j], null[i:j] + 2 * flags[i:j], off[i : j + 1] - off[i]])
                raw = np.ascontiguousarray(buf[off[i] : off[j]])
                yield batch([(number, 0, len(raw) >> 10, head.tobytes(), np.int64(len(raw)).tobytes(), pa.compress(raw, "zstd", asbytes=True) if len(raw) else b"")])
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("null"), F.coalesce(F.expr(flag), F.lit(False)).alias("flag"), "text")
    return written(rows.mapInArrow(run, ROWS), name)


def bucket_count(packed: DataFrame) -> int:
    """So many buckets that one stands for a bounded amount of text, whatever the input's size."""
    kb = packed.agg(F.sum(F.col("bucket").cast("long"))).head()[0] or 0
    return max(partitions(packed.sparkSession), -(-kb // (BUCKET >> 10)))


class Texts:
    """A block's documents: ids, null ids, flags, bytes and n + 1 offsets into them."""

    def __init__(self, row: Row):
        head = np.frombuffer(row[3], np.int64)
        n = (len(head) - 1) // 3
        self.number, self.ids, bits, self.offsets = row[0], head[:n], head[n : 2 * n], head[2 * n :]
        self.null, self.flag = (bits & 1).astype(bool), (bits & 2).astype(bool)
        raw = int(np.frombuffer(row[4], np.int64)[0])
        self.buf = np.frombuffer(pa.decompress(row[5], raw, "zstd", asbytes=True), np.uint8) if raw else np.zeros(0, np.uint8)


def grouped(batches: Iterator[pa.RecordBatch], *by: int) -> Iterator[list[Row]]:
    """Consecutive rows with equal values of the columns `by`."""
    held: list[Row] = []
    for piece in batches:
        for row in zip(*(x.to_pylist() for x in piece.columns), strict=True):
            if held and any(row[k] != held[0][k] for k in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def by_block(*tables: DataFrame) -> DataFrame:
    """All rows of a block behind each other: its texts, then what is known of them, by kind and bucket."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    return rows.repartition("block").sortWithinPartitions("block", "kind", "bucket")


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "block")


class Asked:
    """The distinct ones of some 64-bit hashes, by bucket; which of them each hash is."""

    def __init__(self, values: np.ndarray, buckets: int):
        distinct, where = np.unique(values, return_inverse=True)
        bucket = (mix(distinct) >> np.uint64(20)) % np.uint64(buckets)
        bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.where = distinct[order], place[where]
        present = bucket[order]
        self.cuts = np.flatnonzero(np.concatenate([[True], present[1:] != present[:-1], [True]])) if len(present) else np.zeros(1, int)
        self.buckets = present[self.cuts[:-1]].tolist() if len(present) else []

    def rows(self, number: int, kind: int, *data: Callable[[int, int], bytes | None]) -> Iterator[Row]:
        """A question for each bucket: its keys, and what each of `data` gives for their range."""
        for bucket, i, j in zip(self.buckets, self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield (number, kind, bucket, key_bytes(self.keys[i:j]), *(f(i, j) for f in data), *[None] * (2 - len(data)))


def key_bytes(hashes: np.ndarray) -> bytes:
    """Six bytes of each hash; its bucket, which depends on the other two as well, tells the rest."""
    return (hashes >> np.uint64(16)).astype(np.uint32).tobytes() + (hashes >> np.uint64(48)).astype(np.uint16).tobytes()


def keys_of(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32) | np.frombuffer(raw, np.uint32, n)


def count_bytes(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those of 255 and more in full."""
    return np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype(np.int64).tobytes()


def counts_of(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    if large:
        out[out == 255] = np.frombuffer(large, np.int64)
    return out


def summed(rows: list[Row], values: Callable[[Row], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a bucket's questions and the sums of their values (n rows of them), merged piece by piece."""
    keys, sums = np.zeros(0, np.uint64), None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for k, row in enumerate(rows):
        held.append((keys_of(row[3]), values(row)))
        size += len(held[-1][0])
        if size >= max(MERGED, len(keys)) or k == len(rows) - 1:
            parts = [keys, *(x for x, _ in held)]
            data = np.concatenate([v for v in (sums, *(v for _, v in held)) if v is not None])
            keys, where = np.unique(np.concatenate(parts), return_inverse=True)
            sums = np.column_stack([np.bincount(where, data[:, c], len(keys)) for c in range(data.shape[1])])
            held, size = [], 0
    return keys, np.zeros((0, 1)) if sums is None else sums
