"""What the training-data operators share: shared folders, written tables and columnar text hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that ends a word: space and the bytes 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random 64-bit value a byte, and the odd base of the rolling hash; fixed, so that hashes agree everywhere.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where it is unset, one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder; its lineage ends there, so a lost executor costs no recomputation.

    batch_rows: rows in an Arrow batch meanwhile, for rows that are large.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    # the shuffle files behind the table go with the query that writes it
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        held["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # and what is left of them once the JVM notices that nothing refers to it
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later read needs."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_table(df: DataFrame) -> None:
    """Delete the folder of a table that `written` gave."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows with about `most` bytes each, a row at least: what is held at once stays bounded."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, A-Z lower-cased: 64-bit hashes, n + 1 offsets into them, starts and ends as byte positions.

    Rows are taken in pieces that stay in the processor's cache.
    """
    if len(buf) <= 1 << 18 or len(offsets) <= 2:
        return _words(buf, offsets)
    parts, done = [], 0
    for i, j in blocks(offsets, 1 << 17):
        h, o, a, b = _words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((h, o[1:] + done, a + offsets[i], b + offsets[i]))
        done += len(h)
    h, o, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.concatenate([[0], o]), a, b


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    stop = np.empty(n, bool)
    stop[:-1] = inside[:-1] & (~inside[1:] | first[1:n])
    stop[-1] = inside[-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[buf] * _power(_BASE, n), dtype=np.uint64, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_BASE_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles, in order, and n + 1 offsets; a row of 1 to size - 1 words has one, of them all."""
    count = np.diff(offsets)
    many = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(out_off[-1], np.uint64)
    n = len(hashes)
    if n >= size:
        joined = hashes[: n - size + 1] * _STEP[0]
        for k in range(1, size):
            joined += hashes[k : n - size + 1 + k] * _STEP[k]
        joined = mix(joined + np.uint64(size))
        row = np.repeat(np.arange(len(count)), many)
        at = np.arange(out_off[-1]) - out_off[row] + offsets[row]
        full = count[row] >= size
        out[full] = joined[at[full]]
    for r in np.flatnonzero((count > 0) & (count < size)):
        own = hashes[offsets[r] : offsets[r + 1]]
        out[out_off[r]] = mix((own * _STEP[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, out_off


def row_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and n + 1 offsets."""
    if not len(values):
        return values, np.zeros(len(offsets), np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    parts = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        part = values[a:b].copy()
        part.sort()
        parts.append(part)
    out = np.concatenate(parts)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(offsets) - 1))])


def binary_rows(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
