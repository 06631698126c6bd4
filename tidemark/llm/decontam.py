"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Benchmark items are short and documents long, so similarity says nothing and containment is asked for: the share of an
item's word shingles that a document holds. Items are partitioned by the size of their set (powers of two). For each
partition an item's MinHash sample is its set's least hashes (all of a small set), and so many of them must be in a
document's set that a true containment falls short with a probability under 1e-8 (never, for a whole set). What is
found is verified on the full sets in the same task.

The items go to the executors in blocks of bounded size, `PASS` of them broadcast at once, so what is broadcast at a time
doesn't grow with the benchmark; they are a stated query set against all documents, which are read map-side only, in whole
texts, without a shuffle, once for every `PASS` blocks (64 MB of items).

Defined results: null and empty texts hold nothing and are contained nowhere; an item of fewer words than a shingle is
contained where all its words follow each other; repeated items or documents each give their rows; a null id is
reported as null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, row_sets, shingles, text_buffer, words, written
from .near import SHINGLES

#: Bytes of item texts in a block, least hashes in a sample, and deviations left for a sample to fall short.
BLOCK_BYTES, SAMPLE, DEVIATIONS = 8 << 20, 32, 6.0
#: Blocks that one pass over the documents searches for.
PASS = 8
_FILTER = 1 << 20


class Block:
    """A bounded block of items: sets, samples and how many sample hits make a candidate."""

    def __init__(self, ids: list, texts: list[str], threshold: float, size: int):
        buf, off = text_buffer(pa.array(texts, pa.large_string()))
        h, o, _, _ = words(buf, off)
        values, so = row_sets(*shingles(h, o, size))
        count = np.diff(so)
        self.ids, self.threshold, self.size = ids, threshold, size
        self.sets = [values[a:b] for a, b in zip(so[:-1], so[1:], strict=True)]
        #: word counts under a shingle that occur: their items are whole sequences
        self.short = sorted({int(n) for n in np.diff(o) if 0 < n < size})
        partition = np.ceil(np.log2(np.maximum(count, 1))).astype(int)
        self.cut = np.zeros(len(ids), np.int64)
        hashes, owners = [], []
        for p in np.unique(partition):
            members = np.flatnonzero((partition == p) & (count > 0))
            k = min(SAMPLE, 2**p)
            for i in members:
                own = self.sets[i][:k]
                whole = len(own) == count[i]
                spread = DEVIATIONS * (k * threshold * (1 - threshold)) ** 0.5
                self.cut[i] = max(1, int(np.ceil(threshold * len(own) - 1e-9)) if whole else int(len(own) * threshold - spread))
                hashes.append(own)
                owners.append(np.full(len(own), i))
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.zeros(0, int)
        self.hashes = np.concatenate(hashes)[order] if hashes else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, int)
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[self.hashes & np.uint64(_FILTER - 1)] = True

    def search(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, size of its set, shared) for a document's distinct shingles."""
        hit = own[self.maybe[own & np.uint64(_FILTER - 1)]]
        if not len(hit):
            return []
        lo, hi = np.searchsorted(self.hashes, hit), np.searchsorted(self.hashes, hit, "right")
        found = np.concatenate([self.owners[a:b] for a, b in zip(lo, hi, strict=True)])
        out = []
        for i in np.flatnonzero(np.bincount(found, minlength=len(self.ids)) >= np.maximum(self.cut, 1)):
            item = self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            both = int((own[at] == item).sum())
            if both >= self.threshold * len(item) - 1e-9:
                out.append((int(i), len(item), both))
        return out


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles (the item's), n_shared, containment of each pair at or above the threshold."""
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for sent in _passes(docs.sparkSession, items, threshold, size, item_id, item_text, block_bytes):
        found = rows.mapInArrow(_searcher(sent), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _passes(spark: SparkSession, items: DataFrame, threshold: float, size: int, item_id: str, item_text: str, block_bytes: int) -> Iterator[Broadcast]:
    """Broadcasts of up to PASS blocks of items each."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    n_blocks = -(-total // block_bytes)
    if n_blocks > 1:
        # a hash deals the items evenly, so a block stays near block_bytes; sorted by block, a read of one skips the others' row groups
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
        items = written(dealt.repartition(n_blocks, "block").sortWithinPartitions("block"), "contained-items")
    for k in range(0, n_blocks, PASS):
        held = []
        for b in range(k, min(n_blocks, k + PASS)):
            own = (items.where(F.col("block") == b) if n_blocks > 1 else items).orderBy("item_id", "text").select("item_id", "text").toPandas()
            held.append(Block([None if x != x else int(x) for x in own["item_id"].tolist()], own["text"].tolist(), threshold, size))
        yield spark.sparkContext.broadcast(held)


def without(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, all columns, that contain no item; map-side."""
    at = docs.columns.index(text_col)
    for sent in _passes(docs.sparkSession, items, threshold, size, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for block in sent.value:
                    clean &= np.array([not found for found in _found(block, batch.column(at))], bool)
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _found(block: Block, texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """What of a block each text contains."""
    buf, off = text_buffer(texts)
    for i, j in blocks(off):
        h, o, _, _ = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        parts = [row_sets(*shingles(h, o, block.size)), *(row_sets(*shingles(h, o, n)) for n in block.short)]
        for r in range(j - i):
            yield block.search(np.unique(np.concatenate([v[so[r] : so[r + 1]] for v, so in parts])))


def _searcher(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(doc, block.ids[x], n, both, both / n) for block in sent.value for doc, own in zip(ids, _found(block, batch.column(1)), strict=True) for x, n, both in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k > 1 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*found, strict=True))], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return run


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = (
    "WITH "
    + SHINGLES.format(name="documents", id="doc_id")
    + ","
    + SHINGLES.format(name="benchmark", id="item_id")
    + """,
n AS (SELECT id, count(*) AS n FROM benchmark_s GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_shingles, count(*) AS n_shared, count(*) / n.n::DOUBLE AS containment
FROM documents_s d JOIN benchmark_s b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING count(*) >= 0.8 * n.n
"""
)
