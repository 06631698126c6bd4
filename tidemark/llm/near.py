"""MinHash near-deduplication with odd sketches.

A document's set of word shingles has a signature; equal sets are one class from there on. Classes are banded by MinHash
(32 bands of 5, so a pair at similarity 0.85 is missed with probability 1e-8), and the set's 1,024 least hashes (its
bottom MinHash samples; all of a smaller set) are folded into a parity bitmap of 2,048 bits: the XOR population count of
two such odd sketches estimates a high similarity precisely, and candidates are dropped whose count is six deviations
above what the threshold allows sets of their sizes. What remains is verified on the full sets.

Links are found without all pairs of a bucket. First each member is compared with its bucket's least member, and the
verified links give components. Then, in buckets that still hold several components, members of different components
are compared, in blocks, so no link between them is lost; members of one component need no further link.

Defined results: null and empty texts have an empty set and are linked with nothing; texts of fewer words than a shingle
have one, of all their words; repeated rows (and ids) each get a row and share their class; null ids never name a
component that has another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, row_sets, shingles, text_buffer, words, written
from .components import components

BANDS, ROWS, BITS, BOTTOM = 32, 5, 2048, 1024
SAMPLES = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(977))
_MUL = (_RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SEED = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
#: Members of a bucket that are compared at once.
BLOCK = 1024


def minhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SAMPLES minima of each row's set (rows without values get zeros)."""
    n = len(offsets) - 1
    out = np.zeros((n, SAMPLES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        x, starts = (values >> np.uint64(32)).astype(np.uint32), offsets[full]
        for k in range(SAMPLES):
            out[full, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    x = mix(samples.astype(np.uint64) + _SEED).reshape(len(samples), BANDS, ROWS)
    return mix(x.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Packed bitmaps of each row's sorted set: the parity of its BOTTOM least values that fall on each of BITS bits."""
    n = len(offsets) - 1
    taken = np.minimum(np.diff(offsets), BOTTOM)
    row = np.repeat(np.arange(n), taken)
    at = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken) + offsets[row]
    bit = (mix(values[at] ^ _SEED[0]) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount(bit + row * BITS, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1)


def likely(n_a: np.ndarray, n_b: np.ndarray, odd: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and this XOR population count may be `percent` similar; false for less than one such pair in 1e8."""
    big, small = np.maximum(n_a, n_b).astype(float), np.minimum(n_a, n_b).astype(float)
    both = percent / (100 + percent) * (big + small)
    some_big, some_small = np.minimum(big, BOTTOM), np.minimum(small, BOTTOM)
    share = np.minimum(1, both / big)
    drawn = np.where(some_big < big, 12 * np.sqrt(some_big * share * (1 - share)), 0)
    differ = some_big + some_small - 2 * some_big * share + drawn
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** differ)
    spread = 6 * np.sqrt(BITS / 4 * (1 - (1 - 4 / BITS) ** differ))
    # folding only loses differences, so the count never passes their number
    return (100 * small >= percent * big) & (odd <= np.minimum(differ, mean + spread) + 1e-6)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """ref, doc_id, n, sig (of the set), bands, sketch of each row; docs: ref, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            for i, j in blocks(off):
                h, o, _, _ = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                values, so = row_sets(*shingles(h, o, size))
                count = np.diff(so)
                samples = minhash(values, so)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)])
                sig = mix(total[so[1:]] - total[so[:-1]] + count.astype(np.uint64)).view(np.int64)
                bands, sketch = band_keys(samples), odd_sketch(values, so)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(count) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(count), pa.array(sig), lists, pa.array([r.tobytes() for r in sketch], pa.binary())], names=["ref", "doc_id", "n", "sig", "bands", "sketch"])

    return docs.select("ref", "doc_id", "text").mapInArrow(run, "ref string, doc_id long, n long, sig long, bands array<long>, sketch binary")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda x: nodes.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), F.col("ref").alias(f"d_{x}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "d_a", "d_b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                odd = np.bitwise_count(_bits(batch.column(6)) ^ _bits(batch.column(7))).sum(axis=1)
                keep = likely(batch.column(4).to_numpy(), batch.column(5).to_numpy(), odd, percent)
                yield batch.select(["a", "b", "d_a", "d_b"]).filter(pa.array(keep))

    return full.mapInArrow(run, "a long, b long, d_a string, d_b string")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. Only texts of classes in a pair are fetched, once."""
    pairs = written(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("sig"), F.col("d_a").alias("ref")).union(pairs.select("b", "d_b")).distinct()
    rows = docs.join(wanted.hint("shuffle_hash"), "ref").select("sig", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose reference only happens to be the same go."""
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for i, j in blocks(off):
                values, so = row_sets(*shingles(*words(buf[off[i] : off[j]], off[i : j + 1] - off[i])[:2], size))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)])
                sig = mix(total[so[1:]] - total[so[:-1]] + np.diff(so).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), batch.column(1).slice(i, j - i)], names=["sig", "text"]).filter(pa.compute.equal(pa.array(sig), batch.column(0).slice(i, j - i)))

    texts = written(rows.mapInArrow(own, "sig long, text string").dropDuplicates(["sig"]), "near-texts")
    joined = pairs.select("a", "b").join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (buf_a, off_a), (buf_b, off_b) = text_buffer(batch.column(2)), text_buffer(batch.column(3))
            for i, j in blocks(off_a + off_b):
                sets = [row_sets(*shingles(*words(buf[off[i] : off[j]], off[i : j + 1] - off[i])[:2], size)) for buf, off in ((buf_a, off_a), (buf_b, off_b))]
                (va, oa), (vb, ob) = sets
                for r in range(j - i):
                    x, y = va[oa[r] : oa[r + 1]], vb[ob[r] : ob[r + 1]]
                    merged = np.concatenate([x, y])
                    merged.sort(kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                    keep[i + r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return written(joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "near-links")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket but different components that sizes and sketches allow; rows: key, sig, n, bands, sketch, ref, component.

    A pair comes from the first of the buckets that it shares.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.join(sizes.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    # each pair of parts of a large bucket is a group of its own
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("*", other).select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "sig", "n", "bands", "sketch", "ref", "component")
    grouped = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            start = 0
            for r in range(1, len(at) + 1):
                if r == len(at) or at[r] != at[start]:
                    piece = batch.slice(start, r - start)
                    if held and held[0][0] != at[start]:
                        yield from pairs_of(held)
                        held = []
                    held.append((at[start], piece))
                    start = r
        if held:
            yield from pairs_of(held)

    def pairs_of(held: list) -> Iterator[pa.RecordBatch]:
        (key, p, q), table = held[0][0], pa.Table.from_batches([x for _, x in held])
        part, sig, n, ids, comp = (np.array(table.column(c).to_pylist()) for c in ("part", "sig", "n", "ref", "component"))
        bits = _bits(table.column("sketch"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sig), -1)
        left = np.flatnonzero(part == p)
        right = np.flatnonzero(part == q)
        out: list[list] = [[], [], [], []]
        for i in left:
            js = right[(comp[right] != comp[i]) & (sig[right] != sig[i]) & ((sig[right] > sig[i]) | (p != q))]
            js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
            js = js[likely(n[js], n[i], np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1), percent)]
            js = js[bands[js, (bands[js] == bands[i]).argmax(axis=1)] == key]
            for j in js:
                x, y = (i, j) if sig[i] < sig[j] else (j, i)
                for column, v in zip(out, (sig[x], sig[y], ids[x], ids[y]), strict=True):
                    column.append(v)
        if out[0]:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in c] if t == pa.string() else c, t) for c, t in zip(out, kinds, strict=True)], names=["a", "b", "d_a", "d_b"])

    return grouped.mapInArrow(run, "a long, b long, d_a string, d_b string").distinct()


def near_dedup(docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text", ref: Column | None = None) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, ref, component, sig. Links are pairs with 100 * intersection >= percent * union.

    ref: a string that tells a row from others (never null), by default from its id and text. component and sig are the
    internal names of the component and of the row's set, for rows with words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ref = F.hex(F.xxhash64(F.col(id_col).cast("long"), text)) if ref is None else ref
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), ref.alias("ref"))
    rows = written(signatures(docs, size), "near-signatures")
    nodes = written(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("ref").alias("ref"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-classes")
    banded = nodes.select("sig", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("sig").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "a")
    members = written(banded.join(shared, "key"), "near-buckets")
    pairs = members.where("a <> sig").select("a", F.col("sig").alias("b")).distinct()
    slim = nodes.drop("bands")
    links = _verified(_filtered(pairs, slim, percent), docs, size, percent)
    first = written(components(links), "near-components")
    placed = members.select("key", "sig").join(first.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = placed.join(mixed, "key", "left_semi").join(nodes, "sig")
    more = _verified(_across(rest, percent), docs, size, percent)
    final = components(links.union(more)) if more.limit(1).count() else first
    return _result(rows, nodes, final)


def _result(rows: DataFrame, nodes: DataFrame, final: DataFrame) -> DataFrame:
    of = nodes.select("sig", "doc_id").join(final.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "component").select("sig", "component", "component_id")
    joined = rows.select("doc_id", "n", "sig", "ref").join(named, "sig", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "ref", F.when(F.col("n") > 0, F.col("component")).alias("component"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ref", "component", "sig")


#: Words as in the contract, and distinct 5-word shingles of a table (documents or benchmark).
SHINGLES = """
{name}_w AS (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {name}),
{name}_s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM {name}_w)
"""
SQL = (
    "WITH RECURSIVE "
    + SHINGLES.format(name="documents", id="doc_id")
    + """,
n AS (SELECT id, count(*) AS n FROM documents_s GROUP BY id),
links AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM documents_s a JOIN documents_s b ON a.s = b.s AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
  GROUP BY a.id, b.id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT w.x, e.y FROM walk w JOIN edges e ON e.x = w.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id JOIN (SELECT x, min(y) AS c FROM walk GROUP BY x) c ON c.x = d.doc_id
"""
)
