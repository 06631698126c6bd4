"""Removal of byte strings that repeat across documents, by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `least` bytes that covers it also starts in a document with a smaller id. Every such string
has an anchor, the least of its 24-byte hashes, and equal strings have equal anchors, so strings meet by anchor. Strings
that follow each other with one anchor are its context there. Of the anchors that two documents have, the contexts' bytes
meet, equal ones once a block with the smallest id; their suffixes are sorted and transformed. From the empty string on,
breadth-first backward extension gives the intervals of all strings of length 1, 2, ... as images under the last-to-first
mapping, and so the common prefixes by increasing value; it stops at `least`. The suffixes of one interval then start with
one string of that length, whose smallest document goes back to all who asked.

Documents are packed once into blocks; a block asks which of its anchors are shared, then what the strings behind these
are. A text that a third of the rows have costs a block no more than once. An anchor with more than `hot_at` different
contexts (counted with those of other blocks) would meet in one bucket with them all: its strings are dealt one by one, by
their own hash, and pass through the same expansion. Hashes only deal out; bytes decide.

Defined results: null and empty texts have no bytes and lose none; a null id counts as the largest; rows of one id don't
match each other; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _BASE, _BASE_INV, _BYTE, _power, blocks, drop_table, mix, written
from .packed import ROWS, Asked, Row, Texts, batch, bucket_count, by_block, by_bucket, grouped, key_bytes, keys_of, pack, summed

#: Bytes of an anchor, of contexts that are transformed at once, and of contexts that a block sends at once; contexts above which an anchor's strings are dealt one by one.
ANCHOR, PIECE, SENT, HOT = 24, 1 << 17, 4 << 20, 8192
#: Kinds of rows besides a block's texts: shared anchors, contexts (and above, one for each part that a block sends).
SHARED, CONTEXTS = 1, 2
_LOW = np.uint64(63)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each range, one behind the other."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def anchors(buf: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of `least`-byte strings (within a row) with one anchor: first start, starts, the anchor's hash, and the context's."""
    n, width = len(buf), least - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, n), dtype=np.uint64, out=total[1:])
    m = n - ANCHOR + 1
    inverse = _power(_BASE_INV, n)
    value = mix((total[ANCHOR:] - total[:m]) * inverse[:m])
    # of equal ones the place decides, so that a run has one anchor
    value &= ~_LOW
    value |= np.arange(m, dtype=np.uint64) & _LOW
    low, span = value, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    # strings that cross a row's end don't count
    inside = np.zeros(len(low) + 1, np.int8)
    rows = np.flatnonzero(np.diff(offsets) >= least)
    inside[offsets[rows]] += 1
    inside[offsets[rows + 1] - least + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(start):
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    low = low[start]
    new = np.ones(len(low) + 1, bool)
    new[1:-1] = (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)
    edge = np.flatnonzero(new)
    first, count = start[edge[:-1]], np.diff(edge)
    return first, count, low[edge[:-1]] & ~_LOW, mix((total[first + count - 1 + least] - total[first]) * inverse[first] + count.astype(np.uint64))


class _Block:
    """A block's contexts: row, first byte, strings, anchor's hash, hash of its own, and the document's id (null: the largest)."""

    def __init__(self, row: Row, least: int, buckets: int):
        texts = self.texts = Texts(row)
        self.least, self.buckets = least, buckets
        parts = []
        for i, j in blocks(texts.offsets, 1 << 16):  # pieces that stay in the cache
            at = texts.offsets[i]
            first, *rest = anchors(texts.buf[at : texts.offsets[j]], texts.offsets[i : j + 1] - at, least)
            parts.append((first + at, *rest))
        self.start, self.count, self.anchor, self.own = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.row = np.searchsorted(texts.offsets, self.start, "right") - 1
        self.ids = np.where(texts.null, np.iinfo(np.int64).max, texts.ids)
        self.doc = self.ids[self.row]
        self.asked = Asked(self.anchor, buckets)

    def question(self) -> list[Row]:
        """The anchors; of each, whether two documents here have it, and how many contexts it has (127 for all more)."""
        order = np.argsort(self.asked.where, kind="stable")
        where, doc, own = self.asked.where[order], self.doc[order], self.own[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, int)
        two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(where) else np.zeros(0, bool)
        change = np.ones(len(own), np.int64)
        change[1:] = own[1:] != own[:-1]
        change[first] = 1
        several = np.minimum(np.add.reduceat(change, first), 127) if len(where) else np.zeros(0, np.int64)
        data = (two + 2 * several).astype(np.uint8)
        return list(self.asked.rows(self.texts.number, SHARED, lambda i, j: data[i:j].tobytes()))

    def parts(self, answers: list[Row]) -> Iterator[_Part]:
        """What to ask of the shared anchors, and what is asked, in parts of bounded size."""
        bits = [[np.unpackbits(np.frombuffer(r[k], np.uint8), count=int.from_bytes(r[5], "little")) for r in answers] for k in (3, 4)]
        shared, hot = (np.concatenate(b).astype(bool)[self.asked.where] if b else np.zeros(len(self.asked.where), bool) for b in bits)
        own = np.flatnonzero(shared)
        begin = 0
        size = np.cumsum(np.where(hot[own], self.count[own] * self.least, self.count[own] + self.least - 1))
        while begin < len(own):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SENT, "right")))
            part = own[begin:end]
            begin = end
            whole, single = part[~hot[part]], part[hot[part]]
            of = np.repeat(single, self.count[single])
            start = np.concatenate([self.start[whole], _ranges(self.start[single], self.count[single])])
            count = np.concatenate([self.count[whole], np.ones(len(of), np.int64)])
            key = np.concatenate([self.anchor[whole], self._hashes(start[len(whole) :])])
            yield _Part(self, np.concatenate([whole, of]), start, count, key)

    def _hashes(self, start: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for i in range(0, len(start), 4096):
            out[i : i + 4096] = mix((_BYTE[self.texts.buf[start[i : i + 4096, None] + np.arange(self.least)]] * _power(_BASE, self.least)).sum(axis=1, dtype=np.uint64))
        return out


class _Part:
    """Places of contexts in a block, and the different contexts that they are, in the order in which these are asked."""

    def __init__(self, block: _Block, of: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray):
        size = count + block.least - 1
        data = block.texts.buf[_ranges(start, size)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(data)]).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        at = np.empty(len(distinct), np.int64)  # a place of each
        at[code[::-1]] = np.arange(len(code))[::-1]
        key = key[at]
        bucket = (mix(key) >> np.uint64(20)) % np.uint64(block.buckets)
        order = np.lexsort((key, bucket))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.code, self.start, self.doc, self.row = self.place[code], start, block.doc[of], block.row[of]
        self.count, self.key, self.bucket = count[at][order], key[order], bucket[order].astype(np.int64)
        self.low = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.code, self.doc)
        self.distinct, self.order = distinct, order

    def question(self, number: int, kind: int) -> list[Row]:
        data = self.distinct.take(pa.array(self.order))
        offsets = np.frombuffer(data.buffers()[1], np.int64)[: len(data) + 1]
        raw = memoryview(data.buffers()[2]) if len(data) else b""
        cuts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])).tolist()
        return [(number, kind, int(self.bucket[i]), key_bytes(self.key[i:j]) + self.count[i:j].astype(np.uint8).tobytes(), self.low[i:j].tobytes(), bytes(raw[offsets[i] : offsets[j]])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def covered(self, answers: list[Row], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last byte (and one) of what goes; answers: runs of strings with one smallest document, where there is a smaller one."""
        runs = np.concatenate([np.frombuffer(r[3], np.uint8) for r in answers]).astype(np.int64)
        end = np.concatenate([np.frombuffer(r[4], np.uint8) for r in answers]).astype(np.int64)
        low = np.concatenate([np.frombuffer(r[5], np.int64) for r in answers])
        # no run: the block's own smallest document is it
        none = runs == 0
        at = np.cumsum(np.maximum(runs, 1)) - np.maximum(runs, 1)
        all_end, all_low = (np.empty(int(np.maximum(runs, 1).sum()), np.int64) for _ in range(2))
        told = np.ones(len(all_end), bool)
        told[at[none]] = False
        all_end[told], all_low[told] = end, low
        all_end[~told], all_low[~told] = self.count[none], self.low[none]
        runs = np.maximum(runs, 1)
        begin = np.zeros(len(all_end), np.int64)
        begin[1:] = all_end[:-1]
        begin[at] = 0
        times = runs[self.code]
        place, run = np.repeat(np.arange(len(self.code)), times), _ranges(at[self.code], times)
        gone = all_low[run] < self.doc[place]
        place, run = place[gone], run[gone]
        return self.row[place], self.start[place] + begin[run], self.start[place] + all_end[run] - 1 + least


def _ask(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for row in zip(*(x.to_pylist() for x in piece.columns), strict=True):
                if rows := _Block(row, least, buckets).question():
                    yield batch(rows)

    return run


def _shared(hot_at: int):
    """One bucket's anchors: to each block which of its own two documents have, and which have many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values(row: Row) -> np.ndarray:
            data = np.frombuffer(row[4], np.uint8).astype(np.int64)
            return np.column_stack([np.ones(len(data), np.int64), data & 1, data >> 1])

        for held in grouped(batches, 2):
            keys, sums = summed(held, values)
            shared, hot = (sums[:, 0] > 1) | (sums[:, 1] > 0), sums[:, 2] > hot_at
            for number, kind, bucket, a, _, _ in held:
                at = np.searchsorted(keys, keys_of(a))
                yield batch([(number, kind, bucket, np.packbits(shared[at]).tobytes(), np.packbits(hot[at]).tobytes(), len(at).to_bytes(8, "little"))])

    return run


def _contexts(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, 0):
            for k, part in enumerate(_Block(held[0], least, buckets).parts(held[1:])):
                yield batch(part.question(held[0][0], CONTEXTS + k))

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; text: ints, its separators (values under 0) all different."""
    n = len(text)
    values = text - text.min() + 1
    base, span, key, top = int(values.max()) + 1, 1, values, int(values.max()) + 1
    while top * base < 2**62:  # as many characters as fit a key
        key = key * base
        key[: n - span] += values[span:]
        span, top = span + 1, top * base
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.zeros(n, np.int64)
        np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
        if step[-1] == n - 1 or span >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        span *= 2


def expand(text: np.ndarray, least: int) -> np.ndarray:
    """For each position the number of its interval: equal for suffixes that start with the same `least` characters.

    text ends with a separator, and separators (values under 0) are all different. Interval numbers follow the order of
    the suffixes. Level l holds the intervals of all strings of length l; where the last-to-first mapping puts two
    neighbours of one interval apart, or brings different ones together, a common prefix of length l ends.
    """
    order = suffix_array(text)
    n = len(order)
    before = text[order - 1]  # the transform; the first position's predecessor is the last separator
    # back[j]: the row whose last-to-first image is row j (sixteen bits sort in linear time)
    back = np.argsort(before.astype(np.int16) if before.min() >= -(2**15) else before, kind="stable")
    first = text[order]
    # equal-character rows keep their order under the mapping; a first character of its own bounds each interval
    bound = np.ones(n, bool)
    bound[1:] = first[1:] != first[:-1]
    live = np.arange(1, n)[~bound[1:]]  # rows that still share a prefix with the row above
    for _ in range(1, least):
        interval = np.cumsum(bound)
        ends = live[interval[back[live]] != interval[back[live - 1]]]
        if not len(live):
            break
        bound[ends] = True
        live = live[~bound[live]]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(bound) - 1
    return number


def smallest(contexts: list[bytes], low: np.ndarray, least: int) -> np.ndarray:
    """For every string of every context (in order) the smallest of the documents that have it; low: those of the contexts."""
    length = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    text = np.empty(int((length + 1).sum()), np.int64)
    text[begin + length] = -1 - np.arange(len(contexts))
    where = np.ones(len(text), bool)
    where[begin + length] = False
    text[where] = np.frombuffer(b"".join(contexts), np.uint8)
    many = length - least + 1
    string = expand(text, least)[_ranges(begin, many)]
    of = np.full(int(string.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(of, string, np.repeat(low, many))
    return of[string]


def _answers(least: int):
    """One bucket's contexts, to each block the smallest documents of the strings in its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, 2):
            size = [len(r[3]) // 7 for r in held]
            key = np.concatenate([keys_of(r[3][: 6 * n]) for r, n in zip(held, size, strict=True)])
            count = np.concatenate([np.frombuffer(r[3], np.uint8, n, 6 * n) for r, n in zip(held, size, strict=True)]).astype(np.int64)
            lows = [np.frombuffer(r[4], np.int64) for r in held]
            offsets = np.concatenate([[0], np.cumsum(count + least - 1)])
            coded = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(r[5] for r in held))]).dictionary_encode()
            code, distinct = np.split(coded.indices.to_numpy(), np.cumsum(size)[:-1]), coded.dictionary
            low, key_of = np.full(len(distinct), np.iinfo(np.int64).max), np.empty(len(distinct), np.uint64)
            key_of[coded.indices.to_numpy()] = key
            for c, own in zip(code, lows, strict=True):  # a question has a context once
                low[c] = np.minimum(low[c], own)
            runs, ends, values = _runs(distinct, key_of, low, least)
            at = np.cumsum(runs) - runs
            for (number, kind, bucket, *_), c, own in zip(held, code, lows, strict=True):
                told = np.where((runs[c] == 1) & (values[at[c]] == own), 0, runs[c])
                pick = _ranges(at[c], told)
                yield batch([(number, kind, bucket, told.astype(np.uint8).tobytes(), ends[pick].tobytes(), values[pick].tobytes())])

    return run


def _runs(distinct: pa.Array, key: np.ndarray, low: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context its runs of strings with one smallest document: their number, ends and documents."""
    order = np.argsort(key, kind="stable")
    length = np.diff(np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1])[order]
    change = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
    total = np.concatenate([[0], np.cumsum(length)])
    parts, i = [], 0
    while i < len(change) - 1:  # contexts of one anchor stay together
        j = max(i + 1, int(np.searchsorted(total[change], total[change[i]] + PIECE, "right")) - 1)
        own = order[change[i] : change[j]]
        parts.append(smallest(distinct.take(pa.array(own)).to_pylist(), low[own], least))
        i = j
    of = np.concatenate(parts)
    many = length - least + 1
    first = np.cumsum(many) - many
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    new[first] = True
    edge = np.flatnonzero(new)
    context = np.searchsorted(first, edge, "right") - 1
    stop = np.concatenate([edge[1:], [len(of)]]) - first[context]
    runs = np.empty(len(order), np.int64)
    runs[order] = np.bincount(context, minlength=len(order))
    # from the order of the anchors back to that of the contexts
    by = np.argsort(order[context], kind="stable")
    return runs, stop[by].astype(np.uint8), of[edge][by]


def _kept(least: int, buckets: int):
    """Blocks behind all answers: what is left of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, 0):
            block = _Block(held[0], least, buckets)
            texts, found = block.texts, [tuple(np.zeros(0, np.int64) for _ in range(3))]
            for k, part in enumerate(block.parts([r for r in held if r[1] == SHARED])):
                found.append(part.covered([r for r in held if r[1] == CONTEXTS + k], least))
            row, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(start, kind="stable")
            row, start, stop = row[order], start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
            new = np.ones(len(row) + 1, bool)
            new[1:-1] = (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
            edge = np.flatnonzero(new)
            row, start, stop = row[edge[:-1]], start[edge[:-1]], stop[edge[1:] - 1]
            cut, raw = np.searchsorted(row, np.arange(len(texts.ids) + 1)), memoryview(texts.buf)
            removed, spans, sha, runs = [], [], [], []
            for r, (a, b) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)):
                own = list(zip(start[cut[r] : cut[r + 1]].tolist(), stop[cut[r] : cut[r + 1]].tolist(), strict=True))
                digest, at = hashlib.sha256(), a
                for x, y in own:
                    digest.update(raw[at:x])
                    at = y
                digest.update(raw[at:b])
                removed.append(sum(y - x for x, y in own))
                spans.append(len(own))
                sha.append(digest.hexdigest())
                runs.append([{"start": x - a, "stop": y - a} for x, y in own])
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [pa.array(texts.ids, mask=texts.null), pa.array(np.diff(texts.offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(runs, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def remove_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_at: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte runs that go) of every row; least: 24 to 87 bytes."""
    if not ANCHOR <= least <= ANCHOR + 63:
        raise ValueError("least must be 24 to 87 bytes")
    packed = pack(docs, "repeat-blocks", id_col=id_col, text_col=text_col)
    buckets = bucket_count(packed)
    shared = written(by_bucket(packed.mapInArrow(_ask(least, buckets), ROWS), buckets).mapInArrow(_shared(hot_at), ROWS), "repeat-shared", 128)
    asked = by_bucket(by_block(packed, shared).mapInArrow(_contexts(least, buckets), ROWS), buckets)
    answers = written(asked.mapInArrow(_answers(least), ROWS), "repeat-answers", 128)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    out = written(by_block(packed, shared, answers).mapInArrow(_kept(least, buckets), schema), "repeat-spans")
    for table in (packed, shared, answers):
        drop_table(table)
    return out


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p FROM d)),
low AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN low USING (s) WHERE doc_id > low),
run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r
  FROM (SELECT *, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, -1))::INT AS new FROM hit)),
span AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY ALL),
edge AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM span GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda i:
         substr(h, 2 * coalesce(stops[i], 0) + 1, 2 * (coalesce(starts[i + 1], length(h) // 2) - coalesce(stops[i], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN edge USING (doc_id)
"""
