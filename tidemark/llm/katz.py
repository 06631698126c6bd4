"""Katz backoff language-model scoring.

P(w | h) is the Good-Turing discounted count where the n-gram (h, w) was seen often enough, else alpha(h) P(w | h') with
h' the history less its first word, down to the discounted unigram share; what the unigrams' discounts leave goes to
unknown words, as one type. alpha(h) = (1 - sum of the seen P(w' | h)) / (1 - sum of their P(w' | h')), so every
distribution sums to 1 exactly. A history whose seen followers are all too frequent for a discount counts one occurrence
more, which its other followers share. N-grams below `cutoff` training occurrences back off; at 1, the default, none does.

Documents are packed once into blocks of bounded size, in the shared folder. A block asks for its distinct n-grams of all
orders, pre-aggregated with its training counts; the counting tables are partitioned by the n-gram's hash, and each
partition answers every block. Then, order by order, the block that owns an n-gram sends what it leaves over and its
lower-order probability to the table of histories, partitioned alike, which answers with the backoff weights. Last, each
block evaluates the recursion for all its tokens. No partition is hot, as a frequent n-gram costs one entry a block;
nothing but the discounts goes to all tasks; all counts cover all text. Tables go once nothing reads them any more.

Defined results: null and empty texts have one token, the end; without training texts every token is unknown, with
probability 1; a null id is held out of training only if crc32 of its (null) text is, that is, it is not trained on;
repeated rows each train and get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _STEP, drop_table, mix, words, written
from .packed import ROWS, Asked, Row, Texts, batch, bucket_count, by_block, by_bucket, count_bytes, counts_of, grouped, keys_of, pack, summed

#: The count up to which Good-Turing discounts; the kind of rows with backoff weights, besides that of their order.
DISCOUNTED, WEIGHTS = 5, 100
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


class _Block:
    """A block's tokens, per document its words, then the end; `gram[k]` the hash of a token with k words before it."""

    def __init__(self, row: Row, order: int):
        texts = self.texts = Texts(row)
        h, o, _, _ = words(texts.buf, texts.offsets)
        count = np.diff(o)
        self.offsets = np.concatenate([[0], np.cumsum(count + 1)])
        word = np.full(self.offsets[-1], END)
        self.doc = np.repeat(np.arange(len(count)), count + 1)
        last = np.zeros(len(word), bool)
        last[self.offsets[1:] - 1] = True
        word[~last] = h
        self.train = texts.flag[self.doc]
        self.first = self.offsets[:-1]
        self.gram = [word]
        for _ in range(1, order):
            self.gram.append(mix(self.history(len(self.gram)) * _STEP[0] + word * _STEP[1]))

    def history(self, k: int) -> np.ndarray:
        """The hash of the k words before each token."""
        out = np.empty_like(self.gram[0])
        out[1:] = self.gram[k - 1][:-1]
        out[self.first] = START
        return out


def _ask(order: int, buckets: int):
    """Blocks to their questions: the distinct n-grams of each order with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for row in zip(*(x.to_pylist() for x in piece.columns), strict=True):
                block = _Block(row, order)
                for k, gram in enumerate(block.gram, 1):
                    asked = Asked(gram, buckets)
                    count = np.bincount(asked.where[block.train], minlength=len(asked.keys))
                    rows = list(asked.rows(row[0], k, lambda i, j, c=count: count_bytes(c[i:j])[0], lambda i, j, c=count: count_bytes(c[i:j])[1]))
                    if rows:
                        yield batch(rows)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of the counting table: to each block its counts and which n-grams it owns; also the counts of counts (block -1)."""
    for held in grouped(batches, 2, 1):
        keys, total = summed(held, lambda r: counts_of(r[4], r[5])[:, None])
        total = total[:, 0].astype(np.int64)
        seen = total[total > 0]
        of = np.bincount(np.minimum(seen, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        yield batch([(-1, held[0][1], held[0][2], np.array([*of[1 : DISCOUNTED + 2], len(seen), seen.sum()], np.int64).tobytes(), None, None)])
        free = np.ones(len(keys), bool)
        for number, kind, bucket, a, _, _ in held:
            at = np.searchsorted(keys, keys_of(a))
            small, large = count_bytes(total[at])
            yield batch([(number, kind, bucket, small, np.packbits(free[at]).tobytes(), large)])
            free[at] = False


def discounts(of: list[int], cutoff: int = 1) -> list[float]:
    """Factor d_r of counts r = 0 .. DISCOUNTED + 1 (the last: all larger ones), by Katz's Good-Turing rule.

    of: how many n-grams occur 1, 2, ... times. Where the counts of counts give no factor in (0, 1], absolute
    discounting takes its place. Counts under the cutoff get 0: they back off.
    """
    n = [0, *of]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(0.0 if r < cutoff else d if 0 < d <= 1 else (r - absolute) / r)
    return [*out, 1.0]


class Model:
    """The discounts and totals: all that goes to every task. of: for each order the counts of counts, the types and the total."""

    def __init__(self, of: list[list[int]], cutoff: int = 1):
        uni = of[0]
        self.types, self.total, self.cutoff = uni[-2], uni[-1], cutoff
        self.d = [np.array(discounts(n[:-2], cutoff if k else 1)) for k, n in enumerate(of)]
        n = np.array([0, *uni[: DISCOUNTED + 1]])
        left = ((1 - self.d[0][1 : DISCOUNTED + 1]) * np.arange(1, DISCOUNTED + 1) * n[1 : DISCOUNTED + 1]).sum()
        self.unknown = left / self.total if self.total else 1.0
        self.scale = 1.0
        if self.total and not self.unknown > 0:
            self.unknown = 1 / (self.total + self.types + 1)
            self.scale = 1 - self.unknown

    def p1(self, c: np.ndarray) -> np.ndarray:
        known = self.scale * self.d[0][np.minimum(c, DISCOUNTED + 1)] * c / max(1, self.total)
        return np.where(c > 0, known, self.unknown)

    def seen(self, k: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of n-grams with k words before the last; 0 where they back off."""
        return np.where(c >= self.cutoff, self.d[k][np.minimum(c, DISCOUNTED + 1)] * c, 0.0)


class _Known:
    """A block with the answers that it has so far; everything by token."""

    def __init__(self, held: list[Row], order: int, buckets: int, model: Model):
        of: dict[int, list[Row]] = {}
        for r in held:
            of.setdefault(r[1], []).append(r)
        self.block, self.model, self.rows, self.buckets = _Block(of[0][0], order), model, of, buckets
        asked = [Asked(g, buckets) for g in self.block.gram]
        self.asked, self.count = asked, []
        for k in range(order):
            counts = np.concatenate([counts_of(r[3], r[5]) for r in of[k + 1]])
            self.count.append(counts[asked[k].where])
        self.ends = int(self.count[0][-1])  # the last token is an end; as many starts

    def owned(self, k: int) -> np.ndarray:
        """One token of each n-gram with k words before its last that this block owns."""
        bits = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=len(r[3])) for r in self.rows[k + 1]]).astype(bool)
        token = np.empty(len(bits), np.int64)
        token[self.asked[k].where] = np.arange(len(self.asked[k].where))
        return token[bits]

    def of_history(self, k: int) -> np.ndarray:
        """Training occurrences of the k words before each token: those of the n-gram that they are, as something follows it."""
        out = np.empty(len(self.block.doc), np.int64)
        out[1:] = self.count[k - 1][:-1]
        out[self.block.first] = self.ends
        return out

    def probability(self, k: int) -> np.ndarray:
        """P of each token given the k words before it, by recursion."""
        if not k:
            return self.model.p1(self.count[0])
        weight, before = self.model.seen(k, self.count[k]), self.of_history(k)
        back = np.concatenate([np.frombuffer(r[3], np.float64) for r in self.rows[WEIGHTS + k]])[Asked(self.block.history(k), self.buckets).where]
        n = before + (back < 0)
        alpha = np.where(before > 0, np.where(back < 0, -back, back) / np.maximum(n, 1), 1.0)
        return np.where(weight > 0, weight / np.maximum(n, 1), alpha * self.probability(k - 1))


def _leftovers(k: int, order: int, model: Model, buckets: int):
    """Blocks with their answers, to the table of histories of k words: what owned n-grams leave over, and their lower-order probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, 0):
            known = _Known(held, order, buckets, model)
            own = known.owned(k)
            c = known.count[k][own]
            own, c = own[c > 0], c[c > 0]
            weight = model.seen(k, c)
            asked = Asked(known.block.history(k), buckets)
            at = asked.where[own]
            left = np.bincount(at, c - weight, len(asked.keys))
            lower = np.bincount(at[weight > 0], known.probability(k - 1)[own[weight > 0]], len(asked.keys))
            yield batch(list(asked.rows(held[0][0], WEIGHTS + k, lambda i, j: np.concatenate([left[i:j], lower[i:j]]).tobytes())))

    return run


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of the table of histories: to each block its histories' alpha times their count; negative where nothing is left over."""
    for held in grouped(batches, 2, 1):
        keys, sums = summed(held, lambda r: np.frombuffer(r[4], np.float64).reshape(2, -1).T)
        # a history whose frequent followers leave nothing gets one occurrence more, for all others
        back = np.where(sums[:, 0] > 0, sums[:, 0], -1) / np.maximum(1 - sums[:, 1], 1e-300)
        for number, kind, bucket, a, _, _ in held:
            yield batch([(number, kind, bucket, back[np.searchsorted(keys, keys_of(a))].tobytes(), None, None)])


def _scores(order: int, model: Model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in grouped(batches, 0):
            known = _Known(held, order, buckets, model)
            texts, n = known.block.texts, len(known.block.texts.ids)
            total = lambda x: np.bincount(known.block.doc, x, n)
            c1 = known.count[0]
            base = np.log10((c1 + 1) / (model.total + model.types + 1))
            score = np.log10(known.probability(order - 1))
            columns = [pa.array(texts.ids, mask=texts.null), pa.array(~texts.flag & ~texts.null), pa.array(np.diff(known.block.offsets)), pa.array(total(c1 > 0).astype(np.int64)), pa.array(np.full(n, model.total, np.int64)), pa.array(total(base)), pa.array(total(score))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: str = "pmod(crc32(cast(doc_id as string)), 7) <> 2", cutoff: int = 1, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; train: SQL over doc_id that tells training rows; order: words of the longest n-grams."""
    packed = pack(docs, "katz-blocks", train, id_col, text_col)
    buckets = bucket_count(packed)
    asked = by_bucket(packed.mapInArrow(_ask(order, buckets), ROWS), buckets)
    counted = written(asked.mapInArrow(_answer, ROWS), "katz-counts", 128)
    totals = np.zeros((order, DISCOUNTED + 3), np.int64)
    for row in counted.where("block = -1").select("kind", "a").toLocalIterator():  # eight numbers a bucket and order
        totals[row.kind - 1] += np.frombuffer(row.a, np.int64)
    model = Model(totals.tolist(), cutoff)
    known = [packed, counted.where("block >= 0")]
    for k in range(1, order):
        left = by_block(*known).mapInArrow(_leftovers(k, order, model, buckets), ROWS)
        known.append(written(by_bucket(left, buckets).mapInArrow(_weights, ROWS), "katz-weights", 128))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = written(by_block(*known).mapInArrow(_scores(order, model, buckets), schema), "katz-scores")
    for table in (packed, counted, *known[2:]):
        drop_table(table)
    return scored


def op1_katz_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
