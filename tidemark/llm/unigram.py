"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's matches by their end; dynamic programming carries only the best score
and the number of pieces, with the unigram tokenizer's tie rule: of equal scores, the match that starts first stays, and
a later one must be strictly better. A character that no one-character piece covers may become unknown, at the least
score of the vocabulary minus 10; with byte fallback it counts as its UTF-8 bytes, else a run of them counts once.

White space is handled as the metaspace rule does: spaces become U+2581, one goes before the text if it doesn't start
with one, and each one starts a new segment. Segments are cut further around characters that occur in no longer piece,
which no match crosses, so the cut is exact; counts of short segments are kept in a bounded cache.

Defined results: null and empty texts have 0 tokens, repeated rows each get a row, an empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY, CACHE = 10.0, 200_000


class UnigramCounter(dict):
    """Segment -> number of tokens; itself the cache."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, unknown_id: int = 0):
        super().__init__()
        self.unknown_piece = pieces[unknown_id][0]
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        have = {p for p, _ in pieces}
        self.fallback = byte_fallback and all(f"<0x{b:02X}>" in have for b in range(256))
        self.scores = dict(pieces)
        self.match = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.match.add_word(p, (len(p), s))
        self.match.make_automaton()
        self.longest = max(len(p) for p in have)
        # only with byte fallback is an unknown character independent of its neighbours
        joined = "".join(sorted({c for p in have if len(p) > 1 for c in p if c != SPACE}))
        inner = f"[{regex.escape(joined, special_only=False, literal_spaces=True)}]" if joined else r"(?!)"
        self.cut = regex.compile(f"{SPACE}?{inner}+|.", regex.S) if self.fallback else regex.compile(f"{SPACE}[^{SPACE}]*|[^{SPACE}]+", regex.S)

    def __missing__(self, segment: str) -> int:
        n = self.count(segment)
        if len(segment) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = n
        return n

    def count(self, s: str) -> int:
        """Pieces on the best path; only the last `longest` positions are held."""
        keep = self.longest + 1
        score, pieces, loose = [0.0] * keep, [0] * keep, [False] * keep
        matches = self.match.iter(s)
        ready: tuple[int, tuple[int, float]] | None = next(matches, None)
        for end in range(1, len(s) + 1):
            best, single = None, False
            while ready is not None and ready[0] == end - 1:
                size, own = ready[1]
                at = (end - size) % keep
                total = own + score[at]
                if best is None or total > best[0]:
                    best = (total, pieces[at] + 1, False)
                single |= size == 1
                ready = next(matches, None)
            if not single:
                at = (end - 1) % keep
                total = self.unknown + score[at]
                if best is None or total > best[0]:
                    best = (total, pieces[at] + (len(s[end - 1].encode()) if self.fallback else not loose[at]), True)
            score[end % keep], pieces[end % keep], loose[end % keep] = best
        return int(pieces[len(s) % keep])

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        if self.unknown_piece in text:
            return sum(self._spelled(x) for x in regex.findall(f"{SPACE}[^{SPACE}]*", text))
        return sum(map(self.__getitem__, self.cut.findall(text)))

    def _spelled(self, s: str) -> int:
        """Pieces where a text spells the unknown piece: it joins a run of unknown characters, and runs are looked up whole."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(s) + 1)]
        for at, (size, own) in self.match.iter(s):
            ends[at + 1].append((size, own))
        score, back = [0.0] * (len(s) + 1), [(0, False)] * (len(s) + 1)
        for end in range(1, len(s) + 1):
            tries = ends[end] if any(size == 1 for size, _ in ends[end]) else [*ends[end], (1, None)]
            best = None
            for size, own in tries:
                total = (self.unknown if own is None else own) + score[end - size]
                if best is None or total > best:
                    best, back[end] = total, (size, own is None or s[end - size : end] == self.unknown_piece)
            score[end] = best
        n, end, run = 0, len(s), ""
        while end or run:
            size, odd = back[end] if end else (0, False)
            if odd:
                run, end = s[end - size : end] + run, end - size
                continue
            if run:
                n += 1 if run in self.scores or not self.fallback else len(run.encode())
                run = ""
            elif end:
                n, end = n + 1, end - size
        return n


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


_loaded: dict[str, UnigramCounter] = {}


def loaded(path: str) -> UnigramCounter:
    if path not in _loaded:
        _loaded[path] = UnigramCounter(sentencepiece_pieces(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_bytes of each whole text under the unigram vocabulary at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([counter.tokens(t) for t in texts], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary_path

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("piece_bpe_32k.model"))
