"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

The merge list fixes a sufficient lookahead: appending bytes to a text changes no token that ends so many bytes before
the old end. Merges apply in rank order, so the place from which two runs differ moves left only when a merge (a, b)
with a ending there applies in one run and not in the other; b then starts with the left part of the merge that moved
it before, of a smaller rank. The longest such chain, found in one pass over the merges in rank order, is the bound.
The transducer keeps at most that lookahead and one chunk, emits tokens once they are stable, and goes on with the rest.

All text passes through the transducer in chunks. It cuts pieces by the tokenizer's pattern, whose own lookahead is three
characters; pieces that are complete become tokens at once (short ones from a bounded cache, which changes no result), and
a piece longer than a chunk passes through the byte transducer in parts.

Defined results: a null text counts as empty and has no tokens; repeated rows each get their own row; an empty table
gives an empty result; other columns are ignored; strings of added tokens in a text become those tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of byte-level tokenizers (a fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in a chunk, and pieces in the cache.
CHUNK, CACHE = 1 << 14, 200_000
_RUNS = [regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\s\p{L}\p{N}]+")]
_WHITE = regex.compile(r"\s+")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the file: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Merges:
    """A vocabulary with its merge list; merges are (left id, right id) in rank order."""

    def __init__(self, pieces: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.pieces = pieces
        self.bytes_of = {i: p for p, i in pieces.items()}
        self.base = [pieces[bytes([b])] for b in range(256)]
        self.rank = {(pieces[a] << 32) | pieces[b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [pieces[a + b] for a, b in merges]
        self.lookahead = sufficient_lookahead(merges)

    def encode(self, raw: bytes) -> list[int]:
        """Tokens of one piece, by merges of the least rank first, the leftmost of equal ones first."""
        ids = [self.base[b] for b in raw]
        if len(ids) > 64:
            return self._encode_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        pairs = [rank((a << 32) | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            ids[i : i + 2] = [made[least]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((ids[i - 1] << 32) | ids[i], none)
            if i < len(pairs):
                pairs[i] = rank((ids[i] << 32) | ids[i + 1], none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        nxt, prev, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank((a << 32) | b)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (s := rank((ids[i] << 32) | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[nxt[i]]))
            if prev[i] >= 0 and (s := rank((ids[prev[i]] << 32) | ids[i])) is not None:
                heapq.heappush(heap, (s, prev[i], ids[prev[i]], ids[i]))
        return [t for t in ids if t >= 0]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """So many bytes before a text's end, its tokens stand whatever follows."""
    reach: dict[bytes, int] = {}
    most = 0
    for a, b in merges:
        far = len(a) + max((reach.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0)
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
    return most + max((len(a) + len(b) for a, b in merges), default=1)


class PieceTransducer:
    """Bytes of one piece in, stable tokens out; what is held stays under the lookahead plus a chunk."""

    def __init__(self, merges: Merges, chunk: int = 4096):
        self.merges, self.chunk, self.held = merges, chunk, b""

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(raw), self.chunk):
            self.held += raw[at : at + self.chunk]
            if len(self.held) >= self.merges.lookahead + self.chunk:
                end, stable = 0, len(self.held) - self.merges.lookahead
                for t in self.merges.encode(self.held):
                    if end + len(self.merges.bytes_of[t]) > stable:
                        break
                    end += len(self.merges.bytes_of[t])
                    out.append(t)
                self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.merges.encode(self.held), b""
        return out


class _Cache(dict):
    """Tokens of short pieces; bounded, as it starts anew when full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merges.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Transducer:
    """Text in, stable tokens out; what is held stays under a chunk and the lookaheads of the pattern and the merge list."""

    def __init__(self, bpe: ByteBpe):
        self.get, self.find, self.merges, self.most = bpe.cache.__getitem__, bpe.pattern.findall, bpe.merges, max(bpe.chunk, 4)
        self.held = ""
        self.run: PieceTransducer | None = None  # of the piece that the text is in, if that is longer than a chunk
        self.kind, self.first = _WHITE, 0

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        self.held += text
        while True:
            if self.run is None:
                pieces = self.find(self.held)
                open_ = 0  # characters of the pieces that what follows may change
                while pieces and open_ < 3:
                    open_ += len(pieces.pop())
                out += chain.from_iterable(map(self.get, pieces))
                self.held = self.held[len(self.held) - open_ :] if open_ else ""
                if open_ <= self.most:
                    return out
                self.run = PieceTransducer(self.merges)
                self.kind = _WHITE if self.held[:2].isspace() else next(k for k in _RUNS if k.match(self.held, 1 if self.held[0] == " " else 0))
                self.first = 1 if self.kind is not _WHITE and self.held[0] == " " else 0
            m = self.kind.match(self.held, self.first)
            end = m.end() if m else self.first
            self.first = 0
            over = end < len(self.held)
            # of white space before something else, the last character belongs to what follows
            end -= self.kind is _WHITE
            out += self.run.feed(self.held[:end].encode())
            self.held = self.held[end:]
            if not over:
                return out
            out += self.run.close()
            self.run = None

    def close(self) -> list[int]:
        if self.run is None:
            out = list(chain.from_iterable(map(self.get, self.find(self.held))))
        else:
            out = self.run.feed(self.held.encode()) + self.run.close()
        self.held, self.run = "", None
        return out


class ByteBpe:
    """A byte-level BPE tokenizer from a tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges({raw(p): i for p, i in spec["model"]["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pattern, self.chunk, self.cache = regex.compile(PATTERN), chunk, _Cache(self.merges)
        self.bytes_of = self.merges.bytes_of | {i: c.encode() for c, i in self.added.items()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))

    def stream(self, text: str) -> Iterator[list[int]]:
        """Lists of tokens, as they become stable."""
        if self.split and any(x in text for x in self.added):
            for k, part in enumerate(self.split.split(text)):
                if k % 2:
                    yield [self.added[part]]
                else:
                    yield from self._plain(part)
        else:
            yield from self._plain(text)

    def _plain(self, text: str) -> Iterator[list[int]]:
        out = Transducer(self)
        if len(text) <= self.chunk:
            yield out.feed(text) + out.close()
            return
        for at in range(0, len(text), self.chunk):
            yield out.feed(text[at : at + self.chunk])
        yield out.close()

    def decode(self, ids: Iterator[list[int]]) -> Iterator[str]:
        """Text as soon as its bytes are complete; bytes that form no character become U+FFFD."""
        state, get = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__
        for part in ids:
            yield state.decode(b"".join(map(get, part)))
        yield state.decode(b"", True)


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The tokenizer of a file, once a worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if tokens), ids_sha256, decoded_sha256 of the round trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        names = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            rows: list[list] = [[] for _ in range(4 + tokens)]
            for text in batch.column(1):
                count, all_ids, ids_hash, text_hash = 0, [], hashlib.sha256(), hashlib.sha256()

                def parts(text: str = text.as_py() or "", ids_hash=ids_hash, all_ids=all_ids) -> Iterator[list[int]]:
                    nonlocal count
                    for ids in bpe.stream(text):
                        if ids:
                            ids_hash.update((("," if count else "") + ",".join(map(names.__getitem__, ids))).encode())
                            count += len(ids)
                            if tokens:
                                all_ids += ids
                            yield ids

                for out in bpe.decode(parts()):
                    text_hash.update(out.encode())
                for column, x in zip(rows, (count, ids_hash.hexdigest(), text_hash.hexdigest(), all_ids), strict=False):
                    column.append(x)
            arrays = [batch.column(0).cast(pa.int64()), pa.array(rows[0], pa.int64())]
            arrays += [pa.array(rows[3], pa.list_(pa.int32()))] if tokens else []
            arrays += [pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", *["ids"] * tokens, "ids_sha256", "decoded_sha256"])

    kinds = f"doc_id long, n_tokens long, {'ids array<int>, ' if tokens else ''}ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, kinds)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), tokens=False)
