"""Toxicity scoring after noisy-channel deobfuscation.

Each token spans a character lattice: look-alike digits and signs may stand for letters or be dropped, a run of a letter
may stand for one or two; letters set apart by blanks or dots, and tokens longer than words are, may hold several words.
Viterbi finds the letters with the best channel and character-trigram probability, over word boundaries where there may be
several words; these are then cut by the best product of word probabilities. The restored words' prefixes are scored.

Fitting uses every labelled row with crc32(id) mod 5 not 0, and its whole text: the character model from the different
plain words of each text, the weights from document frequencies by label, the calibration from each half of the rows under
the weights of the other half. Labels, language, source and ids are no inputs of a score. The model holds the words of two
texts or more and the features with a weight, so what is broadcast grows with the vocabulary of the labelled texts.

Defined results: null and empty texts get the score of a text without any known prefix; repeated rows get equal scores;
without labels (or with one label only) every score is the labels' smoothed share; an empty table gives an empty result;
other columns are ignored; labels may repeat (the largest one counts) or be null (ignored).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The likelihood ratio that some feature reaches by chance, and the least weight that counts.
CHANCE, LEAST = 20.0, 0.5
#: Tokens above so many characters may hold several words; a piece of them has at most so many letters.
LONG, PIECE = 20, 24
PREFIXES = (4, 5, 6, 7, 8)
_CUTS = tuple(map(slice, PREFIXES))
#: What may stand for which letters; fixed values.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Log probabilities of the channel: a look-alike for a letter, a look-alike dropped, another sign dropped, a run for one or two letters, a digit kept; an unknown word.
SUBSTITUTED, MISSED, DROPPED, REPEATED, KEPT_DIGIT, UNKNOWN = -0.5, -8.0, -0.5, -0.5, -6.0, -4.0
CACHE = 400_000
#: Counts that a task holds before it hands them on.
HELD = 400_000
_SIGNS = "@$!|+(<€£¡*"
_APART = regex.compile(rf"(?<![^\W_])(?:[^\W_{_SIGNS}][ .\-_*]|[{_SIGNS}][ .\-_*]){{2,}}(?:[^\W_]|[{_SIGNS}])(?![^\W_])")
#: Inside of what _APART finds; everything that this excludes stands for no letter.
_INSIDE = re.compile(r"""[ .\-_*](?=[^\s.,;:\-_'"?/#%&)=\]\[][ .\-_*])""")
_EDGE = regex.compile(r"^[^\w]+|[^\w]+$|_+$|^_+")
#: Signs at a token's edges that stand for no letter.
_BARE = regex.compile(rf"^(?:[^\w{_SIGNS}]|_)+|(?:[^\w{_SIGNS}]|_)+$")
_RUN = regex.compile(r"(.)\1{3,}", regex.S)
#: Plain punctuation.
_ENDS = ".,;:?'\"#%&/)=[]{}-_"
_TWICE, _THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")


class _Logs(dict):
    """Trigram -> log probability of its last character; a bounded cache."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, gram: str) -> float:
        m = self.model
        if len(self) >= CACHE:
            self.clear()
        self[gram] = out = math.log((m.tri.get(gram, 0) + m.k) / (m.two.get(gram[:2], 0) + m.k * m.size))
        return out


class _Paths(dict):
    """(core of a token, whether several words) -> the letters of its best path; a bounded cache."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, key: tuple[str, bool]) -> str:
        out = viterbi(key[0], self.model, key[1])
        if len(key[0]) <= 64:
            if len(self) >= CACHE // 4:
                self.clear()
            self[key] = out
        return out


class CharModel:
    """A character trigram model with add-k smoothing, over letters and the word's edges; with the frequent words."""

    def __init__(self, counts: dict[str, int], words: dict[str, int] | None = None, k: float = 0.05):
        self.tri, self.two = counts, Counter()
        for g, c in counts.items():
            self.two[g[:2]] += c
        self.words, self.total = words or {}, math.log(sum(words.values())) if words else 0.0
        self.k, self.size = k, max(30, len({g[2] for g in counts}))

        self.logs, self.paths = _Logs(self), _Paths(self)
        self.places: _Places | None = None

    def log(self, context: str, c: str) -> float:
        return self.logs[context + c]


def _inner(token: str) -> tuple[int, int]:
    """From and to where signs are inside a token; at its edges they may be plain punctuation."""
    left = next((i for i, c in enumerate(token) if c.isalnum()), len(token))
    return left, next((i for i in range(len(token), 0, -1) if token[i - 1].isalnum()), 0)


def _edges(token: str, i: int, left: int, right: int) -> list[tuple[int, str, float]]:
    here, c, run = [], token[i], 1
    while i + run < len(token) and token[i + run] == c:
        run += 1
    if c.isalpha():
        here.append((i + 1, c, 0.0))
        if run > 1:
            here.append((i + run, c, REPEATED))
        if run > 2:
            here.append((i + run, c + c, REPEATED))
    else:
        here.append((i + run, "", MISSED if c in LOOKALIKES and left <= i < right else DROPPED))
        for x in LOOKALIKES.get(c, ""):
            here.append((i + 1, x, SUBSTITUTED))
            if run > 1:
                here.append((i + run, x, SUBSTITUTED + REPEATED))
        if c.isdigit():
            here.append((i + 1, c, KEPT_DIGIT))
    return here


def lattice(token: str) -> list[list[tuple[int, str, float]]]:
    """At each position the edges (next position, letters, log probability of the channel)."""
    inner = _inner(token)
    return [_edges(token, i, *inner) for i in range(len(token))]


def _text(path: tuple | str | None) -> str:
    """The letters of a path: of a short token as they are, else a pair of the path before and its last letters."""
    if isinstance(path, str):
        return path
    out = []
    while path:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


def viterbi(token: str, model: CharModel, several: bool = False) -> str:
    """The letters with the best probability; of equal ones, those that sort first. Several words may follow each other."""
    logs, short = model.logs, len(token) <= 64
    best: list[dict[str, tuple[float, tuple | str | None]]] = [{} for _ in range(len(token) + 1)]
    best[0]["^^"] = (0.0, "" if short else None)
    for i, edges in enumerate(lattice(token)):
        here = best[i]
        if several:
            ends = [(p + logs[c + "$"], out) for c, (p, out) in here.items() if c != "^^"]
            if ends and (end := max(ends, key=lambda x: x[0]))[0] > here.get("^^", (-math.inf,))[0]:
                here["^^"] = end
        for context, (p, out) in here.items():
            second = context[1]
            for j, letters, channel in edges:
                q, ctx = p + channel, context
                if letters:
                    x = letters[0]
                    q += logs[context + x]
                    ctx = second + x
                    if len(letters) > 1:
                        q += logs[ctx + letters[1]]
                        ctx = letters
                there = best[j]
                old = there.get(ctx)
                if old is None or q > old[0] or (q == old[0] and _text(out) + letters < _text(old[1])):
                    there[ctx] = (q, out + letters if short else (out, letters) if letters else out)
        best[i] = {}
    ends = [(p + (0.0 if several and c == "^^" else logs[c + "$"]), _text(out)) for c, (p, out) in best[-1].items()]
    return min(ends, key=lambda x: (-x[0], x[1]))[1] if ends else ""


def segmented(letters: str, model: CharModel) -> list[str]:
    """The words with the best product of probabilities; unknown words have that of their characters."""
    n, logs = len(letters), model.logs
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(n):
        q, ctx = best[i] + UNKNOWN, "^^"
        for j in range(i + 1, min(n, i + PIECE) + 1):
            x = letters[j - 1]
            q += logs[ctx + x]
            ctx = ctx[1] + x
            known = model.words.get(letters[i:j])
            p = q + logs[ctx + "$"] if known is None else best[i] + (math.log(known) - model.total)
            if p > best[j]:
                best[j], back[j] = p, i
    out = []
    while n:
        out.append(letters[back[n] : n])
        n = back[n]
    return out[::-1]


def _plain(token: str) -> bool:
    """Letters only, none three times in a row."""
    return token.isalpha() and not _THRICE.search(token)


def _core(token: str) -> str:
    """A token without plain punctuation at its edges, its long runs cut to three."""
    bare = token.strip(_ENDS)
    if not bare.isalpha():
        bare = _BARE.sub("", token.strip())
    return _RUN.sub(r"\1\1\1", bare) if _THRICE.search(bare) else bare


def _bare(token: str) -> str:
    """What a token is restored to if it is short and, but for plain punctuation at its edges, letters, none beside itself; else ""."""
    return bare if len(token) <= LONG and (bare := token.strip(_ENDS)).isalpha() and not _TWICE.search(bare) else ""


def restored(token: str, model: CharModel) -> list[str]:
    """A lower-cased token's words; only tokens with signs, digits, long runs or several words need the lattice."""
    several = token[0] == " " or len(token) > LONG
    if not several and token.isalpha() and not ((twice := _TWICE.search(token)) and _THRICE.search(token)):
        # two of a kind may be one: if that is a word and this is none, both are scored
        if twice and token not in model.words and (one := _TWICE.sub(r"\1", token)) in model.words:
            return [token, one]
        return [token]
    core = _core(token)
    plain = _plain(core)
    if not any(c.isalpha() for c in core) and not any(c in LOOKALIKES for c in core):
        return []
    word = core if plain else model.paths[core, several]
    # the whole stays a word, as it may be an inflected or a compound one
    return [word, *segmented(word, model)] if several else [word]


def tokens(text: str) -> list[str]:
    """Tokens, and letters set apart joined behind a blank."""
    text = text.lower()
    out = text.split()
    end = 0
    for inside in _INSIDE.finditer(text):
        if end < inside.start() and (m := _APART.match(text, inside.start() - 1)):
            end = m.end()
            if any(c.isalnum() for c in m[0]):
                out.append(" " + m[0][::2])
    return out


def features(words: list[str]) -> list[str]:
    """Prefixes, and the whole words with their end."""
    out = []
    for word in words:
        if len(word) > 2:
            out.append(word + "$")
            out += map(word.__getitem__, _CUTS[: max(0, len(word) + 1 - PREFIXES[0])])
    return out


class _Near(dict):
    """First four characters of a token -> False if, unless it is long, no known feature can come of it; a bounded cache."""

    def __init__(self, heads: set[str]):
        super().__init__()
        self.heads = heads

    def __missing__(self, head: str) -> bool:
        # four letters, none beside itself, begin whatever the token is restored to
        out = head in self.heads or not (head.isalpha() and len(head) == 4 and head[0] != head[1] != head[2] != head[3])
        if len(self) >= CACHE:
            self.clear()
        self[head] = out
        return out


class _Known(dict):
    """What tokens are to some known features; a bounded cache, which leaves out to restore what can't have any."""

    def __init__(self, model: CharModel, known: dict[str, float] | dict[str, int]):
        super().__init__()
        self.model, self.known = model, known
        # the first four characters of every feature, and how these begin
        self.heads = {f[:4] for f in known}
        self.starts = {h[:n] for h in self.heads for n in range(4)}
        self.near = _Near(self.heads)

    def value(self, words: list[str]) -> float | tuple[int, ...]:
        raise NotImplementedError

    def __missing__(self, token: str) -> float | tuple[int, ...]:
        if bare := _bare(token):
            out = (self[bare] if bare != token else self.value([bare])) if (bare + "$")[:4] in self.heads else self.value([])
        else:
            out = self.value(restored(token, self.model) if (self.near[token[:4]] or len(token) > LONG) and self._may(token) else [])
        if len(token) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[token] = out
        return out

    def _may(self, token: str) -> bool:
        """False if no way to restore a token leads to a known feature."""
        heads = self.heads
        if not heads or token[0] == " " or len(token) > LONG:
            return bool(heads)
        if _plain(token):
            return (token + "$")[:4] in heads or (_TWICE.sub(r"\1", token) + "$")[:4] in heads
        core = _core(token)
        if _plain(core):
            return (core + "$")[:4] in heads
        inner, todo, seen = _inner(core), [(0, "")], set()
        while todo:
            i, begun = todo.pop()
            if i == len(core):
                if begun + "$" in heads:
                    return True
                continue
            for j, letters, _ in _edges(core, i, *inner):
                there = j, (begun + letters)[:4]
                if there[1] in heads:
                    return True
                if there[1] in self.starts and there not in seen:
                    seen.add(there)
                    todo.append(there)
        return False


class _Weights(_Known):
    """Token -> the largest weight of its restored word's prefixes."""

    def __init__(self, model: CharModel, weights: dict[str, float]):
        super().__init__(model, weights)
        self.weights = weights

    def value(self, words: list[str]) -> float:
        return max((v for f in features(words) if (v := self.weights.get(f)) is not None), default=0.0) if words else 0.0


class _Places(_Known):
    """Token -> the places of its restored words' features in a list that has, with a feature, all that it begins with."""

    def value(self, words: list[str]) -> tuple[int, ...]:
        out, get = [], self.known.get
        for word in words:
            if len(word) > 2:
                for cut in _CUTS[: max(0, len(word) + 1 - PREFIXES[0])]:
                    if (i := get(word[cut])) is None:
                        break
                    out.append(i)
                else:
                    if (i := get(word + "$")) is not None:
                        out.append(i)
        return tuple(out)


def evidence(text: str, cache: _Weights) -> tuple[float, float, float]:
    """The largest weight, the log of the sum of all words' odds (their smooth maximum), and the log count of weighted words."""
    near = cache.near
    # most tokens begin as no feature does, and need no place in the cache
    found = [w for token in {t for t in tokens(text) if near[t[:4]] or len(t) > LONG} if (w := cache[token])]
    return (max(found, default=0.0), math.log1p(math.fsum(map(math.exp, found))), math.log1p(len(found)))


class _Words(dict):
    """Token -> the plain word that it is, or ""; a bounded cache."""

    def __missing__(self, token: str) -> str:
        w = token if token.isalpha() else _EDGE.sub("", token)
        out = w if w.isalpha() and not _THRICE.search(w) else ""
        if len(self) >= CACHE:
            self.clear()
        self[token] = out
        return out


class _Features(dict):
    """Token -> the features of its restored words; a bounded cache."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> list[str]:
        out = features([bare] if (bare := _bare(token)) else restored(token, self.model))
        if len(token) <= 64:
            if len(self) >= CACHE // 4:
                self.clear()
            self[token] = out
        return out


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each plain word is; partial counts."""
    counts, cache = Counter(), _Words()
    sent = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for text in batch.column(0):
            own = set(map(cache.__getitem__, set((text.as_py() or "").lower().split())))
            own.discard("")
            counts.update(own)
            if len(counts) >= HELD:
                yield sent()
                counts.clear()
    yield sent()


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The character trigrams of counted words; partial counts."""
    counts: Counter = Counter()
    for batch in batches:
        for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = "^^" + w + "$"
            for i in range(len(s) - 2):
                counts[s[i : i + 3]] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model of all labelled rows: character counts, words, weights and calibration."""
    spark = docs.sparkSession
    learn = "id is not null and pmod(crc32(cast(id as string)), 5) <> 0"
    label = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(f"y is not null and {learn}").groupBy("id").agg(F.max("y").alias("y"))
    # the labels' side is hashed part by part: it grows with the documents
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(learn).join(label.hint("shuffle_hash"), "id")
    rows = written(rows.select("text", (F.col("y") > 0).cast("int").alias("y"), F.pmod(F.crc32(F.concat(F.lit("half"), F.col("id").cast("string"))), F.lit(2)).cast("int").alias("half")), "toxic-rows")
    found = written(rows.select("text").mapInArrow(_plain_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "toxic-words")
    of = lambda df: dict(zip(*(c.to_pylist() for c in df.toArrow().columns), strict=True))
    chars = of(found.mapInArrow(_characters, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    # a word of one text only is no evidence that there is such a word
    words = of(found.where("n > 1"))
    sent = spark.sparkContext.broadcast({"chars": chars, "words": words})
    sizes = {(r.half, r.y): r["n"] for r in rows.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Features(_characters_of(sent))
        counts: list[Counter] = [Counter(), Counter()]

        def partial() -> pa.RecordBatch:
            names = list(set().union(*counts))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c.get(f, 0) for f in names], pa.int64()) for c in counts)], names=["f", "t0", "t1"])

        for batch in batches:
            for text, half in zip(*batch.columns, strict=True):
                own: set[str] = set()
                own.update(*map(cache.__getitem__, set(tokens(text.as_py()))))
                counts[half.as_py()].update(own)
                if sum(map(len, counts)) >= HELD:
                    yield partial()
                    for c in counts:
                        c.clear()
        yield partial()

    toxic_n, clean_n = (sum(n for (_, y), n in sizes.items() if y == v) for v in (1, 0))
    total = rows.where("y = 1").select("text", "half").mapInArrow(toxic_features, "f string, t0 long, t1 long").groupBy("f").agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    # no other feature can have a weight, whatever the clean rows say
    table = total.where(F.col("t0") + F.col("t1") >= least_toxic(sizes)).toArrow().to_pandas()
    listed = spark.sparkContext.broadcast({f: i for i, f in enumerate(table["f"])})

    def clean_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places_of(sent, listed)
        counts = np.zeros((2, len(listed.value)), np.int64)
        for batch in batches:
            held: tuple[list[int], list[int]] = [], []
            for text, half in zip(*batch.columns, strict=True):
                own: set[int] = set()
                own.update(*map(places.__getitem__, set(tokens(text.as_py()))))
                held[half.as_py()].extend(own)
            for into, ids in zip(counts, held, strict=True):
                if ids:
                    into += np.bincount(ids, minlength=len(into))
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[at]) for c in counts)], names=["place", "c0", "c1"])

    clean = rows.where("y = 0").select("text", "half").mapInArrow(clean_features, "place long, c0 long, c1 long").groupBy("place").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow().to_pandas()
    listed.unpersist()
    for c in ("c0", "c1"):
        table[c] = np.bincount(clean["place"], clean[c], len(table)).astype(np.int64)
    # no other feature can have a weight in either half
    table = table[(table.t0 + table.t1) * max(1, clean_n) >= 4 * (table.c0 + table.c1) * max(1, toxic_n)]

    def weigh(toxic: np.ndarray, clean: np.ndarray, halves: tuple[int, ...]) -> dict[str, float]:
        w = weight(toxic, clean, *(sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0)))
        keep = w > LEAST
        return dict(zip(table["f"][keep], w[keep].tolist(), strict=True))

    halves = [weigh(table[f"t{h}"].to_numpy(float), table[f"c{h}"].to_numpy(float), (h,)) for h in (0, 1)]
    full = weigh((table.t0 + table.t1).to_numpy(float), (table.c0 + table.c1).to_numpy(float), (0, 1))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _characters_of(sent)
        # a row's weights come from the half that it isn't in
        other = [_Weights(model, halves[1]), _Weights(model, halves[0])]
        for batch in batches:
            x = np.array([evidence(t.as_py(), other[h.as_py()]) for t, h in zip(batch.column(0), batch.column(2), strict=True)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], names=["y", "a", "b", "c"])

    # most rows have no evidence: equal ones are one point
    points = rows.mapInArrow(measured, "y int, a double, b double, c double").groupBy("y", "a", "b", "c").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "a", "b", "c").toArrow().to_pandas()
    sent.unpersist()
    prior = math.log((toxic_n + 0.5) / (clean_n + 0.5))
    return {"chars": chars, "words": words, "weights": full, "line": _logistic(points, prior)}


def weight(toxic: np.ndarray, clean: np.ndarray, nt: int, nc: int) -> np.ndarray:
    """Weights of features in so many toxic and clean rows of nt and nc."""
    w = np.log((toxic + 0.5) / (nt + 1)) - np.log((clean + 0.5) / (nc + 1))
    # shrunk by what chance finds of rare features reach of the likelihood ratio
    n, q = toxic + clean, (nt + 0.5) / (nt + nc + 1)
    ratio = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / np.maximum(n * q, 1e-9)) + clean * np.log(np.maximum(clean, 1e-9) / np.maximum(n * (1 - q), 1e-9)))
    return w * np.maximum(0, 1 - CHANCE / np.maximum(ratio, 1e-9))


def least_toxic(sizes: dict[tuple[int, int], int]) -> float:
    """In how many toxic rows a feature with a weight is at least: three, and as many as reach a likelihood ratio above CHANCE.

    t toxic rows and no clean one reach 2 t log(1 / q), q the toxic share; clean rows lower that, or the feature is no sign.
    """
    shares = [(sum(sizes.get((h, 1), 0) for h in halves) + 0.5) / (sum(sizes.get((h, y), 0) for h in halves for y in (0, 1)) + 1) for halves in ((0,), (1,), (0, 1))]
    return max(3.0, (1 - 1e-9) * CHANCE / (2 * math.log(1 / min(shares))))


def _logistic(points, prior: float, ridge: float = 0.3) -> list[float]:
    """Newton's method with step halving on a ridge-penalised logistic regression of counted points: intercept and one slope a feature."""
    y, n = points["y"].to_numpy(float), points["n"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return [prior, 0.0, 0.0, 0.0]
    x = np.column_stack([np.ones(len(y)), points[["a", "b", "c"]].to_numpy(float)])
    b, centre = np.array([prior, 0.0, 0.0, 0.0]), np.array([prior, 0.0, 0.0, 0.0])
    penalty = np.array([1e-3, ridge, ridge, ridge])
    loss = lambda b: n @ np.logaddexp(0, x @ b) - (n * y) @ (x @ b) + (penalty * (b - centre) ** 2).sum() / 2
    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * (b - centre))
        size = 1.0
        while size > 1e-6 and loss(b + size * step) > now:
            size /= 2
        b = b + size * step
        before, now = now, loss(b)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return b.tolist()


_made: dict[int, tuple] = {}


def _characters_of(sent: Broadcast) -> CharModel:
    """The character model, once a worker."""
    model = sent.value
    if id(model) not in _made:
        _made.clear()
        _made[id(model)] = model, CharModel(model["chars"], model["words"])
    return _made[id(model)][1]


def _places_of(sent: Broadcast, listed: Broadcast) -> _Places:
    """The list's features with their cache, once a worker."""
    model = _characters_of(sent)
    if model.places is None or model.places.known is not listed.value:
        model.places = _Places(model, listed.value)
    return model.places


def _ready(sent: Broadcast) -> tuple[_Weights, np.ndarray]:
    """The model with its cache, once a worker."""
    model = sent.value
    if id(model) not in _made:
        _made.clear()
        _made[id(model)] = model, _Weights(CharModel(model["chars"], model["words"]), model["weights"]), np.array(model["line"])
    return _made[id(model)][1:]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, line = _ready(sent)
        for batch in batches:
            x = np.array([(1.0, *evidence(t or "", cache)) for t in batch.column(1).to_pylist()]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, whose score is under the threshold; map-side."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, line = _ready(sent)
        for batch in batches:
            x = np.array([(1.0, *evidence(t or "", cache)) for t in batch.column(at).to_pylist()]).reshape(-1, 4)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ line, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
