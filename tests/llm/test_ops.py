"""The training-data operators against brute force, libraries and SQL, with the edge cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import canonical
from tidemark.llm import bpe, chat, components, decontam, exact, katz, near, pii, queries, suffix, toxicity, unigram

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Nulls, empty and long texts, ties and repeated rows, non-ASCII, control strings.
LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit " * 400
ROWS = [
    (1, None), (2, ""), (3, ""), (4, "a b c"), (5, "A b c"), (6, "one two three four five six seven eight nine ten"), (7, "one two three four five six seven eight nine ten"),
    (7, "one two three four five six seven eight nine ten"), (8, LONG), (9, LONG + "tail"), (10, "é" * 5000), (11, "x" * 9000), (12, " \t\n "), (None, "a b c"), (13, "<|endoftext|> <|im_end|> \\ 日本 😀 '"),
    (14, "one two three four five six seven eight nine ten eleven"), (15, "\x00\x01 null bytes"),
]
KIND = "doc_id long, text string, value long, text_sha256 string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    """The tricky rows, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 5, "clash", 1) for i, t in ROWS], KIND).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def shingles(text: str | None, size: int = 5) -> set:
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, sf, oracle, name):
    got, want = canonical(queries.QUERIES[name](spark, sf).toPandas()), canonical(oracle(queries.SQL[name]))
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


# --- 1 ------------------------------------------------------------------------------------------------------------
def good_turing(of: Counter, cutoff: int) -> dict[int, float]:
    """Katz's discounted counts r* of r = 1 .. 5, from the counts of counts; where they give none in (0, r], absolute ones."""
    n = {r: of[r] for r in range(1, 7)}
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    tail = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        d = (star / r - tail) / (1 - tail) if tail < 1 and n[r] else 0.0
        out[r] = 0.0 if r < cutoff else r * d if 0 < d <= 1 else r - plain
    return out


def katz_brute(rows, train, cutoff, order):
    """Scores by the definition, with an estimator of its own; checks that distributions sum to 1."""
    tok = [(i, WORD.findall((t or "").translate(LOW)) + [None]) for i, t in rows]
    count = [Counter() for _ in range(order)]
    grams = lambda w, at, k: (*(["<s>"] if at < k else []), *w[max(0, at - k) : at + 1])
    for i, w in tok:
        if train(i):
            for k in range(order):
                count[k].update(grams(w, at, k) for at in range(len(w)))
    star = [good_turing(Counter(c.values()), cutoff if k else 1) for k, c in enumerate(count)]
    held = lambda k, c: 0.0 if k and c < cutoff else star[k].get(c, float(c))
    total = sum(count[0].values())
    free = sum(c - held(0, c) for c in count[0].values())
    unknown = free / total if total else 1.0
    scale = 1.0
    if total and not unknown:
        unknown = 1 / (total + len(count[0]) + 1)
        scale = 1 - unknown
    p1 = {g[0]: scale * held(0, c) / total for g, c in count[0].items()}
    assert not total or sum(p1.values()) + unknown == pytest.approx(1)
    followers: dict = {}
    for k in range(1, order):
        for g, c in count[k].items():
            followers.setdefault((k, g[:-1]), {})[g[-1]] = c
    known: dict = {}

    def p(k, h, w):
        if not k:
            return p1.get(w, unknown)
        shorter = h[1:] if k > 1 and len(h) == k else h if k > 1 and h[:1] == ("<s>",) else ()
        seen = followers.get((k, h))
        if seen is None:
            return p(k - 1, shorter, w)
        if (k, h) not in known:
            n = sum(seen.values())
            mass = sum(held(k, c) for c in seen.values())
            n += mass == n
            lower = sum(p(k - 1, shorter, x) for x, c in seen.items() if held(k, c))
            known[k, h] = n, (1 - mass / n) / (1 - lower)
        n, alpha = known[k, h]
        mine = held(k, seen.get(w, 0))
        return mine / n if mine else alpha * p(k - 1, shorter, w)

    for k in range(1, order):
        for _, h in list(followers)[:40]:
            if (k, h) in followers:
                assert sum(p(k, h, w) for w in p1) + known[k, h][1] * p(k - 1, h[1:] if len(h) == k > 1 else h if k > 1 else (), "no word") == pytest.approx(1)
    return [(i, len(w), sum(x in p1 for x in w), sum(math.log10((count[0][x,] + 1) / (total + len(p1) + 1)) for x in w), sum(math.log10(p(order - 1, grams(w, at, order - 1)[:-1], x)) for at, x in enumerate(w))) for i, w in tok]


@pytest.mark.parametrize(("order", "cutoff"), [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1)])
def test_katz_is_brute_force(spark, order, cutoff):
    rnd = random.Random(1)
    rows = [*ROWS, *((100 + k, " ".join(rnd.choice("the a of cat dog sat on mat".split()) for _ in range(rnd.randint(0, 30)))) for k in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    trained = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    got = katz.score_texts(df, cutoff=cutoff, order=order).toPandas()
    want = katz_brute(rows, trained, cutoff, order)
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    have = sorted(((None if i != i else int(i), n, k, b, s) for i, n, k, b, s in zip(got.doc_id, got.n_tokens, got.n_known, got.base_score, got.score, strict=True)), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a == pytest.approx(b)


def test_katz_of_nothing_and_without_training(spark, docs, empty):
    assert katz.score_texts(empty).count() == 0
    assert katz.score_texts(docs, train="false").where("score <> 0").count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------
def test_surrogates_keep_type_format_and_identity(spark, docs, empty):
    texts = ["Mail Anna.B@x.org and anna.b@X.org", "+1 (017) 555-7713, 4111-1111-1111-1111, 4111 1111 1111 1111", "Mrs. Anna Schmidt, Mr Schmidt, г-н Иванов", "10.0.0.1 10.0.0.2 10.0.0.1", "no 4111111111111112 here", None, ""]
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    a, b = re.findall(r"\S+@\S+", rows[0].text)
    assert a.lower() == b.lower() and "anna" not in a.lower() and a.endswith(".org") and a[0].isupper()
    cards = [re.sub(r"\D", "", e.surrogate) for e in rows[1].entities if e.type == "card"]
    digits = [int(c) for c in reversed(cards[0])]
    assert cards[0] == cards[1] and cards[0][0] == "4" and sum(d if k % 2 == 0 else (2 * d - 9 * (2 * d > 9)) for k, d in enumerate(digits)) % 10 == 0
    assert re.match(r"\+1 \(\d{3}\) \d{3}-\d{4},", rows[1].text)
    names = [e.surrogate for e in rows[2].entities]
    assert names[0].split()[1] in pii.GIVEN["latin", "f"].split() and re.search("[а-я]", names[2]) and "Schmidt" not in rows[2].text
    ips = rows[3].text.split()
    assert ips[0] == ips[2] != ips[1] and all(0 < int(o) < 256 for o in ips[0].split("."))
    assert rows[4].text == texts[4] and rows[5].text is None and rows[6].text == ""
    assert pii.replace_entities(docs).count() == len(ROWS) and pii.replace_entities(empty).count() == 0


def test_surrogate_collisions_are_resolved(spark, monkeypatch):
    """With one surrogate for all first attempts, distinct entities still end distinct."""
    whole = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda t, n, a, key: f"(CASE WHEN {a} = 0 THEN '1.1.1.1' ELSE {whole(t, n, a, key)} END)")
    rows = [(k, f"see 10.0.0.{k} and 10.0.0.{k}") for k in range(1, 6)]
    out = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [re.findall(r"\d+\.\d+\.\d+\.\d+", r.text) for r in out]
    assert len({x[0] for x in found}) == 5 and all(x[0] == x[1] for x in found)


def test_surrogates_leave_no_spelling_in_clear(spark):
    """Upper-case secrets, cards beside other digits, names without their title."""
    secret, card = "9233A8EC" * 5, "4111111111111111"
    texts = [
        f"TOKEN = \"{secret}\" and {secret.lower()}", f"{card} 123", "123 4111 1111 1111 1111", f"{card} 123-45-6789", f"{card} 10.0.0.1", "12 3456 4111 1111 1111 1111 99", f"{card} 5500000000000004",
        "Mrs Anna Schmidt came. Later Anna Schmidt left; Schmidt's hat, Dr. Anna Schmidt, Mrs. Schmidt and ANNA\nSCHMIDT.", "Schmidt is no name here, 1 2 3 4 5 6 7 8 9 10 11 12 13 14", "9" * 30000 + " 1" * 30000,
    ]
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    upper, lower = re.findall(r"[0-9A-Fa-f]{40}", rows[0].text)
    assert upper == lower.upper() != secret and rows[0].n_entities == 2
    for k in range(1, 7):
        assert "4111" not in rows[k].text and [e.type for e in rows[k].entities if e.type == "card"], rows[k]
    one = [[e.surrogate for e in rows[k].entities][0] for k in (1, 3, 4, 6)]
    assert len(set(one)) == 1 and rows[1].text == one[0] + " 123" and rows[2].text.startswith("123 4")
    assert re.sub(r"\D", "", rows[2].text[4:]) == one[0] and rows[5].text.startswith("12 3456 4") and rows[5].text.endswith(" 99")
    assert [e.type for e in rows[3].entities] == ["card", "ssn"] and [e.type for e in rows[4].entities] == ["card", "ip"] and [e.type for e in rows[6].entities] == ["card", "card"]
    given, family = rows[7].entities[0].surrogate.split()[1:]
    assert rows[7].text == f"Mrs {given} {family} came. Later {given} {family} left; {family}'s hat, Dr. {given} {family}, Mrs. {family} and {given.upper()}\n{family.upper()}."
    assert given in pii.GIVEN["latin", "f"].split() and rows[7].n_entities == 6
    assert rows[8].text == texts[8] and rows[9].text == texts[9]


def test_surrogates_of_one_person_agree_and_ibans_are_valid(spark):
    """Titles don't split a person, a gender's title does; other people of the name keep theirs; formats that are used up end."""
    texts = ["Mr John Smith met Mr Smith and Dr Smith", "Mr John Smith and Mrs Mary Smith; John Smith left", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "x" * 200000 + "1 " + "y" * 100000 + "@"]
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="secret").orderBy("doc_id").collect()
    a, b, c = (e.surrogate.split()[-1] for e in rows[0].entities)
    assert a == b == c != "Smith" and rows[1].text.split()[2] == a and rows[1].text.split()[-2] == a and rows[1].text.split()[6].rstrip(";") != a
    for e in rows[2].entities:
        s = e.surrogate.replace(" ", "")
        assert e.type == "iban" and int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1
    assert rows[2].text[:2] == "DE" and rows[2].text[4] == " " and rows[3].text == texts[3]
    other = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="other").orderBy("doc_id").collect()
    assert other[0].text != rows[0].text
    full = spark.createDataFrame([("email", f"{x}@a.io") for x in "abcdefghijklmnopqrstuvwxyz"], "t string, n string")
    assert pii.exceptions(full, "k", most=3).count() <= 26


def test_a_surrogate_name_is_no_name_of_the_corpus(spark):
    of = lambda n: spark.range(1).selectExpr(pii.surrogate("'name'", f"'{n}'", "0", "k") + " AS s").first().s
    other = "n|" + of("f|anna schmidt").split()[1].lower()
    odd = pii.exceptions(spark.createDataFrame([("name", "f|anna schmidt"), ("name", other)], "t string, n string"), "k").collect()
    assert "f|anna schmidt" in {r.n for r in odd}


def test_pii_plan_stays_small():
    """The driver parses and plans what it is given: a surrogate is spelled out once, its hashes too."""
    first = pii.surrogate("e.t", "e.n", "0", "k")
    whole = pii.replacements(first)
    assert first.count("sha2(") == 8 and whole.count("sha2(") == 8 and len(whole) < 20_000


# --- 3 and 7 ------------------------------------------------------------------------------------------------------
ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'re", "1", "é", "日", "😀", "!", "tion", "the", "<|endoftext|>", "\t", "<unk>", "<s>", "▁", "..."]


def random_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_bpe_is_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, small = Tokenizer.from_file(path), bpe.ByteBpe(path, chunk=16)
    for text in [*random_texts(800, 1), "a" * 5000, " " * 3000 + "x", "\n" * 3000 + "b", "the" * 2000 + "1" * 300 + "!?" * 900]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert small.encode(text) == ids
        assert "".join(small.decode([ids])) == library.decode(ids, skip_special_tokens=False)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, path).collect()}
    want = set()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and bpe.encode_texts(empty, path).count() == 0


def test_lookahead_is_sufficient():
    merges = bpe.loaded(bpe.vocabulary_path()).merges
    rnd = random.Random(2)
    for _ in range(30):
        text = "".join(rnd.choice("abethison") for _ in range(merges.lookahead + 100)).encode()
        short, long_ = merges.encode(text), merges.encode(text + b"thesession")
        end = 0
        for a, b in zip(short, long_, strict=False):
            end += len(merges.bytes_of[a])
            if end > len(text) - merges.lookahead:
                break
            assert a == b
    stream = bpe.PieceTransducer(merges, chunk=64)
    text = b"antidisestablishmentarianism" * 200
    out = stream.feed(text)
    assert len(stream.held) < merges.lookahead + 2 * 64 and out + stream.close() == merges.encode(text)


def test_tokens_come_before_a_text_ends():
    """Whatever is fed, all but the last pieces are out at once, and little is held."""
    b = bpe.ByteBpe(bpe.vocabulary_path(), chunk=32)
    for text, most in (("the cat sat on the mat and went home again " * 3, 3), ("a" * 9000 + " b", 4096), (" " * 9000 + "\n" * 900 + "x", 4096), ("!?" * 6000, 4096)):
        out, whole, held, got = bpe.Transducer(b), b.encode(text), 0, []
        for c in text:
            got += out.feed(c)
            held = max(held, len(out.held) + len(out.run.held if out.run else b""))
        late = out.close()
        assert got + late == whole and len(got) > 0 and len(late) <= most and held <= b.chunk + b.merges.lookahead + 4096
    assert bpe.Transducer(b).feed("one two three") == b.encode("one two")


def test_decoder_replaces_broken_bytes():
    b = bpe.loaded(bpe.vocabulary_path())
    ids = b.encode("日")
    assert "".join(b.decode([ids[:1]])) == "�" and "".join(b.decode([[i] for i in ids])) == "日"


def test_unigram_counts_are_the_library(spark, docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = bpe.vocabulary_path("piece_bpe_32k.model")
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.0), ("aba", -3.5), ("▁", -1.0), ("▁a", -2.0)]
    for pieces, fallback in ((unigram.sentencepiece_pieces(path), True), (small, False)):
        library = Tokenizer(models.Unigram(pieces, 0, fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = unigram.UnigramCounter(pieces, fallback)
        for text in [*random_texts(600, 3), "aba" * 300, "abba xyz ab" * 20]:
            assert counter.tokens(text) == len(library.encode(text, add_special_tokens=False).ids), text
    assert unigram.count_tokens(docs, path).where("n_tokens = 0").count() == 3 and unigram.count_tokens(empty, path).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------
def test_toxicity_learns_and_deobfuscates(spark, docs, empty):
    rnd = random.Random(5)
    clean = "the cat sat on mat and the dog ran over hills while birds sing softly".split()
    bad = ["stupid", "idiot", "moron"]
    rows, labels = [], []
    for k in range(400):
        words, y = [rnd.choice(clean) for _ in range(30)], int(k % 4 == 0)
        if y:
            words[rnd.randrange(30)] = rnd.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    held = {r.doc_id: r.score for r in toxicity.score(df, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([(held[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.97
    tricky = spark.createDataFrame([(1, "the 1d10t sat"), (2, "you st*pid cat"), (3, "i d i o t birds"), (4, "m0r0oon dog"), (5, "the cat sat"), (6, None), (7, "")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(tricky, model).collect()}
    assert min(scores[k] for k in (1, 2, 3, 4)) > 0.5 > max(scores[k] for k in (5, 6, 7))
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, lab.where("false"))
    assert toxicity.score(docs, none).where("score between 0 and 1").count() == len(ROWS)
    assert toxicity.accepted(docs, none).columns == docs.columns


def test_toxicity_decodes_spacing_edges_and_long_tokens(spark):
    rnd = random.Random(6)
    clean = "the cat sat on mat and a dog ran over hills while you are an owl such as birds sing softly".split()
    bad = ["stupid", "idiot", "moron"]
    rows, labels = [], []
    for k in range(400):
        words, y = [rnd.choice(clean) for _ in range(30)], int(k % 4 == 0)
        if y:
            words[rnd.randrange(30)] = rnd.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, y))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic = ["such a s t u p i d cat", "y o u a r e a n i d i o t", "the !diot sat", "a (|d|ot) sat", "the i d ! o t ran", "you are " + "s" * 50 + "tup" + "i" * 50 + "d", "thecatsatonthematandthedogranoverhillswhileyouareanidiotandbirdssingsoftly", "1d107", "stupid!", "you stuupiid cat"]
    fine = ["such a c a t", "y o u a r e a n o w l", "the cat! sat (on) mat", "t" * 100, "thecatsatonthematandthedogranoverhillswhilebirdssingsoftlyandyouareanowl", "1999", "a b", "! ! !", "x 1 " * 5000]
    chars = toxicity.CharModel(model["chars"], model["words"])
    assert toxicity.segmented("astupid", chars) == ["a", "stupid"] and toxicity.segmented("youareanidiot", chars) == "you are an idiot".split()
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(toxic + fine)), "doc_id long, text string"), model).collect()}
    wrong = [t[:80] for k, t in enumerate(toxic + fine) if (got[k] > 0.5) != (k < len(toxic))]
    assert not wrong


def test_viterbi_is_the_best_path_of_the_lattice():
    """Against all paths, on short tokens; equal probabilities are told apart by the letters."""
    rnd = random.Random(8)
    words = "stupid idiot cat sat mat noon seen too bee".split()
    grams: Counter = Counter()
    for w in words:
        s = "^^" + w + "$"
        grams.update(s[i : i + 3] for i in range(len(s) - 2))
    model = toxicity.CharModel(dict(grams), dict.fromkeys(words, 2))
    for _ in range(150):
        token = "".join(rnd.choice("ato0135s$!*-.iide") for _ in range(rnd.randint(1, 7)))
        edges, paths = toxicity.lattice(token), []

        def walk(i, letters, p, edges=edges, paths=paths):
            if i == len(edges):
                paths.append((letters, p))
                return
            for j, x, q in edges[i]:
                walk(j, letters + x, p + q)

        walk(0, "", 0.0)
        def score(letters, p):
            s = "^^" + letters + "$"
            return p + sum(model.log(s[i : i + 2], s[i + 2]) for i in range(len(s) - 2))

        scored = sorted(((round(score(x, p), 9), x) for x, p in paths), key=lambda r: (-r[0], r[1]))
        assert toxicity.viterbi(token, model) == scored[0][1]


def test_toxicity_learns_from_every_labelled_row(spark):
    """Counts are those of all training rows, of tables larger than any sample; the calibration has seen them all."""
    n = 30_000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('the cat sat', if(id % 10 = 0, ' stupid', ''), if(id % 3000 = 7, ' rareword', '')) AS text")
    model = toxicity.fit(df, spark.range(n).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS toxic"))
    learnt = [k for k in range(n) if zlib.crc32(str(k).encode()) % 5]
    assert len(learnt) > 20_000 and model["words"]["cat"] == len(learnt) and model["words"]["stupid"] == sum(k % 10 == 0 for k in learnt)
    assert model["words"]["rareword"] == sum(k % 3000 == 7 for k in learnt) and model["chars"]["^^c"] == len(learnt)
    points = pd.DataFrame({"y": [0, 1, 0, 1], "a": [0.0, 2.0, 2.0, 0.0], "b": [0.0] * 4, "c": [0.0] * 4, "n": [900, 80, 3, 5]})
    apart = points.loc[points.index.repeat(points["n"])].assign(n=1)
    assert np.allclose(toxicity._logistic(points, -2.0), toxicity._logistic(apart, -2.0))


def test_toxicity_passes_over_no_weight_and_no_spaced_word():
    """What is looked up only after a cheap test: the same weights and tokens as without it."""
    rnd = random.Random(9)
    words = "stupid idiot cat sat mat noon seen too bee".split()
    grams: Counter = Counter()
    for w in words:
        s = "^^" + w + "$"
        grams.update(s[i : i + 3] for i in range(len(s) - 2))
    model = toxicity.CharModel(dict(grams), dict.fromkeys(words, 2))
    cache = toxicity._Weights(model, {"idio": 2.0, "stupid": 3.0, "cat$": 1.0, "noon$": 1.5})
    text = lambda n, letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, n)))
    for token in {"".join(rnd.choice(("", "", x, *toxicity.LOOKALIKES)) if rnd.random() < 0.3 else x * rnd.choice((1, 1, 1, 2, 5)) for x in rnd.choice(words)) + rnd.choice(("", "!", ",", "$$")) for _ in range(3000)} | {text(8, "cato0135s$!*-.iide,") for _ in range(2000)}:
        if token:
            found = [cache.weights[f] for f in toxicity.features(toxicity.restored(token, model)) if f in cache.weights]
            assert cache[token] == max(found, default=0.0), token
    for _ in range(5000):
        s = text(30, "a b.c-d_e*1 @$!|+(<\u20ac\u00a3\u00a1\u00e9\u0301\u00df\u6f22 \n,ii..**")
        assert toxicity.tokens(s) == s.lower().split() + [" " + m[0][::2] for m in toxicity._APART.finditer(s.lower()) if any(c.isalnum() for c in m[0])]


# --- 5 ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("digest", [None, lambda t: (F.length(t) % 3).cast("string")])
def test_exact_dedup_by_bytes(docs, digest):
    rows = exact.stream_dedup(docs, digest=digest).collect()
    groups = Counter(t or "" for _, t in ROWS)
    top = {t: max((i for i, u in ROWS if (u or "") == t and i is not None), default=None) for t in groups}
    want = sorted((str(i), str(top[t or ""]), groups[t or ""], i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows) == want


def test_exact_dedup_of_nothing_and_over_batches(docs, empty):
    assert exact.stream_dedup(empty).count() == 0
    one = sorted(map(str, exact.stream_dedup(docs.repartition(6), files_per_batch=1).collect()))
    assert one == sorted(map(str, exact.stream_dedup(docs).collect()))


def test_exact_dedup_goes_on_from_its_state(spark, docs, tmp_path):
    """Two calls that share a folder give what one call gives; a locator leads to the content that stays."""
    key = lambda df: sorted(map(str, df.drop("locator").collect()))
    folder, half = f"file://{tmp_path}/state", F.xxhash64("doc_id", "text") % 2 == 0
    first = exact.stream_dedup(docs.where(half), state=folder)
    assert key(first) == key(exact.stream_dedup(docs.where(half)))
    assert key(exact.stream_dedup(docs.where(~half), state=folder)) == key(exact.stream_dedup(docs))
    docs.coalesce(2).write.parquet(f"{tmp_path}/docs")
    files = spark.read.parquet(f"{tmp_path}/docs")
    rows = exact.stream_dedup(files)
    at = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    found = rows.select("locator.*", "text_sha256").join(at, ["file", "row"])
    assert found.count() == len(ROWS) and found.where("sha <> text_sha256").count() == 0


# --- 6 and 8 ------------------------------------------------------------------------------------------------------
def near_rows() -> list[tuple]:
    rnd = random.Random(7)
    rows = list(ROWS)
    for g in range(6):
        base = [f"w{rnd.randrange(4000)}" for _ in range(120)]
        for k in range(8):
            own = list(base)
            for _ in range(k // 2):
                own[rnd.randrange(120)] = f"e{rnd.randrange(10**6)}"
            rows.append((1000 + 10 * g + k, " ".join(own)))
    return rows


def test_near_dedup_is_brute_force(spark, empty):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((str(i), len(sets[k]), str(least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], KIND)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near.near_dedup(df).collect()) == want
    assert near.near_dedup(empty).count() == 0


def test_links_across_components_of_a_bucket_are_found(spark):
    """Members that only meet the pivot's bucket, but not the pivot itself, are compared with each other in blocks."""
    rows = [(1, k, 100, [9 + k, 1], bytes([255 * (k % 2)]) * (near.BITS // 8), str(k), k % 3) for k in range(9)]
    df = spark.createDataFrame(rows, "key long, sig long, n long, bands array<long>, sketch binary, ref string, component long")
    found = {(r.a, r.b) for r in near._across(df, 85).collect()}
    assert found == {(a, b) for a in range(9) for b in range(a + 1, 9) if a % 3 != b % 3 and a % 2 == b % 2}


@pytest.mark.parametrize("n", [40, 300, 2000, 30000])
def test_odd_sketches_estimate_high_similarity(n):
    """Pairs at the threshold pass, pairs well below it don't."""
    rnd = np.random.default_rng(3)

    def pair(similarity: float, more: int = 0) -> bool:
        shared = int(np.ceil((2 * n + more) * similarity / (1 + similarity)))
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:shared], rnd.integers(0, 2**63, n + more - shared).astype(np.uint64)])
        a.sort()
        b.sort()
        bits = near.odd_sketch(np.concatenate([a, b]), np.array([0, n, 2 * n + more])).view(np.uint64)
        return bool(near.likely(np.array([n]), np.array([n + more]), np.bitwise_count(bits[:1] ^ bits[1:]).sum(axis=1), 85)[0])

    assert all(pair(0.85) and pair(0.95) and pair(0.86, n // 10) for _ in range(20))
    assert not any(pair(0.6) for _ in range(20))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containment_is_brute_force(spark, docs, empty):
    rnd = random.Random(9)
    items = [(k, " ".join(f"b{rnd.randrange(500)}" for _ in range(n))) for k, n in enumerate([3, 8, 20, 60, 150, 20])] + [(9, ""), (10, None)]
    rows = [*ROWS]
    for k, t in items[:6]:
        w = t.split()
        cut = w[: max(3, int(len(w) * 0.9))]
        rows += [(200 + k, " ".join(["pre"] * 300 + w + ["post"] * 5)), (300 + k, " ".join(["x"] * 50 + cut)), (400 + k, " ".join(w[: len(w) // 2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        for k, u in items:
            s = shingles(u)
            size = min(5, len(WORD.findall(u or "")))
            if s:
                own = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
                if len(s & own) >= 0.8 * len(s):
                    want.add((i, k, len(s), len(s & own)))
    for block in (decontam.BLOCK_BYTES, 300):
        got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontam.contained(df, it, block_bytes=block).collect()}
        assert got == want
    gone = {i for i, *_ in want}
    assert {r.doc_id for r in decontam.without(df, it).collect()} == {i for i, _ in rows} - gone
    assert decontam.contained(empty, it).count() == 0 and decontam.contained(docs, it.where("false")).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant", "\\", "\\\\<|", "<", "|", "", None, "é<|x", "a" * 20000, "<\\|"]
    rnd = random.Random(4)
    rows = [(rnd.randrange(5), k, rnd.choice(["user", "assistant", "sys\ntem", None, "\\"]), rnd.choice(texts), "x") for k in range(200)] + [(None, 1, "assistant", "a", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t, _ in sorted(rows, key=lambda x: x[1]) if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(chat.format_chats(df.where("false"))).count() == 0


def test_a_long_conversation_comes_in_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(50).selectExpr("1L as conv_id", "id as turn", "'assistant' as role", "cast(id as string) as text")
        out = chat.chat_digests(chat.format_chats(df)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 1 and out[0].n_turns == 50 and out[0].loss_sha256 == hashlib.sha256("".join(map(str, range(50))).encode()).hexdigest()


# --- 10 -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot_at", [suffix.HOT, 2])
def test_repeats_are_brute_force(spark, hot_at):
    rnd = random.Random(11)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    rows = list(ROWS)
    for k in range(40):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else "".join(rnd.choice("uvwxyzé") for _ in range(rnd.randint(5, 80))) for _ in range(rnd.randint(1, 6))]
        rows.append((500 + k, "".join(parts)))
    data = [(i, (t or "").encode()) for i, t in rows]
    big = 2**63 - 1
    first: dict[bytes, int] = {}
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, big), big if i is None else i)
    want = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (big if i is None else i):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want.append((str(i), len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], KIND)
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, hot_at=hot_at).collect()]
    assert sorted(got) == sorted(want)
    assert suffix.remove_repeats(df.where("false")).count() == 0


def test_expansion_numbers_equal_prefixes():
    rnd = random.Random(3)
    for _ in range(40):
        text = np.array([x for k in range(4) for x in [*(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))), -1 - k]])
        number = suffix.expand(text, 5)
        by: dict[bytes, set] = {}
        for i in range(len(text) - 4):
            if (text[i : i + 5] >= 0).all():
                by.setdefault(text[i : i + 5].astype(np.uint8).tobytes(), set()).add(number[i])
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
