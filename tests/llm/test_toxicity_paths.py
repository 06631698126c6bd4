from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from tidemark.llm import toxicity


def test_the_lattice_is_walked_once_for_a_token_and_its_core(monkeypatch):
    walked = []
    walk = toxicity.viterbi
    monkeypatch.setattr(toxicity, "viterbi", lambda token, *more: walked.append(token) or walk(token, *more))
    model = toxicity.CharModel({"^^f": 3, "^fo": 3, "foo": 3, "oo$": 2, "ool": 1, "ol$": 1}, {"foo": 2, "fool": 2})
    cache = toxicity._Features(model)
    tokens = ["f0ol", "f0ol,", "f0ol:", " f0ol"]
    first = [cache[t] for t in tokens]
    cache.clear()  # as it does when it is full
    assert [cache[t] for t in tokens] == first
    assert first[:3] == [toxicity.features([walk("f0ol", model)])] * 3
    assert walked == ["f0ol", "f0ol"]  # as one word, and as what may be several


def test_clean_rows_are_asked_only_for_what_toxic_rows_have():
    rnd = random.Random(4)
    words = "stupid stupor idiot cat sat mat noon seen too bee idea".split()
    grams: Counter = Counter()
    for w in words:
        s = "^^" + w + "$"
        grams.update(s[i : i + 3] for i in range(len(s) - 2))
    model = toxicity.CharModel(dict(grams), dict.fromkeys(words, 2))
    listed = sorted({f for w in ("stupid", "idiots", "noon", "cat") for f in toxicity.features([w])})
    places = toxicity._Places(model, {f: i for i, f in enumerate(listed)})
    for _ in range(5000):
        word = "".join(rnd.choice(("", x, *toxicity.LOOKALIKES)) if rnd.random() < 0.2 else x * rnd.choice((1, 1, 1, 2, 5)) for x in rnd.choice(words))
        token = rnd.choice(("", "", "(", "'")) + word + rnd.choice(("", ",", "!", ".)"))
        if token:
            assert set(map(listed.__getitem__, places[token])) == set(toxicity.features(toxicity.restored(token, model))) & set(listed), token
    assert any(places.values()) and not all(places.values())


def test_no_weight_below_the_least_toxic_rows():
    for sizes in ({(0, 0): 900, (0, 1): 100, (1, 0): 880, (1, 1): 120}, {(0, 0): 40, (0, 1): 60, (1, 0): 5, (1, 1): 95}, {(0, 1): 30, (1, 0): 50, (1, 1): 1}, {(0, 0): 3}):
        least = toxicity.least_toxic(sizes)
        for halves in ((0,), (1,), (0, 1)):
            nt, nc = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
            t, c = (x.ravel().astype(float) for x in np.meshgrid(np.arange(min(nt, 200) + 1), np.arange(min(nc, 200) + 1)))
            weighty = toxicity.weight(t, c, nt, nc) > toxicity.LEAST
            assert (t[weighty] >= least).all()
    assert toxicity.least_toxic({(0, 0): 900, (0, 1): 100}) > 4


def test_tokens_that_begin_as_no_feature_take_no_place():
    model = toxicity.CharModel({"^^f": 3, "^fo": 3, "foo": 3, "oo$": 2, "ool": 1, "ol$": 1}, {"foo": 2, "fool": 2})
    cache, plain = (toxicity._Weights(model, {"fool": 2.0, "gras": 1.5}) for _ in range(2))
    text = "the green grass grows where f0ol, fooool and f o o l lie; " + "overthegreenhillsandfarawayfool graze"
    found = [w for w in map(plain.__getitem__, set(toxicity.tokens(text))) if w]
    assert toxicity.evidence(text, cache) == (max(found), math.log1p(math.fsum(map(math.exp, found))), math.log1p(len(found))) and len(found) > 2
    assert not {"where", "grows", "graze"} & set(cache) and {"where", "grows", "graze"} < set(plain)
