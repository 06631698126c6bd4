"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import hashlib
import re
import zlib

import corpus_pipeline as pipeline
from tidemark.llm import bpe, toxicity
from tidemark.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        kept.append((name, docs))
        if name != "bpe":
            assert docs.columns == columns
    texts = [{r.doc_id: r.text for r in df.collect()} for _, df in kept[:4]]
    toxic, exact, near, clean = texts
    assert set(clean) <= set(near) <= set(exact) <= set(toxic) <= set(before)
    top = {}
    for i, t in toxic.items():
        top[t] = max(i, top.get(t, i))
    assert set(exact) == set(top.values())
    sets = {i: shingles(t) for i, t in exact.items()}
    similar = lambda a, b: bool(a & b) and 100 * len(a & b) >= pipeline.SIMILARITY * len(a | b)
    assert not any(similar(sets[i], sets[j]) for i in near for j in near if i < j)
    assert all(any(similar(sets[i], sets[j]) for j in exact if j != i) for i in set(exact) - set(near))
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i in near if any(len(s & sets[i]) >= 0.8 * len(s) for s in items if s)}
    assert set(clean) == set(near) - leaks
    b = bpe.loaded(bpe.vocabulary_path())
    for r in kept[-1][1].collect():
        ids = b.encode(clean[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()


def test_toxicity_stage_learns_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """The character model and the words of a table larger than any sample are those of all rows that aren't held out."""
    n, models = 25_500, []
    df = spark.range(n).selectExpr("id AS doc_id", "concat('the cat sat', if(id % 10 = 0, ' stupid', '')) AS text")
    spark.range(n).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    accepted = toxicity.accepted
    monkeypatch.setattr(toxicity, "accepted", lambda docs, model: models.append(model) or accepted(docs, model))
    assert pipeline.non_toxic(spark, df, str(tmp_path)).count() == n - n // 10
    learnt = [k for k in range(n) if zlib.crc32(str(k).encode()) % 5]
    assert len(learnt) > 20_000 and models[0]["chars"]["^^c"] == len(learnt) and models[0]["words"] == dict.fromkeys(("the", "cat", "sat"), len(learnt)) | {"stupid": sum(k % 10 == 0 for k in learnt)}


def test_stages_take_tricky_and_empty_tables(spark, sf):
    """Repeated and null ids, null and empty texts, and columns with names that a stage might use itself."""
    rows = [
        (1, "aaa", 1, "x", "k"), (1, "bbb", 2, "x", "k"), (2, "bbb", 3, "x", "k"), (None, "aaa", 4, "x", "k"), (None, "solo", 5, "x", "k"),
        (3, None, 6, "x", "k"), (4, "", 7, "x", "k"), (4, None, 8, None, None), (5, "x" * 3000, 9, "x", "k"), (5, "x" * 3000, 9, "x", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text long, _stays string, key string")
    tuples = lambda d: sorted(((r.doc_id, r.text, r._text, r._stays, r.key) for r in d.collect()), key=str)
    want = [(1, "aaa", 1, "x", "k"), (2, "bbb", 3, "x", "k"), (None, "solo", 5, "x", "k"), (4, "", 7, "x", "k"), (5, "x" * 3000, 9, "x", "k")]
    kept = written(pipeline.exact_distinct(spark, df, sf), "tricky-exact")
    assert kept.columns == df.columns and tuples(kept) == sorted(want, key=str)
    base = " ".join(f"w{k}" for k in range(40))
    near = [(7, base, 1, "x", "k"), (7, base + " more", 2, "x", "k"), (8, base, 3, "x", "k"), (None, base + " tail", 4, "x", "k"), (None, "alone here", 5, "x", "k"), (None, "", 6, "x", "k"), (9, "", 7, "x", "k")]
    got = tuples(written(pipeline.near_distinct(spark, spark.createDataFrame(near, df.schema), sf), "tricky-near"))
    assert got[-1][0] is None and len(got) == 4 and {r[0] for r in got} == {7, 9, None} and (None, "alone here", 5, "x", "k") in got and (None, "", 6, "x", "k") in got
    for source in (df, df.where("false")):
        docs = source
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, sf), "tricky-stage")
            assert name == "bpe" or docs.columns == df.columns
        assert docs.count() == (5 if source is df else 0)
