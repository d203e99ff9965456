import hashlib
import random

import numpy as np
from llm.conftest import words_of
from pyspark.sql import functions as F

from tunetally.llm import fingerprints as P

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    words = words_of((text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def check(docs):
    rows = {r.doc_id: r for r in P.beside_next(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    assert set(rows) == set(ids)
    sketch = {r.doc_id: bytes(r.sketch).hex() for r in P.sketched(docs).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t = texts[i]
        changed = t[: len(t) - len(t) // 2] + texts[j][: len(t) // 2]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == sketch[i]
        for other, near in ((changed, r.near_edited), (texts[j], r.near_next)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1
            if len(a | b) <= P.K:
                assert abs(near - true) < 1e-9
            else:
                assert abs(near - true) < 0.3
    return rows


def test_documents(sample_docs):
    rows = check(sample_docs.repartition(5))
    same = {}
    for r in sample_docs.collect():
        assert same.setdefault(r.text, rows[r.doc_id].fingerprint) == rows[r.doc_id].fingerprint


def test_odd_rows(make_docs):
    docs = make_docs((5, ""), (4, None), (3, "a"), (9, "é😀x y"), (-2, "one two three four five six seven"))
    docs = docs.withColumns({"sketch": docs.lang, "side": docs.lang, "task": docs.lang, "fingerprint": docs.lang})
    rows = check(docs)
    assert rows[5].fingerprint == "" and rows[5].near_next == 1.0
    assert check(make_docs((1, "a b c d")))[1].near_next == 1.0
    assert P.beside_next(docs.limit(0)).count() == 0
    twice = P.beside_next(make_docs((1, "a"), (1, "b"), (None, "c"))).collect()
    assert len(twice) == 3 and {r.edited_sha256 for r in twice} == {hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c")}


def test_estimates_and_merging(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(4000)]
    texts = [" ".join(words[:2500]), " ".join(words[1500:])]
    docs = spark.createDataFrame([(1, texts[0], "x"), (2, texts[1], "x"), (3, "", "y")], "doc_id long, text string, g string")
    rows = {r.doc_id: P.unpacked(bytes(r.sketch)) for r in P.sketched(docs).collect()}
    a, b = rows[1], rows[2]
    assert abs(P.resemblance(a, b) - 0.25) < 0.2
    assert abs(P.containment(a, b) - 0.4) < 0.25
    assert abs(P.distinct(a) / 2496 - 1) < 0.4
    both = P.sketched(docs).join(docs.select("doc_id", "g"), "doc_id")
    merged = {r.g: bytes(r.sketch) for r in P.merged(both.select("g", "sketch"), "g").collect()}
    assert (P.unpacked(merged["x"]) == P.merge(a, b)).all() and merged["y"] == b""
    whole = {frozenset(np.unique(np.concatenate([a, b]))[: P.K].tolist())}
    assert {frozenset(P.merge(a, b).tolist())} == whole
    assert both.where(F.octet_length("sketch") > 4 * P.K).count() == 0


def test_very_long_text(make_docs):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(140_000)) + " é" + "z" * 100_000
    assert len(long) > 1_000_000
    check(make_docs((1, long), (2, "a b c"), (3, long[: len(long) // 2]), (4, "x" * 1_000_000)))
