import math
import random
import re
from collections import Counter

import pytest

from tunetally.llm import lexical as X

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=50):
    bags = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n = len(bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for doc_id, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // total
            score = 0
            for t in set(terms(text)) & bag.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else doc_id, -score))
    return out


def check(spark, docs, items, k=50):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()], k)
    got = [tuple(r) for r in X.ranked(docs, items, k).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return want


@pytest.fixture
def make_items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.fixture
def small_segments(monkeypatch):
    """Every part of the search is met on small tables: several segments, spans and blocks."""
    for name, value in (("SEGMENT_DOCS", 37), ("SPAN", 4), ("SHORT", 5)):
        monkeypatch.setattr(X, name, value)


def test_documents(spark, sample_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert check(spark, sample_docs.repartition(3), items)


def test_segments_and_spans(spark, small_segments, make_docs, make_items):
    # Workers read the module anew, so the search is run here on rows of the index.
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80)))) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)]
    items = [(q, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for q in range(40)]
    queries = [sorted({t.encode() for t in terms(text)}) for _, text in items]
    words = sorted({t for q in queries for t in q})
    number = {w: k for k, w in enumerate(words)}
    parts, segment = [], X._Segment()
    for doc_id, text in rows:
        segment.add(doc_id, X.terms_of(text), number)
        if segment.full():
            parts.append(segment.row())
            segment = X._Segment()
    parts.append(segment.row())
    parts = [p.to_pylist()[0] for p in parts]
    assert len(parts) > 10
    n, total = sum(p["n_docs"] for p in parts), sum(p["n_terms"] for p in parts)
    df = Counter(t for _, text in rows for t in set(terms(text)))
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[w.decode()] + 1))) for w in words]
    import numpy as np

    seen = {"all": 0, "scored": 0}
    score, joined = X._score, X._joined

    def counted(lists, streams, rest, low, high, best):
        seen["scored"] += high - low
        return score(lists, streams, rest, low, high, best)

    got = []
    X._score = counted
    try:
        for (item, _), query in zip(items, queries):
            best = X._Best(10)
            for p in parts:
                lists = X._Lists(p, n, total, np.array(weight))
                seen["all"] += len(lists.ids)
                X._search(lists, np.array([number[w] for w in query]), best)
            got += [(item, r + 1, int(d), int(s)) for r, (s, d) in enumerate(zip(best.scores, best.ids))]
    finally:
        X._score = score
    assert got == brute(rows, items, 10)
    assert seen["scored"] < 0.8 * seen["all"]  # spans are skipped
    assert joined(np.array([1, 2, 5])) == [(1, 3), (5, 6)]


def test_ties_and_copies(spark, make_docs, make_items):
    rows = [(i, "alpha beta") for i in range(120, 0, -1)] + [(500, "alpha"), (501, "gamma Beta"), (502, "delta")]
    want = check(spark, make_docs(*rows).repartition(6), make_items((1, "alpha"), (2, "BETA gamma"), (3, "none")))
    assert [r[2] for r in want if r[0] == 1][:3] == [500, 1, 2]


def test_odd_rows(spark, make_docs, make_items):
    docs = make_docs(
        (1, None), (2, ""), (3, "!? _\n"), (4, "Ärger ärger 😀x"), (4, "Ärger"), (None, "Ärger und 7"), (5, "und UND a_b"),
        (6, "und"), (6, "und"), (7, "x" * 3000 + " " + "é" * 50),
    )
    docs = docs.withColumns({c: docs.lang for c in ("item", "rank", "score", "item_id", "ids")})
    items = make_items((1, "Ärger"), (1, "und 7"), (1, "und 7"), (2, None), (3, ""), (None, "a b x"), (4, "ärger UND"))
    check(spark, docs, items.withColumn("doc_id", items.item_id))
    assert X.ranked(docs.limit(0), items).count() == 0
    assert X.ranked(docs, items.limit(0)).count() == 0
    assert X.ranked(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_text_and_blocks_of_queries(spark, make_docs, make_items, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_CHARS", 100)
    long = " ".join(f"t{k}" for k in range(200_000))
    assert len(long) > 1_000_000
    docs = make_docs((1, long), (2, "t1 t2 t3"), (3, "t199999 z"), (4, "q"))
    items = make_items(*((k, f"t{k} t199999 z") for k in range(9)), (50, long))
    assert len(list(X._blocks(items))) > 1
    check(spark, docs, items)
