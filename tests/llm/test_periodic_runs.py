import hashlib
import random
import zlib

import pytest
from llm.conftest import words_of

from tunetally.llm import periodic_runs as P


def brute(words, min_words=6):
    """All runs: stretches of equal words q apart that no stretch of a smaller q contains."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= 3 * q:
                found.append((i, j - i + q, q))
            i = j + 1
    outer = [r for r in found if not any(s[0] <= r[0] and sum(s[:2]) >= sum(r[:2]) and s[2] < r[2] for s in found)]
    return sorted((r for r in outer if r[1] >= min_words), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def check(docs, runs_of=brute):
    got = P.report(docs).collect()
    detail = {(r.doc_id, r.n_words, r.collapsed): r.runs for r in P.detected(docs).collect()}
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert len(got) == len(texts)
    want = []
    for none, doc_id, text in texts:
        words = words_of(text)
        runs = runs_of(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        told = "".join("%d,%d,%d\n" % r for r in runs)
        left = collapsed(words, runs)
        doc_id = None if none else doc_id
        assert [tuple(r) for r in detail[doc_id, len(words), left]] == runs
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (told, left)]
        milli = best[1] * 1000 // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, *sums, len(words)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    return want


def mixed(rng, longest=900):
    words = []
    alphabet = "abcdefghij"[: rng.choice([1, 2, 3, 10])]
    for _ in range(rng.randrange(6)):
        period = [rng.choice(alphabet) for _ in range(rng.randrange(1, 40))]
        words += [period[i % len(period)] for i in range(rng.randrange(len(period) * 9))]
        if rng.random() < 0.3:
            words *= rng.randrange(1, 6)
        del words[longest:]
        if words and rng.random() < 0.2:
            words[rng.randrange(len(words))] = "z"
    return words


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(make_docs, seed):
    rng = random.Random(seed)
    found = check(make_docs(*((i, " ".join(mixed(rng))) for i in range(40))))
    assert sum(r[1] for r in found) > 40


def test_periods_of_periods(make_docs):
    inner = ["a b " * 5 + "c", "a a a a a a b", "a b a a b a b a a b a a b"]
    docs = [(i, " ".join([x] * n)) for i, (x, n) in enumerate((x, n) for x in inner for n in (1, 3, 4, 7, 20))]
    check(make_docs(*docs, (99, "x " * 5), (100, "x " * 6), (101, "x y " * 4), (102, "x y " * 3 + "x")))


def test_chunks_do_not_join_texts(make_docs, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_WORDS", 50)
    rng = random.Random(9)
    words = [mixed(rng, 200) for _ in range(60)] + [["a"] * 3] * 20
    for a, b in P._chunks(words):
        for own, (runs, left) in zip(words[a:b], P._of_texts([[w.encode() for w in x] for x in words[a:b]], 6)):
            assert runs == brute(own) and left.decode() == collapsed(own, runs)


def test_odd_rows(make_docs):
    docs = make_docs(
        (1, None), (2, ""), (3, " \t\n"), (None, "a " * 9), (4, "é 😀 " * 6), (5, "b\tb\nb\x0bb\x0cb\rb"),
        (6, "A a " * 3), (7, "same " * 8), (7, "same " * 8), (7, "other"), (8, "a b " * 6),
    )
    docs = docs.withColumns({"runs": docs.lang, "best": docs.lang, "start": docs.lang, "collapsed": docs.lang, "n": docs.lang})
    check(docs)
    assert P.report(docs.limit(0)).count() == 0


def test_very_long_text(make_docs):
    rng = random.Random(3)
    noise = [str(rng.randrange(10**6)) for _ in range(60_000)]
    period = [str(rng.randrange(10**6)) for _ in range(9_001)]
    words = noise + (period * 5)[:40_000] + noise[::-1] + ["x"] * 50_000
    text = " ".join(words)
    assert len(text) > 1_000_000
    got = P.report(make_docs((1, text))).first()
    runs = [(60_000, 40_000, 9_001), (160_000, 50_000, 1)]
    assert got.n_runs == 2 and got.start == 160_000 and got.exponent_milli == 50_000_000
    assert got.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_documents_with_planted_repetitions(sample_docs):
    planted = {r.doc_id: words_of(r.text) for r in P.planted(sample_docs).collect()}
    changed = 0
    for r in sample_docs.collect():
        words, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert planted[r.doc_id] == words
    assert changed and sum(r[1] for r in check(P.planted(sample_docs))) > 0


def test_planting_leaves_nulls(make_docs):
    rows = P.planted(make_docs((None, "a b"), (3, None), (24, ""), (24, None))).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(None, "a b"), (3, None), (24, ""), (24, None)]
