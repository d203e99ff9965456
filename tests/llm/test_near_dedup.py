import random
from math import comb

import numpy as np
from llm.conftest import words_of

from tunetally.llm import near_dedup
from tunetally.llm.components import components

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, size):
    words = words_of((text or "").translate(FOLD))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(texts, size, percent=80):
    """doc_id to component by comparing every pair of different sets."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a is not b and min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def compare(docs, size):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, sizes = brute(texts, size)
    rows = near_dedup.linked(docs, size).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return want


def test_equals_brute_force_on_documents(sample_docs):
    compare(sample_docs, 4)


def test_families_chains_and_odd_texts(make_docs):
    rng = random.Random(2)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    rows, k = [], 0
    base = fresh(100)
    for _ in range(50):  # near copies of one text, some too far from each other
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
        k += 1
    chain = fresh(200)
    for step in range(12):  # each is near the next, the ends are far apart
        rows.append((k, " ".join(chain[step * 10 : step * 10 + 90])))
        k += 1
    half = fresh(40)
    for _ in range(60):  # a shared passage that is not enough
        rows.append((k, " ".join(half + fresh(30))))
        k += 1
    rows += [(k, "A b C d e"), (k + 1, "a B c D E"), (k + 2, "a b"), (k + 3, "A b"), (k + 4, ""), (k + 5, None), (k + 6, " \n")]
    rng.shuffle(rows)
    want = compare(make_docs(*rows), 4)
    assert want[k + 1] == k and want[k + 3] == k + 2 and want[k + 5] == k + 5


def test_large_buckets_in_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    test_families_chains_and_odd_texts(make_docs)


def test_bounds_follow_the_posterior():
    for n, m in near_dedup.least_matches(0.8, 1e-3):
        x = (np.arange(200_000) + 0.5) / 200_000
        for matches, above in ((m, True), (m - 1, False)):
            density = x**matches * (1 - x) ** (n - matches) * (n + 1) * comb(n, matches)
            assert (density[x >= 0.8].mean() * 0.2 >= 1e-3) == above


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    links = spark.createDataFrame([*pairs, (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links, "t").collect()}
    parent = {i: i for i in range(500)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: find(i) for i in nodes}


def test_filter_keeps_one_of_each(make_docs):
    text = " ".join(f"w{k}" for k in range(30))
    docs = make_docs((3, text), (1, text), (1, text), (None, text), (None, text), (5, "x y"), (6, None), (7, None))
    docs = docs.withColumns({"band": docs.lang, "size": docs.lang, "node": docs.lang, "bucket": docs.doc_id, "label": docs.lang, "component": docs.lang})
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "5", "6", "7", "None", "None"]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_linked_each_by_its_own_text(make_docs):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    docs = make_docs((3, one), (5, one), (5, two), (6, two + " end"), (7, three), (7, three + " end"))
    rows = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.linked(docs, 5).collect())
    assert [r[:2] for r in rows] == [(3, 3), (5, 3), (5, 5), (6, 5), (7, 7), (7, 7)]
    assert all(r[2] == (r[0] == r[1]) for r in rows)
    out = near_dedup.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.text) for r in out)[:2] == [(3, one), (5, two)] and [r.doc_id for r in out].count(7) == 1 and len(out) == 3


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_a_polynomial_takes_for_equal(make_docs):
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    common = "one two three four five six seven eight nine ten eleven twelve "
    docs = make_docs((1, word), (2, other), (3, common + word), (4, common + other), (5, word))
    compare(docs, 4)
    assert {r.doc_id for r in near_dedup.near_dedup(docs).collect()} == {1, 2, 3}  # eight of ten shingles


def test_very_long_texts(make_docs):
    words = [f"w{k}" for k in range(160_000)]
    near = [*words[:80_000], "x", *words[80_001:]]
    text = " ".join(words)
    assert len(text) > 1_000_000
    far = " ".join(words[:100_000])
    rows = near_dedup.linked(make_docs((1, text), (2, " ".join(near)), (3, far), (4, "w " * 500_000)), 4).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in rows) == [
        (1, 1, 159_997), (2, 1, 159_997), (3, 3, 99_997), (4, 4, 1)
    ]
