import hashlib
import random

import pytest
from llm.conftest import words_of

from tunetally.llm import substrings


def brute(texts, size=13):
    first = {}
    words = {i: words_of(t) for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for k in range(len(own) - size + 1):
            if first[tuple(own[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = [w for k, w in enumerate(own) if k not in gone]
        out[i] = (len(own), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def compare(docs, size=13):
    want = brute({r.doc_id: r.text for r in docs.collect()}, size)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_report(docs, size).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    cut = {r.doc_id: r.text for r in substrings.remove_repeats(docs, size).collect()}
    assert {i: words_of(t) for i, t in cut.items()} == {i: w[3] for i, w in want.items()}
    return want


@pytest.mark.parametrize("period", range(1, 14))
def test_cover_brings_any_two_positions_together(period):
    cover = substrings.difference_cover(period)
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))


def test_equals_brute_force_on_documents(sample_docs):
    want = compare(sample_docs)
    assert sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("size", [1, 2, 5, 13])
def test_shared_passages(make_docs, spark, size):
    rng = random.Random(size)
    rows = [(9, None), (8, ""), (7, " \n "), (6, "é ü"), (-3, "a b c")]
    passages = [[f"p{n}_{k}" for k in range(rng.randrange(8, 40))] for n in range(6)]
    for i in range(20, 120):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += [rng.choice("abcdef") + str(rng.randrange(50)) for _ in range(rng.randrange(30))]
            cut = rng.choice(passages)
            own += cut[rng.randrange(4) : len(cut) - rng.randrange(4)]
        rows.append((i, "\t".join(own) + rng.choice(["", "\n"])))
    rng.shuffle(rows)
    docs = make_docs(*rows).repartition(3)
    compare(docs, size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    compare(docs, size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def test_odd_rows(make_docs):
    text = " ".join(f"w{k}" for k in range(20))
    docs = make_docs((2, text + " x"), (2, text + " x"), (None, text), (1, "y\n " + text), (5, text), (6, None))
    docs = docs.withColumns({"known": docs.lang, "known_windows": docs.lang, "hashes": docs.lang, "part": docs.lang})
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert rows == sorted(
        [("2", "x", 1), ("2", "x", 1), ("None", text, len(text)), ("1", "y\n " + text, len(text) + 3), ("5", "", 0), ("6", None, 0)]
    )
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    assert substrings.removal_report(docs.limit(0)).count() == 0


def test_words_that_a_polynomial_takes_for_equal(make_docs):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    common = "one two three four five six seven eight nine ten eleven twelve "
    compare(make_docs((1, common + word), (2, common + other), (3, common + word)))


def test_very_long_texts(make_docs):
    rng = random.Random(4)
    words = [f"w{rng.randrange(30_000)}" for _ in range(200_000)]
    text = " ".join(words)
    assert len(text) > 1_000_000
    compare(make_docs((1, " ".join(words[50_000:50_100])), (2, text), (3, "x " + text[::-1]), (4, " ".join(words[150_000:]))))


def test_groups_of_parts_give_the_same(sample_docs, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 20_000)
    monkeypatch.setattr(substrings, "FIRST_PARTS", 3)
    assert substrings.layout(400_000, 4).grouped
    compare(sample_docs.limit(120))


def test_parts_stay_bounded_at_a_hundred_terabytes():
    plan = substrings.layout(100 << 40, 200)
    assert plan.groups <= substrings.FIRST_PARTS and plan.parts * substrings.PART_BYTES >= 100 << 40
    assert plan.group * substrings.FIRST_PARTS < plan.parts + substrings.FIRST_PARTS
    # A task that packs 64 MB fills its rows: several hundred entries for each part of a group.
    assert substrings.REPACK_BYTES / 12 / plan.group > 500
    assert not substrings.layout(30 << 30, 200).grouped
