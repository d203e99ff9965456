import collections
import random

import numpy as np
import pytest
from llm.conftest import words_of
from pyspark.sql import functions as F

from tunetally.llm import quality


def brute(text):
    text = text or ""
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, dup, len(covered))


def test_counts_equal_brute_force(make_docs, sample_docs):
    rng = random.Random(3)
    odd = ["", None, " ", "\n\n", "a", "é ü x", "a b c d e f g h " * 3, "x\ty\x0bz\x0cw\rv\n#$ <>", "l\nl\n l\nl\n\n", " \u0085 a"]
    odd += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(30)]
    docs = make_docs(*enumerate(odd)).unionByName(sample_docs.withColumn("doc_id", sample_docs.doc_id + 1000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.judged(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = brute(texts[r.doc_id])
        assert tuple(r[c] for c in quality.BASE) == n, texts[r.doc_id]
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert r.base_failed == failed
        assert not (failed and r.kept)


def test_divergence_equals_definition():
    rng = np.random.default_rng(1)
    p, q = rng.dirichlet(np.ones(5), 3), rng.dirichlet(np.ones(5))
    for row, got in zip(p, quality.js_divergence(p, q)):
        m = (row + q) / 2
        want = (sum(row * np.log2(row / m)) + sum(q * np.log2(q / m))) / 2
        assert abs(got - want) < 1e-12
    assert quality.js_divergence(np.array([[1.0, 0]]), np.array([0, 1.0]))[0] == 1
    assert quality.js_divergence(np.array([[1.0, 0]]), np.array([1.0, 0]))[0] == 0


def prose(rng, n):
    return " ".join(rng.choice(("the", "of", "and", "house", "river", "stone", "was", "in", "green")) for _ in range(n)).capitalize() + "."


def test_odd_texts_go_and_clean_and_short_ones_stay(make_docs):
    rng = random.Random(5)
    rows = [(k, prose(rng, 120), "en") for k in range(40)]
    rows += [(100, " | ".join(f"q{k}zz" for k in range(90)), "en"), (101, prose(rng, 120).upper() + "!!", "en")]
    rows += [(102, " | ".join(f"q{k}" for k in range(24)), "en")]  # too short for histograms
    rows += [(103, " ".join(f"zq{k}" for k in range(90)), "xx")]  # no reference for this language
    rows += [(104, prose(rng, 120), None)]
    out = {r.doc_id: r for r in quality.judged(make_docs(*rows)).collect()}
    assert all(out[k].kept for k in range(40))
    assert not out[100].kept and not out[101].kept
    assert out[102].kept and out[102].distance is None
    assert out[103].kept and out[103].distance is None
    assert out[104].kept


def test_filter_keeps_rows_as_they_are(make_docs, spark):
    rng = random.Random(5)
    text = prose(rng, 60)
    docs = make_docs((1, text), (1, text), (None, text, None), (2, None), (3, ""))
    docs = docs.withColumns({"quality_key": docs.lang, "kept": docs.doc_id, "k0": docs.lang})
    out = quality.quality_filter(docs.drop("quality_key"))
    assert out.columns == docs.drop("quality_key").columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert quality.quality_filter(docs.limit(0)).count() == 0
    assert quality.judged(docs.limit(0)).count() == 0


def test_rare_languages_are_judged_at_every_table_size(make_docs, spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, 120), "en") for k in range(30)] + [(100 + k, prose(rng, 120), "sv") for k in range(20)]
    garbled = " | ".join(f"q{k}zz" for k in range(90))
    rows += [(200, garbled, "sv"), (201, garbled, "xx"), (202, prose(rng, 120), "xx"), (203, garbled, None)]
    rows += [(204, " ".join(rng.choice(("он", "и", "она", "были", "в", "доме", "камнем", "река")) for _ in range(80)), "xx")]
    docs = make_docs(*rows)
    more = spark.range(1000, 26000).selectExpr("id doc_id", f"'{prose(rng, 60)}' text", "'de' lang", "'s' source", "0L n_chars")
    for table in (docs, docs.union(more)):
        out = {r.doc_id: r for r in quality.judged(table).where("doc_id < 1000").collect()}
        assert [k for k in out if not out[k].kept] == [200, 201, 203]
        assert out[200].distance is not None and out[201].distance is None and out[201].profile_distance > quality.MAX_DISTANCE


def test_no_language_with_a_reference(make_docs):
    rng = random.Random(8)
    rows = [(k, prose(rng, 120), f"l{k % 5}") for k in range(40)]
    garbled = " | ".join(f"q{k}zz" for k in range(90))
    out = {r.doc_id: r.kept for r in quality.judged(make_docs(*rows, (100, garbled, "l1"), (101, garbled, None))).collect()}
    assert [k for k in out if not out[k]] == [100, 101]


def test_languages_beyond_the_common_ones_give_the_same(sample_docs, monkeypatch):
    docs = sample_docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    want = sorted(map(str, quality.judged(docs).collect()))
    first = quality.judged(docs.where("lang = 'de'")).count()
    monkeypatch.setattr(quality, "COMMON", 1)
    got = quality.judged(docs).collect()
    assert len(got) == len(want) and first
    own = [r for r in docs.collect() if r.lang is not None]
    kept = {r.doc_id: r.kept for r in got}
    strict = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert kept == strict and sum(kept[r.doc_id] for r in own) > 0.7 * len(own)


@pytest.mark.parametrize("junk", [0, 19, 20, 2000])
def test_junk_labels_approve_nothing(make_docs, spark, junk):
    rng = random.Random(9)
    garbled = lambda k: " | ".join(f"q{k + n}zz" for n in range(90))
    rows = [(k, prose(rng, 120), "en") for k in range(40)] + [(100, garbled(7), "en"), (101, garbled(8), None)]
    docs = make_docs(*rows, *((1000 + k, garbled(k), "zz") for k in range(junk)))
    out = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert [k for k in sorted(out) if out[k]] == list(range(40))


@pytest.mark.parametrize("text", [
    "В начале было слово и слово было у реки, а дом стоял на холме. " * 8,
    "昔々ある所にお爺さんとお婆さんが住んでいました。お爺さんは山へ柴刈りに行きました。" * 8,
    "ในวันหนึ่งมีชายคนหนึ่งเดินทางไปยังเมืองใหญ่เพื่อค้าขาย " * 10,
    "Es war einmal ein König, der hatte drei Töchter; die jüngste war schön. " * 6,
])
def test_scripts_are_near_the_profile(text):
    texts = quality.Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 0, 1)
    chars = quality._measure(texts)[6]
    assert quality._profile_distance(chars)[0] < quality.MAX_DISTANCE


def test_very_long_text(make_docs):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000)) + "\n" + "same line\n" * 3
    assert len(long) > 1_000_000
    row = quality.judged(make_docs((1, long))).first()
    assert tuple(row[c] for c in quality.BASE) == brute(long) and not row.base_failed
