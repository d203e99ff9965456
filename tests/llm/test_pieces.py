import random

import public_tokenizers
import pytest
import sentencepiece

from tunetally.llm import pieces

ODD = ["", "a", " ", "  ", "a  b", " a", "a ", "a\nb\n", "a\tb\r\n", "é　x", "ab\xa0c", "😀 x", "\x00", "aaaaaaaaaaaa", "a" * 3000, "   x    y", "<0x0A> <unk> </s>", "The quick brown fox's 123,456.78!", "ßäö ÀÉ ñ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def texts_of(rng, n):
    return ["".join(rng.choice("abcdefghij  \nest") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(spark, make_docs, sample_docs, library):
    rng = random.Random(4)
    docs = make_docs(*enumerate(ODD + texts_of(rng, 300))).unionByName(sample_docs.withColumn("doc_id", sample_docs.doc_id + 5000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.encoded(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == library.encode(texts[r.doc_id]), texts[r.doc_id]
        assert r.n_tokens == len(r.ids) and r.round_trip
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back == texts


def test_unigram_walk_equals_the_library():
    """The same pieces and scores read as a unigram model."""
    data = open(public_tokenizers.path(pieces.MODEL), "rb").read()
    model = pieces.Model(data)
    at = data.index(b"\x18\x02\x20\x80\xfa\x01")  # model_type 2, vocab_size 32000
    changed = data[: at + 1] + b"\x01" + data[at + 2 :]
    unigram, library = pieces.Model(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    assert model.kind == 2 and unigram.kind == 1
    memory = pieces._Memory(unigram)
    rng = random.Random(7)
    for text in [t for t in texts_of(rng, 200) if "  " not in t and "\n" not in t]:
        ids, bounds = memory.encode([text])
        assert ids.tolist() == library.encode(text), text


def test_walk_shares_prefixes(monkeypatch):
    model, steps = pieces.load(pieces.MODEL), []
    extend = model._extend_merged

    def counted(word, states, lasts, scores):
        steps.append(len(word) + 1 - len(states))
        extend(word, states, lasts, scores)

    monkeypatch.setattr(model, "_extend_merged", counted)
    words = ["▁then", "▁the", "▁there", "▁them"]
    out = model.encode_words(words)
    assert sum(steps) == len("▁then") + len("re") + len("m")
    assert {w: [model.names[k] for k in ids] for w, ids in out.items()} == {w: model.merged(w) for w in words}


def test_neighbours_equal_merging():
    model, rng = pieces.load(pieces.MODEL), random.Random(3)
    names = [n for n in model.ids if model.merged(n) == [n]]
    frequent = names[:600]
    for k in range(30_000):
        a, b = rng.choice(frequent if k % 2 else names), rng.choice(frequent)
        want = model.merged(a + b) == [a, b]
        assert model.neighbours(model.ids[a], model.ids[b]) == want, (a, b)


def test_very_long_words_and_runs(library):
    memory = pieces._Memory(pieces.load(pieces.MODEL))
    for text in (" " * 40_000, "a" * 40_000, "é" * 9_000 + "x" * 33, "ab" * 20_000, *(" " * k + "x" for k in range(40))):
        assert memory.encode([text])[0].tolist() == library.encode(text)


def test_odd_rows(make_docs, monkeypatch):
    docs = make_docs((1, "a b"), (1, "a b"), (None, None), (2, "x▁y"))
    docs = docs.withColumns({"ids": docs.lang, "n_tokens": docs.lang})
    rows = pieces.encoded(docs).collect()
    assert len(rows) == 4 and [r.round_trip for r in rows if r.doc_id == 2] == [False]
    assert [(r.n_tokens, list(r.ids), r.round_trip) for r in rows if r.doc_id is None] == [(0, [], True)]
    assert pieces.encoded(docs.limit(0)).count() == 0
