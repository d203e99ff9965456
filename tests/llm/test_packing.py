import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tunetally.llm import packing, tokens


def test_patterns_cover_the_demand_and_are_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500, 20_000):
        sizes, demand = np.unique(rng.integers(1, 257, n), return_counts=True)
        out = packing.solve(sizes, demand, 256)
        assert (sum(c * p for c, p in out) == demand).all()
        assert all((p * sizes).sum() <= 256 for _, p in out)
        used, bound = sum(c for c, _ in out), (sizes * demand).sum() / 256
        if n >= 20_000:
            assert used <= 1.01 * bound + 2
    assert packing.solve(np.array([], int), np.array([], int), 256) == []


def test_equal_demands_end():
    sizes = np.arange(1, 257)
    out = packing.solve(sizes, np.full(256, 40), 256)
    assert (sum(c * p for c, p in out) == 40).all()
    assert sum(c for c, _ in out) <= 1.01 * (sizes * 40).sum() / 256


def test_ranks_and_json_give_the_same_ids(sample_docs):
    texts = [r.text for r in sample_docs.limit(40).collect()]
    texts += ["", " \n\n  x", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext", "é ü　z 12 'll", "a" * 3000, "\t" * 50, "x" + " \n" * 400_000 + "y"]
    fast, plain = tokens.encoder("byte_bpe_50k.tiktoken"), tokens.encoder("byte_bpe_50k.json")
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(fast(t) == plain(t) == made.encode(t, add_special_tokens=False).ids for t in texts)
    assert fast("a <|endoftext|> b") == [64, 220, 50256, 275]


def check(docs, rows, length=1024):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted([*made.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    assert sum(r.length for r in rows) == sum(map(len, want))
    return by_doc, by_sequence, want


def test_pack_equals_the_ids(make_docs, sample_docs):
    odd = [(10_000, ""), (10_004, "a <|endoftext|> b"), (10_001, None), (10_002, "x " * 5000), (10_003, "a b")]
    docs = sample_docs.select("doc_id", "text").union(make_docs(*odd).select("doc_id", "text"))
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence, _ = check(docs, rows)
    encode = tokens.encoder("byte_bpe_50k.json")
    for r in docs.collect():
        ids = np.array([*encode(r.text or ""), 0], "<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            own = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(own.tobytes()) and bytes(p.ids) == own.tobytes()
            at += p.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.02 * total / 1024 + 1


def test_odd_rows(make_docs):
    docs = make_docs((1, "a b"), (1, "a b"), (None, "c"), (None, None))
    docs = docs.withColumns({"length": docs.lang, "part": docs.lang, "size": docs.lang, "offset": docs.lang})
    rows = packing.pack(docs).collect()
    assert len(rows) == 4
    check(docs, rows)
    assert packing.pack(docs.limit(0)).count() == 0
    rows = packing.pack(make_docs((1, "a b c d e f g h i")), length=7).collect()
    check(make_docs((1, "a b c d e f g h i")), rows, 7)
