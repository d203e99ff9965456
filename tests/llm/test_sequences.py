import random

import numpy as np
from llm.conftest import words_of  # noqa: F401

from tunetally.llm import sequences as S
from tunetally.llm.tokens import encoder


def brute_best_fit(sizes, length):
    rooms, rows = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= sizes[k]]
        if fits:
            _, i = min(fits)
        else:
            i = len(rooms)
            rooms.append(length)
            rows.append([])
        rooms[i] -= sizes[k]
        rows[i].append(k)
    return sorted(rooms)


def test_best_fit_equals_a_search_over_all_rows():
    rng = random.Random(3)
    for n in (0, 1, 5, 200):
        for length in (7, 64, 100):
            sizes = [rng.randrange(1, length + 1) for _ in range(n)]
            rows = S.best_fit(sizes, length)
            assert sorted(k for row in rows for k in row) == list(range(n))
            assert sorted(length - sum(sizes[k] for k in row) for row in rows) == brute_best_fit(sizes, length)


def check(docs, rows, length, kind="<u2"):
    encode = encoder("byte_bpe_50k.json")
    found = []
    for r in rows:
        ids, ends = np.frombuffer(bytes(r.ids), kind), list(r.cu_seqlens)
        assert len(ids) == length and ends[0] == 0 and ends == sorted(ends) and ends[-1] <= length
        assert (ids[ends[-1] :] == S.PAD).all() and list(r.resets) == ends[:-1]
        for a, b, d, s in zip(ends[:-1], ends[1:], r.doc_ids, r.starts):
            found.append((str(d), s, ids[a:b].tolist()))
    whole = []
    for d, s, ids in sorted(found, key=lambda x: (x[0], x[1])):
        if s:
            assert whole[-1][0] == d and len(whole[-1][1]) == s
            whole[-1][1].extend(ids)
        else:
            whole.append((d, list(ids)))
    want = sorted((str(d.doc_id), [*encode(d.text or ""), 0]) for d in docs.collect())
    assert sorted(whole) == want
    assert len({r.row_id for r in rows}) == len(rows)


def test_no_id_is_lost(sample_docs, make_docs, monkeypatch):
    docs = sample_docs.select("doc_id", "text").union(make_docs((-1, ""), (-2, None), (None, "x y")).select("doc_id", "text"))
    rows = S.packed(docs).collect()
    check(docs, rows, S.LENGTH)
    used = sum(r.cu_seqlens[-1] for r in rows)
    assert used / (len(rows) * S.LENGTH) > 0.95
    small = docs.limit(20)
    monkeypatch.setattr(S, "BLOCK_TOKENS", 1000)
    check(small, S.packed(small, length=64, wide=True).collect(), 64, "<u4")
    assert S.packed(docs.limit(0)).count() == 0


def test_positions_start_again(spark):
    df = spark.createDataFrame([([0, 3, 5],), ([0, 1],)], "c array<int>")
    assert [list(r[0]) for r in df.select(S.position_ids(df.c)).collect()] == [[0, 1, 2, 0, 1], [0]]


def test_written_rows(spark, make_docs, tmp_path):
    docs = make_docs((1, "a b c"), (1, "a b c"))
    docs = docs.withColumns({"ids": docs.lang, "row_id": docs.lang})
    S.write_packed(docs, str(tmp_path / "x"), length=4)
    rows = spark.read.parquet(str(tmp_path / "x")).collect()
    assert sum(r.cu_seqlens[-1] for r in rows) == 8


def test_very_long_text(make_docs):
    long = "some words, 12 of them é\n" * 42_000
    docs = make_docs((1, long), (2, "a"), (3, "x y" * 10)).select("doc_id", "text")
    rows = S.packed(docs).collect()
    check(docs, rows, S.LENGTH)
    n_ids = len(encoder("byte_bpe_50k.json")(long)) + 1
    assert sum(1 in r.doc_ids for r in rows) == -(-n_ids // S.LENGTH)
