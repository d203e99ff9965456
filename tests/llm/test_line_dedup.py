import hashlib
import random

import numpy as np
import pytest

from tunetally.llm import line_dedup as L

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, min_chars=40, min_docs=5):
    """Per row (doc_id, lines, dropped, text that is left)."""
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(L.SPACE).translate(FOLD)
            if len(key) >= min_chars and doc_id is not None:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines, left = (text or "").split("\n"), []
        for line in lines:
            held = holders.get(line.strip(L.SPACE).translate(FOLD), ())
            if doc_id is None or len(held) < min_docs or doc_id == max(held):
                left.append(line)
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def check(docs, **kw):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, **kw)
    found = L.report(docs, **kw).collect()
    sums = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in want]
    assert sorted(map(str, sums)) == sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)) for r in found)
    assert all((r.keep_bitmap is None) == (r.n_dropped == 0) for r in found)
    cleaned = L.dedup_lines(docs, **kw)
    assert cleaned.columns == docs.columns
    texts = [(i, t if old is not None else None) for (i, _, _, t), (_, old) in zip(want, rows)]
    assert sorted(map(str, texts)) == sorted(str((r.doc_id, r.text)) for r in cleaned.select("doc_id", "text").collect())
    return want


def test_documents(sample_docs):
    assert sum(r[2] for r in check(sample_docs.repartition(7))) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(make_docs, spark, seed):
    rng = random.Random(seed)
    lines = [rng.choice("aBcé") * rng.randrange(36, 46) + rng.choice(["", " ", "\t"]) for _ in range(30)]
    rows = []
    for doc_id in rng.sample(range(-50, 400), 200):
        own = [rng.choice(lines) if rng.random() < 0.8 else "short" for _ in range(rng.randrange(12))]
        rows.append((doc_id, "\n".join(x.swapcase() if rng.random() < 0.3 else x for x in own)))
    check(make_docs(*rows).repartition(5))
    check(make_docs(*rows), min_chars=1, min_docs=2)


def test_hot_line_over_many_tasks(make_docs, spark):
    hot, warm = "h" * 50, "w" * 50
    rows = [(i, "\n".join([hot, f"own line {i}", hot] + [warm] * (i % 40 == 0))) for i in range(600)]
    docs = make_docs(*rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = L.dropped_lines(docs)
        assert ranged.count() == 599 * 2 + 14
        check(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("min_docs", [2, 5, 7])
@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_batches_and_tasks_do_not_matter(spark, min_docs, batch, make_docs):
    rng = random.Random(batch)
    rows = [(i, "\n".join(rng.choice(["x", "y", "z"]) * 45 for _ in range(rng.randrange(4)))) for i in range(60)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        check(make_docs(*rows), min_docs=min_docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_odd_rows(make_docs):
    line = "This line is long enough to be looked at by the operator."
    docs = make_docs(
        *((i, f"{line}\nown {i}\n\n{line.upper()}  ") for i in range(4)),
        (4, line), (4, line), (4, f"other\r\n\x0b{line}\r"), (5, None), (6, ""), (7, "\n\n"), (None, line), (None, None),
    )
    names = ("copy", "keep", "pos", "h1", "c0", "places", "task")
    docs = docs.withColumns({c: docs.lang for c in names})
    check(docs)
    assert L.report(docs.limit(0)).count() == 0 and L.dedup_lines(docs.limit(0)).count() == 0


def test_very_long_text(make_docs):
    shared = [f"{k:05d} " + "shared line of a template" * 2 for k in range(25_000)]
    text = "\n".join(shared)
    assert len(text) > 1_000_000
    want = check(make_docs(*((i, text + f"\nown {i}") for i in range(5)), (9, shared[7])))
    assert [r[2] for r in want] == [25_000] * 4 + [1, 0]


def test_bitmaps_come_back():
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 1000):
        places = np.array(sorted(rng.sample(range(n), rng.randrange(1, n + 1))))
        keep = L.keeps(L.bitmap(places), n + 20)
        assert (np.flatnonzero(~keep) == places).all() and len(keep) == n + 20
    assert len(L.bitmap(np.arange(100_000))) < 200
    assert L.keeps(None, 3).all()
