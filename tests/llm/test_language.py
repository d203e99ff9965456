import zlib

import numpy as np
import pyarrow as pa

from tunetally.llm import language as L


def slow_answers(net, window):
    """Filters over one window as loops."""
    out = []
    for width, table in zip(L.WIDTHS, net.tables):
        for f in range(L.FILTERS):
            out.append(max(sum(table[k][window[p + k], f] for k in range(width)) for p in range(L.WINDOW - width + 1)))
    return np.array(out) + net.bias


def test_prediction_equals_loops():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, L.N_CLASSES, (40, L.WINDOW))
    labels = ["a" if w[0] % 2 else "b" for w in windows]
    net = L.train(windows, labels)
    hidden = np.maximum(np.array([slow_answers(net, w) for w in windows[:5]]), 0)
    want = L.softmax(hidden @ net.weights + net.offset)
    assert np.allclose(L.Predictor(net).windows(windows[:5]), want, atol=1e-4)


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in L.identified(docs).collect()}
    good = held = 0
    for d in docs.collect():
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            held += 1
            good += r.lang_pred == d.lang
    assert held > 150 and good / held > 0.93


def test_labels_of_held_out_rows_and_sources_are_not_used(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r.doc_id: tuple(r) for r in L.identified(docs).collect()}
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end lang", "'q' source")
    assert {r.doc_id: tuple(r) for r in L.identified(changed).collect()} == first


def test_odd_texts(spark, make_docs):
    docs = make_docs(*[(k, "the cat and the dog of it " * 9, "en") for k in range(8)], *[(k + 10, "der hund und die katze ist " * 9, "de") for k in range(8)])
    odd = make_docs((None, "the dog"), (101, None), (102, ""), (103, "12 !?"), (104, "Ж"), (105, "x" * 5000), (106, "the of", None))
    odd = odd.withColumns({"held_out": odd.lang, "score": odd.lang})
    net = L.fit(docs)
    rows = {r.doc_id: r for r in L.predicted(odd, net).collect()}
    assert rows[101].lang_pred == rows[102].lang_pred == rows[103].lang_pred == "und" and rows[103].score == 0
    assert rows[104].lang_pred in ("de", "en") and rows[105].lang_pred in ("de", "en")
    assert rows[None].held_out is False
    assert L.identified(odd.limit(0)).count() == 0
    nothing = L.fit(odd.where("doc_id = 106"))
    assert [r.lang_pred for r in L.predicted(odd.where("doc_id = 106"), nothing).collect()] == ["und"]


def test_whole_text_counts():
    rng = np.random.default_rng(0)
    a, b = rng.integers(97, 110, 4000), rng.integers(110, 123, 4000)
    windows = np.concatenate([L.tiled(bytes(x.astype(np.uint8))) for x in (a, b)])
    net = L.train(windows, ["a"] * (len(windows) // 2) + ["b"] * (len(windows) // 2))
    text = bytes(np.concatenate([a[:300], b]).astype(np.uint8)).decode()
    langs, scores = L.Predictor(net).texts(pa.array([text, None]))
    assert langs == ["b", "und"] and scores[0] > 0.6


def test_training_follows_the_numeric_gradient(monkeypatch):
    """The first step of every parameter goes against the slope of the loss, measured by
    moving that parameter alone."""
    rng = np.random.default_rng(5)
    windows = rng.integers(0, L.N_CLASSES, (12, L.WINDOW))
    labels = ["a"] * 3 + ["b"] * 4 + ["c"] * 5
    y = np.searchsorted(["a", "b", "c"], labels)
    balance = len(y) / (3 * np.bincount(y))
    monkeypatch.setattr(L, "BATCH", len(y))
    monkeypatch.setattr(L, "EPOCHS", 0)
    start = L.train(windows, labels)
    monkeypatch.setattr(L, "EPOCHS", 1)
    moved = L.train(windows, labels)

    def loss():
        top, _ = L._answers(start, windows)
        chances = L.softmax(np.maximum(top, 0) @ start.weights + start.offset)
        return float((balance[y] * -np.log(chances[np.arange(len(y)), y])).mean())

    seen = 0
    for p, q in zip([*start.tables, start.bias, start.weights, start.offset], [*moved.tables, moved.bias, moved.weights, moved.offset]):
        touched = np.flatnonzero(p.ravel() != q.ravel())
        untouched = np.flatnonzero(p.ravel() == q.ravel())
        flat = p.reshape(-1)
        for k in [*rng.permutation(touched)[:40], *rng.permutation(untouched)[:10]]:
            own, eps = flat[k], 1e-6
            flat[k] = own + eps
            high = loss()
            flat[k] = own - eps
            low = loss()
            flat[k] = own
            slope = (high - low) / (2 * eps)
            if abs(slope) > 1e-5:
                assert np.sign(q.reshape(-1)[k] - own) == -np.sign(slope)
                seen += 1
    assert seen > 100


def test_a_very_long_text_counts_whole(make_docs):
    docs = make_docs(*[(k, "the cat and the dog of it " * 9, "en") for k in range(8)], *[(k + 10, "der hund und die katze ist " * 9, "de") for k in range(8)])
    net = L.fit(docs)
    long = "the cat of it " * 20_000 + "der hund und die katze " * 40_000
    assert len(long) > 1_000_000
    row = L.predicted(make_docs((1, long)), net).first()
    assert row.lang_pred == "de" and 0.5 < row.score < 0.9
