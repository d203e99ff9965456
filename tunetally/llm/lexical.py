"""Ranked lexical search: accumulators of short lists as one iterator among long lists.

Terms are runs of letters and digits of ASCII and of all other characters beyond it, A-Z
lower-cased. Queries are read in blocks of bounded size. Per block, one pass over the
documents writes segments of an inverted index of the block's terms, with exact words as
keys, and counts documents, terms and document frequencies. Term weights follow from these
counts, and a second pass searches each segment:

* the short lists of a query are summed term at a time into accumulators, a list of its own
  with one bound;
* accumulators and long lists are then read document at a time, block of documents by block.
  Blocks whose bounds cannot reach the k-th best score so far are skipped, and in the others
  only iterators that are needed to reach it name candidates; the lists below are probed
  for the candidates that can still reach it.

Scores are whole numbers and bounds are never below them, so the result is exact. Ties go to
the smaller doc_id. A task keeps k documents per query and sends them on; no query's
documents meet anywhere but in that ranking of k rows per task.

Defined results: a null or empty text, and one without terms, counts as no document and is
never found. Rows that share a doc_id are documents of their own and may both be ranked; a
null doc_id comes last among equal scores. Equal query rows count once; rows that share an
item_id with different texts are ranked apart, each from 1. A query without terms, an empty
table of documents or of queries give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.session import materialize

K = 50
#: Characters of queries that are answered in one pass over the documents.
BLOCK_CHARS = 4 << 20
#: Documents and postings of an index segment at most (a document is never split).
SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 2_000_000
#: Documents of a block, whose bounds are kept per long list.
SPAN = 1024
#: A list is short if it has at most this share of the segment's documents.
SHORT = 16
SEGMENT = (
    "ids array<long>, sizes binary, terms array<int>, counts array<int>, docs binary, tfs binary,"
    " n_docs long, n_terms long"
)
_SEGMENT = pa.schema([
    ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("terms", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary()),
    ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])

_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or c in _ALNUM else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8. Bytes of characters beyond ASCII are all term bytes."""
    return (text or "").encode().translate(_TERM_BYTES).split()


class _Segment:
    """Postings of some documents while they are gathered."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[int] = []
        self.docs: list[int] = []
        self.tfs: list[int] = []
        self.n_docs = self.n_terms = 0

    def add(self, doc_id: int | None, words: list[bytes], number: dict[bytes, int]) -> None:
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        counts = Counter(words)
        shared = counts.keys() & number.keys()
        if shared:
            self.terms.extend(map(number.__getitem__, shared))
            self.tfs.extend(map(counts.__getitem__, shared))
            self.docs.extend([len(self.ids)] * len(shared))
            self.ids.append(doc_id)
            self.sizes.append(len(words))

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.docs) >= SEGMENT_POSTINGS

    def row(self) -> pa.RecordBatch:
        terms, docs, tfs = (np.array(x, np.int32) for x in (self.terms, self.docs, self.tfs))
        order = np.lexsort((docs, terms))
        found, counts = np.unique(terms, return_counts=True)
        values = [
            self.ids, np.array(self.sizes, np.int32).tobytes(), found.tolist(), counts.tolist(),
            docs[order].tobytes(), tfs[order].tobytes(), self.n_docs, self.n_terms,
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, _SEGMENT, strict=True)], schema=_SEGMENT
        )


def segments(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """An inverted index of `vocabulary` over the documents, one row per segment: documents
    with a term of it, their sizes, and the postings by term and document."""
    number = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment.add(doc_id, terms_of(text), number.value)
                if segment.full():
                    yield segment.row()
                    segment = _Segment()
        if segment.n_docs:
            yield segment.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEGMENT)


def weights(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Number of documents and of their terms, and the weight of every term."""
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = n or 0, total or 0
    df = np.zeros(n_terms, np.int64)
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms")
    for term, count in each.agg(F.sum("x.counts")).toLocalIterator():  # one row per query term
        df[term] = count
    return n, total, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class _Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids, unnamed = np.concatenate([self.ids, ids]), np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


class _Lists:
    """The lists of a segment with the share each posting adds to a score."""

    def __init__(self, row: dict[str, Any], n: int, total: int, weight: np.ndarray):
        self.unnamed = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.terms = np.array(row["terms"], np.int64)
        counts = np.array(row["counts"], np.int64)
        self.bounds = np.append(0, np.cumsum(counts))
        self.docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        size = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        m = 50 + (50 * size * n) // total
        share = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs])
        self.share = np.repeat(weight[self.terms], counts) * share
        self.most = np.maximum.reduceat(self.share, self.bounds[:-1]) if len(self.docs) else counts
        self.n_spans = -(-len(self.ids) // SPAN)
        self.short = counts * SHORT <= len(self.ids)
        self.place = np.full(len(weight), -1)
        self.place[self.terms] = np.arange(len(self.terms))
        # Bounds of the long lists per span of documents.
        self.row_of = np.cumsum(~self.short) - 1
        long = np.repeat(~self.short, counts)
        cell = np.repeat(self.row_of, counts)[long] * self.n_spans + self.docs[long] // SPAN
        self.span_most = _most_of(cell, self.share[long], int((~self.short).sum()) * self.n_spans)
        self.span_most = self.span_most.reshape(-1, self.n_spans)

    def list_of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[k], self.bounds[k + 1]
        return self.docs[a:b], self.share[a:b]

    def summed(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Accumulators: the documents of some lists with the sums of their shares."""
        docs = np.concatenate([self.docs[self.bounds[k] : self.bounds[k + 1]] for k in places])
        share = np.concatenate([self.share[self.bounds[k] : self.bounds[k + 1]] for k in places])
        order = np.argsort(docs, kind="stable")
        docs, share = docs[order], share[order]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        return docs[first], np.add.reduceat(share, first)


def _most_of(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each of n cells; cells come in order."""
    out = np.zeros(n, np.int64)
    if len(cells):
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        out[cells[first]] = np.maximum.reduceat(values, first)
    return out


def _search(lists: _Lists, terms: np.ndarray, best: _Best) -> None:
    """Offer the documents of a segment that can be among the best of a query."""
    places = lists.place[terms]
    places = places[places >= 0]
    places = places[lists.most[places] > 0]
    short = places[lists.short[places]]
    long = places[~lists.short[places]]
    # Iterators: (bound, documents, shares, bounds per span), the largest bound first.
    streams = [(int(lists.most[k]), *lists.list_of(k), lists.span_most[lists.row_of[k]]) for k in long]
    if len(short):
        docs, share = lists.summed(short)
        spans = _most_of(docs // SPAN, share, lists.n_spans)
        streams.append((int(share.max()), docs, share, spans))
    if not streams:
        return
    streams.sort(key=lambda s: -s[0])
    # rest[j]: what the iterators from j on can add.
    rest = np.append(np.cumsum([s[0] for s in streams][::-1])[::-1], 0)
    reach = np.sum([s[3] for s in streams], axis=0)
    order = np.argsort(-reach, kind="stable")
    at, width = 0, 1
    while at < len(order) and reach[order[at]] >= best.floor:
        spans = np.sort(order[at : at + width])
        spans = spans[reach[spans] >= best.floor]
        at, width = at + width, width * 2
        for a, b in _joined(spans):
            _score(lists, streams, rest, a * SPAN, min(b * SPAN, len(lists.ids)), best)


def _joined(spans: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring spans as ranges (end exclusive)."""
    cut = np.flatnonzero(np.diff(spans) > 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(spans, cut)]


def _score(lists: _Lists, streams: list, rest: np.ndarray, low: int, high: int, best: _Best) -> None:
    """Documents low to high, one after another as far as their bounds allow."""
    needed = int((rest >= best.floor).sum())  # iterators that may name a candidate
    sums = np.zeros(high - low, np.int64)
    for _, docs, share, _ in streams[:needed]:
        a, b = np.searchsorted(docs, (low, high))
        sums[docs[a:b] - low] += share[a:b]
    found = np.flatnonzero((sums > 0) & (sums + rest[needed] >= best.floor))
    sums = sums[found]
    found += low
    for j in range(needed, len(streams)):
        if not len(found):
            return
        _, docs, share, _ = streams[j]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        sums = sums + np.where(docs[at] == found, share[at], 0)
        able = sums + rest[j + 1] >= best.floor
        found, sums = found[able], sums[able]
    if len(found):
        best.add(sums, lists.ids[found], lists.unnamed[found])


def _blocks(items: DataFrame) -> Iterator[list]:
    """Queries as lists of rows, about `BLOCK_CHARS` characters at a time."""
    block, chars = [], 0
    for row in items.toLocalIterator():
        if block and chars + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(row)
        chars += len(row["text"]) + 64
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    queries = items.select("item_id", "text").distinct().where(F.col("text").isNotNull())
    out = None
    for block in _blocks(queries):
        found = _ranked_block(docs, items.schema["item_id"].dataType, block, k)
        out = found if out is None else out.union(found)
    if out is None:
        key = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {key}, rank int, doc_id long, score long")
    return out


def _ranked_block(docs: DataFrame, key: T.DataType, block: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    queries = [sorted(set(terms_of(row["text"]))) for row in block]
    vocabulary = sorted({w for q in queries for w in q})
    number = {w: i for i, w in enumerate(vocabulary)}
    wanted = [np.array([number[w] for w in q], np.int64) for q in queries]
    index = materialize(segments(docs, vocabulary), "segments")
    n, total, weight = weights(index, len(vocabulary))
    shared = spark.sparkContext.broadcast((wanted, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        best = [_Best(k) for _ in wanted]
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if not row["ids"]:
                    continue
                lists = _Lists(row, n, total, weight)
                for terms, top in zip(wanted, best, strict=True):
                    _search(lists, terms, top)
        for item, top in enumerate(best):
            if len(top.scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(top.scores), item, np.int32)),
                        pa.array(top.ids, mask=top.unnamed), pa.array(top.scores),
                    ],
                    names=["item", "doc_id", "score"],
                )

    found = index.drop("n_docs", "n_terms").mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kinds = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", key)])
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], kinds)
    # At most one row per query of the block.
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
