"""Repeated passages, found by difference-cover anchors.

A passage is a window of `size` consecutive words. Anchors are shorter windows that start
at positions whose number, modulo a period, is in a difference cover: for any two
positions there is a shift below the period that brings both into the cover. So two equal
passages always share an anchor at the same shift, and anchors at other positions need not
be looked at. Anchors that occur in one document only are dropped; around the others the
match is extended: the windows of `size` words that hold a shared anchor are compared by
96-bit hashes, and each learns whether a document with a smaller doc_id has it. Both parts
of such a hash are made of digests of words of their own, with a key that is drawn per run.

Both comparisons run alike. A task packs the hashes of its documents by part of the hash
range, so a row of the shuffle holds thousands of them. Parts have about `PART_BYTES` of text
each; beyond `FIRST_PARTS` of them, hashes are packed by groups of parts first and, a group in
one task, by part then, so that rows stay as full however many parts there are. What several documents of one
batch have in common is settled there, and one of them speaks for all, so a passage that
a third of all documents share is a few entries per batch and not one per document.

Defined results: a null or empty text has no words; rows with a null doc_id are left as
they are and take nothing from others; rows that share a doc_id count as one document, so
they take nothing from each other; an empty table gives an empty result. Other columns are
left alone, whatever they are called. doc_id is a whole number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tunetally.llm.words import Texts, binary_column, chunks, mix, new_key, window_hashes

SIZE = 13
#: Text bytes per part of the hash range.
PART_BYTES = 16 << 20
#: Parts, or groups of parts, that a task packs its hashes by.
FIRST_PARTS = 4_096
#: Tasks that compare parts, one part after another.
MAX_TASKS = 16_384
#: Bytes of entries that are held before they are packed by part.
REPACK_BYTES = 64 << 20
_U64 = np.uint64
PACKED = "part int, docs binary, counts binary, hashes binary, settled boolean"
FOUND = "bucket int, docs binary, counts binary, hashes binary"


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues."""
    for n in range(1, period + 1):
        for rest in combinations(range(1, period), n - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError(period)


def period_for(size: int) -> int:
    """The period with the fewest anchors that leaves anchors of half the passage."""
    return min(range(1, min(13, (size + 1) // 2) + 1), key=lambda p: (len(difference_cover(p)) / p, -p))


@dataclass(frozen=True)
class Layout:
    """How many parts the hash range has, and how many of them form a group."""

    parts: int
    group: int

    @property
    def grouped(self) -> bool:
        return self.group > 1

    @property
    def groups(self) -> int:
        return -(-self.parts // self.group)


def layout(text_bytes: int, least: int) -> Layout:
    """Parts of about `PART_BYTES` of text, `least` of them at least, in at most `FIRST_PARTS`
    groups."""
    parts = max(least, -(-text_bytes // PART_BYTES))
    return Layout(parts, -(-parts // FIRST_PARTS))


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, by its upper 24 bits."""
    return ((hashes >> _U64(40)) * _U64(parts) >> _U64(24)).astype(np.int64)


def _anchors(texts: Texts, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the anchors of each text, and their hashes."""
    period = period_for(size)
    short = size - period + 1
    at = texts.windows(short)
    inside = np.zeros(period, bool)
    inside[list(difference_cover(period))] = True
    at = at[inside[(at - texts.first_word[texts.text_of[at]]) % period]]
    return at, window_hashes(words, short, 21)[at] if len(at) else np.zeros(0, _U64)


def _keyed(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(docs.astype(_U64) + _U64(1)))


class _Known:
    """Hashes that were sent back for the documents of a bucket."""

    def __init__(self, found: pa.Table):
        docs = [np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<i4")) for d, c in _rows(found, "docs", "counts")]
        hashes = [np.frombuffer(h, _U64) for (h,) in _rows(found, "hashes")]
        none = [np.zeros(0, np.int64)]
        docs, hashes = np.concatenate(none + docs), np.concatenate([np.zeros(0, _U64), *hashes])
        self.keys = np.sort(_keyed(hashes, docs))

    def has(self, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), bool)
        keys = _keyed(hashes, docs)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)


def _by_document(docs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents of entries sorted by document, entries of each, and bounds."""
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, int)
    return docs[starts], np.diff(np.append(starts, len(docs))), np.append(starts, len(docs))


def _settled(docs: np.ndarray, hashes: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row with hashes that need no comparison any more."""
    order = np.argsort(docs, kind="stable")
    ids, counts, _ = _by_document(docs[order], hashes)
    part = int(ids[0]) % parts if len(ids) else 0
    return pa.RecordBatch.from_pylist(
        [
            {
                "part": part,
                "docs": ids.astype("<i8").tobytes(),
                "counts": counts.astype("<i4").tobytes(),
                "hashes": hashes[order].tobytes(),
                "settled": True,
            }
        ],
        PACKED_SCHEMA,
    )


PACKED_SCHEMA = pa.schema(
    [("part", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("settled", pa.bool_())]
)


FOUND_SCHEMA = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])


def _runs(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array and its stretch."""
    if not len(groups):
        return
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(groups)), strict=True):
        yield int(groups[a]), slice(a, b)


def _pack(docs: np.ndarray, hashes: np.ndarray, tails: np.ndarray, parts: int, group: int = 1) -> pa.RecordBatch:
    """One row per part (or group of parts): documents, entries of each, and the bytes of the
    entries."""
    part = _parts(hashes, parts) // group
    order = np.lexsort((docs, part))
    docs, tails, part = docs[order], tails[order], part[order]
    rows = {name: [] for name in PACKED_SCHEMA.names}
    for k, own in _runs(part):
        ids, counts, _ = _by_document(docs[own], tails[own])
        rows["part"].append(k)
        rows["docs"].append(ids.astype("<i8").tobytes())
        rows["counts"].append(counts.astype("<i4").tobytes())
        rows["hashes"].append(tails[own].tobytes())
        rows["settled"].append(False)
    return pa.RecordBatch.from_pydict(rows, PACKED_SCHEMA)


def _share_anchors(docs: DataFrame, size: int, plan: Layout, key: bytes) -> DataFrame:
    """The anchors of documents (doc_id, text) that other documents have as well, packed
    by bucket."""
    parts, first_width = plan.parts, 8 if plan.grouped else 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            found, owners = [], []
            for texts in chunks(batch.column(1)):
                at, hashes = _anchors(texts, texts.word_hashes(key=key), size)
                found.append(hashes)
                owners.append(ids[texts.first + texts.text_of[at]])
            hashes, owners = np.concatenate(found), np.concatenate(owners)
            order = np.lexsort((owners, hashes))
            hashes, owners = hashes[order], owners[order]
            fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))[: len(hashes)]
            hashes, owners = hashes[fresh], owners[fresh]
            first = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
            group = np.cumsum(first) - 1
            shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
            if shared.any():
                yield _settled(owners[shared], hashes[shared], parts)
            # An anchor that several documents share is sent twice, which tells the others.
            twice = first & shared
            hashes = np.concatenate([hashes[first], hashes[twice]])
            owners = np.concatenate([owners[first], owners[twice]])
            tails = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :first_width])
            if len(hashes):
                yield _pack(owners, hashes, tails, parts, plan.group)

    def meet(part: int, entries: np.ndarray) -> np.ndarray:
        keys = np.zeros((len(entries), 8), np.uint8)
        keys[:, :5] = entries
        keys = keys.view(_U64).ravel()
        ranked = np.sort(keys)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        at = np.minimum(np.searchsorted(twice, keys), max(len(twice) - 1, 0))
        return twice[at] == keys if len(twice) else np.zeros(len(keys), bool)

    return _exchange(docs.mapInArrow(run, PACKED), plan, 5, lambda part, docs, entries: meet(part, entries))


def _buckets(docs: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each document, by a hash of its doc_id."""
    return (mix(docs.astype(np.int64).view(_U64)) % _U64(buckets)).astype(np.int32)


def _exchange(docs: DataFrame, plan: Layout, width: int, decide: Callable) -> DataFrame:
    """Bring each part of the hash range together, let `decide` choose entries, and return
    the chosen hashes (their first 8 bytes, or what there is of them): rows of bucket,
    docs, counts, hashes, where a row holds what one part, or one task if parts are grouped,
    has for one bucket. A task holds one part at a time."""
    parts = plan.parts

    def unpacked(row: dict, entry: int) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["counts"], "<i4")
        return np.repeat(ids, counts), np.frombuffer(row["hashes"], np.uint8).reshape(-1, entry)

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group of parts to rows by part, whose entries have their full hash first."""
        held, size = [], 0
        for batch in batches:
            yield batch.filter(batch.column("settled"))
            for row in batch.filter(pc.invert(batch.column("settled"))).to_pylist():
                held.append(unpacked(row, max(width, 8)))
                size += len(row["hashes"])
                if size >= REPACK_BYTES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        owners, entries = (np.concatenate(x) for x in zip(*held, strict=True))
        hashes = np.ascontiguousarray(entries[:, :8]).view(_U64).ravel()
        return _pack(owners, hashes, np.ascontiguousarray(entries[:, :width]), parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["settled"]:
                    owners, entries = unpacked(row, 8)
                    yield found(owners, np.ascontiguousarray(entries).view(_U64).ravel())
                    continue
                if row["part"] != part and held:
                    yield chosen(part, held)
                    held = []
                part = row["part"]
                held.append(unpacked(row, width))
        if held:
            yield chosen(part, held)

    def chosen(part: int, held: list) -> pa.RecordBatch:
        owners, entries = (np.concatenate(x) for x in zip(*held, strict=True))
        picked = decide(part, owners, entries)
        keys = np.zeros((len(entries[picked]), 8), np.uint8)
        keys[:, : min(width, 8)] = entries[picked][:, :8]
        return found(owners[picked], keys.view(_U64).ravel())

    def found(owners: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        if width < 8:
            hashes = hashes & _U64((1 << 8 * width) - 1)
        return _for_buckets(owners, hashes, parts, plan.group)

    def refind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group of buckets to rows by bucket."""
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(unpacked(row, 8))
                size += len(row["hashes"])
                if size >= REPACK_BYTES:
                    yield refound(held)
                    held, size = [], 0
        if held:
            yield refound(held)

    def refound(held: list) -> pa.RecordBatch:
        owners, entries = (np.concatenate(x) for x in zip(*held, strict=True))
        return _for_buckets(owners, np.ascontiguousarray(entries).view(_U64).ravel(), parts)

    if plan.grouped:
        docs = docs.repartition(plan.groups, "part").mapInArrow(repack, PACKED)
    dealt = docs.repartition(min(parts, MAX_TASKS), "part").sortWithinPartitions("part")
    out = dealt.mapInArrow(meet, FOUND)
    return out.repartition(plan.groups, "bucket").mapInArrow(refind, FOUND) if plan.grouped else out


def _for_buckets(owners: np.ndarray, hashes: np.ndarray, buckets: int, group: int = 1) -> pa.RecordBatch:
    """One row per bucket of documents (or group of buckets)."""
    bucket = _buckets(owners, buckets) // group
    order = np.lexsort((owners, bucket))
    owners, hashes, bucket = owners[order], hashes[order], bucket[order]
    rows = {name: [] for name in FOUND_SCHEMA.names}
    for k, own in _runs(bucket):
        ids, counts, _ = _by_document(owners[own], hashes[own])
        rows["bucket"].append(k)
        rows["docs"].append(ids.astype("<i8").tobytes())
        rows["counts"].append(counts.astype("<i4").tobytes())
        rows["hashes"].append(hashes[own].tobytes())
    return pa.RecordBatch.from_pydict(rows, FOUND_SCHEMA)


def _squeezed(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """`docs` with the bucket of each row, and the text as compressed bytes, which is what
    the shuffles carry. Rows without a doc_id are dealt in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column(key_at)
            bucket = np.where(ids.is_valid().to_numpy(False), _buckets(_ids(ids), buckets), np.arange(len(ids)) % buckets)
            texts = [None if t is None else squeeze(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *columns], names=names)

    names, key_at, at = ["bucket", *docs.columns], docs.columns.index(key), docs.columns.index(text)
    kinds = [T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in docs.schema]
    return docs.mapInArrow(run, T.StructType([T.StructField("bucket", T.IntegerType()), *kinds]))


def _texts(column: pa.ChunkedArray) -> pa.Array:
    """Texts from compressed bytes; nulls are empty."""
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([b"" if t is None else expand(t) for t in column.to_pylist()], pa.large_binary())


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """doc_ids as numbers; nulls, which nothing is found for, are 0 and told apart elsewhere."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), 0))


def _earlier_windows(docs: DataFrame, anchors: DataFrame, size: int, plan: Layout, secret: bytes) -> DataFrame:
    """The windows of documents (bucket, doc_id, text) that a document with a smaller
    doc_id has as well, packed by bucket."""
    reach, parts = period_for(size), plan.parts
    mask = _U64((1 << 40) - 1)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(packed(rows, _Known(found))), PACKED_SCHEMA)

    def packed(rows: pa.Table, known: _Known) -> Iterator[pa.RecordBatch]:
        ids = _ids(rows.column("doc_id"))
        found, seconds, owners = [], [], []
        for texts in chunks(_texts(rows.column("text"))):
            words, second = texts.word_lanes(key=secret)
            at, hashes = _anchors(texts, words, size)
            at = at[known.has(hashes & mask, ids[texts.first + texts.text_of[at]])]
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(at - reach + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            windows = texts.windows(size)
            windows = windows[np.cumsum(near)[windows] > 0]
            if len(windows):
                found.append(window_hashes(words, size, 31)[windows])
                seconds.append(window_hashes(second, size, 32)[windows])
                owners.append(ids[texts.first + texts.text_of[windows]])
        if not found:
            return
        hashes, tails, owners = np.concatenate(found), np.concatenate(seconds) >> _U64(32), np.concatenate(owners)
        order = np.lexsort((owners, tails, hashes))
        hashes, tails, owners = hashes[order], tails[order], owners[order]
        first = np.append(True, (hashes[1:] != hashes[:-1]) | (tails[1:] != tails[:-1]))
        least = owners[np.flatnonzero(first)][np.cumsum(first) - 1]
        fresh = np.append(True, first[1:] | (owners[1:] != owners[:-1]))
        later = fresh & (owners > least)
        if later.any():
            yield _settled(owners[later], hashes[later], parts)
        entries = np.empty((int(first.sum()), 12), np.uint8)
        entries[:, :8] = hashes[first].view(np.uint8).reshape(-1, 8)
        entries[:, 8:] = tails[first].astype("<u4").view(np.uint8).reshape(-1, 4)
        yield _pack(owners[first], hashes[first], entries, parts, plan.group)

    def decide(part: int, owners: np.ndarray, entries: np.ndarray) -> np.ndarray:
        hashes = np.ascontiguousarray(entries[:, :8]).view(_U64).ravel()
        tails = np.ascontiguousarray(entries[:, 8:]).view("<u4").ravel()
        order = np.lexsort((owners, tails, hashes))
        hashes, tails, ranked = hashes[order], tails[order], owners[order]
        first = np.append(True, (hashes[1:] != hashes[:-1]) | (tails[1:] != tails[:-1]))
        return order[ranked > ranked[np.flatnonzero(first)][np.cumsum(first) - 1]]

    both = docs.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(run, PACKED)
    return _exchange(both, plan, 12, decide)


def _removed(texts: Texts, known: _Known, ids: pa.ChunkedArray, size: int, secret: bytes) -> np.ndarray:
    """Which words of the texts are in a window that an earlier document has."""
    words = texts.word_hashes(key=secret)
    windows = texts.windows(size)
    if not len(windows):
        return np.zeros(len(words), bool)
    rows = texts.first + texts.text_of[windows]
    hit = known.has(window_hashes(words, size, 31)[windows], _ids(ids)[rows])
    hit &= ids.is_valid().to_numpy()[rows]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, windows[hit], 1)
    np.add.at(edges, windows[hit] + size, -1)
    return np.cumsum(edges[:-1]) > 0


def _joined_words(texts: Texts, kept: np.ndarray) -> Iterator[bytes]:
    """The kept words of each text, joined by one space."""
    starts, sizes = texts.starts[kept], (texts.ends - texts.starts)[kept]
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    shift = np.repeat(starts - (ends - sizes - 1), sizes)
    places = np.arange(len(shift)) + np.repeat(np.arange(len(sizes)), sizes)
    out[places] = texts.data[places + shift]
    before = np.append(0, np.cumsum(kept))[texts.first_word]
    bounds = np.append(0, ends)[before]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield out[a : max(a, b - 1)].tobytes()


def _cut_texts(texts: Texts, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts without the removed words and the space after each."""
    next_start = np.append(texts.starts[1:], len(texts.data))
    stops = np.minimum(next_start, texts.bounds[texts.text_of + 1])
    edges = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(edges, texts.starts[removed], 1)
    np.add.at(edges, stops[removed], -1)
    kept = np.cumsum(edges[:-1]) == 0
    return texts.data[kept], np.append(0, np.cumsum(kept))[texts.bounds]


def _cogrouped(docs: DataFrame, size: int, secret: bytes):
    """`docs` with compressed texts by bucket, beside what was found for the bucket."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = layout(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = _squeezed(rows, "doc_id", "text", plan.parts)
    windows = _earlier_windows(bucketed, _share_anchors(rows, size, plan, secret), size, plan, secret)
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    squeezed = _squeezed(named, key, text, plan.parts)
    return squeezed.groupBy("bucket").cogroup(windows.groupBy("bucket"))


def removal_report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row doc_id, n_words, n_removed, and the SHA-256 of the kept words."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(reported(rows.combine_chunks(), _Known(found))), schema)

    def reported(rows: pa.Table, known: _Known) -> Iterator[pa.RecordBatch]:
        ids = rows.column("c0")
        for texts in chunks(_texts(rows.column("c1"))):
            removed = _removed(texts, known, ids, size, secret)
            sums = [hashlib.sha256(x).hexdigest() for x in _joined_words(texts, ~removed)]
            gone = np.bincount(texts.text_of[removed], minlength=texts.n)
            columns = [ids.slice(texts.first, texts.n).combine_chunks()]
            columns += [pa.array(x, pa.int64()) for x in (texts.n_words, gone)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.string())], schema=schema)

    secret, key = new_key(), docs.schema["doc_id"].dataType
    names = ["n_words", "n_removed"]
    schema = pa.schema([("doc_id", to_arrow_type(key)), *((n, pa.int64()) for n in names), ("kept_sha256", pa.string())])
    kind = f"doc_id {key.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return _cogrouped(docs.select("doc_id", "text"), size, secret).applyInArrow(run, kind)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of `docs` with the words removed from `text`; what is left keeps its white
    space. A document of which nothing is left stays, with an empty text. A null text
    stays null. `n_chars` is counted again where there is such a column."""
    secret, names = new_key(), docs.columns
    key, at = f"c{names.index('doc_id')}", names.index("text")

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows, known, parts = rows.combine_chunks(), _Known(found), []
        for texts in chunks(_texts(rows.column(f"c{at}"))):
            data, bounds = _cut_texts(texts, _removed(texts, known, rows.column(key), size, secret))
            parts.append(binary_column(data, bounds))
        text = pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())
        nulls = pc.is_null(rows.column(f"c{at}")).combine_chunks()
        text = pc.if_else(nulls, pa.scalar(None, pa.string()), text)
        rows = rows.drop_columns(["bucket"])
        return rows.set_column(at, f"c{at}", text)

    kinds = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)]
    out = _cogrouped(docs, size, secret).applyInArrow(run, T.StructType(kinds))
    out = out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(names)})
    if "n_chars" in names:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(n_chars, F.col("n_chars")))
    return out
