"""Lines that many documents share, dropped by keep bitmaps.

The key of a line is the line without white space at its ends, A-Z lower-cased. Keys of
`MIN_CHARS` code points and more are hashed (128 bits of BLAKE2b). The rows (hash, document,
position) are partitioned by ranges of all three and sorted within, so the rows of one key
stand together, largest document first, and a key that a third of all documents hold is
spread over as many tasks as its rows fill. A task streams its rows: the first document of
a key keeps its lines, and once `MIN_DOCS` documents are seen the others lose theirs. Only
the first and the last key of a task may go on in another one; a row per such key (two per
task) tells how many documents it has there, and what was open is settled by these.

What comes back is a compressed bitmap per document that loses a line, not its text.

Defined results: a null or empty text is one empty line. Rows with a null doc_id keep all
lines and do not count as documents. Rows that share a doc_id are one document, so the rows
of the largest doc_id all keep a line; equal rows get equal results. An empty table gives an
empty result. Other columns are left alone, whatever they are called. doc_id is a whole
number.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc_id long, copy binary, pos int"
MARKED = "doc_id long, copy binary, pos int, h1 long, h2 long, task int, n_docs long, last_doc long"
_MARKED = pa.schema([
    ("doc_id", pa.int64()), ("copy", pa.binary()), ("pos", pa.int32()), ("h1", pa.int64()),
    ("h2", pa.int64()), ("task", pa.int32()), ("n_docs", pa.int64()), ("last_doc", pa.int64()),
])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, copy (128 bits of the text's SHA-256) and text of every row; rows of one
    doc_id and copy are equal in both."""
    text = F.coalesce("text", F.lit(""))
    copy = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy"), text.alias("text"))


def _keyed(min_chars: int):
    """Batches of (doc_id, copy, text) to the hashes of their lines with long keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                if len(text) < min_chars:
                    continue
                for place, line in enumerate(text.split("\n")):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars:
                        digests.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest())
                        rows.append(row)
                        places.append(place)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
                    batch.column(0).take(pa.array(rows, pa.int32())),
                    batch.column(1).take(pa.array(rows, pa.int32())).cast(pa.binary()),
                    pa.array(places, pa.int32()),
                ],
                names=["h1", "h2", "doc_id", "copy", "pos"],
            )

    return run


def _marks(batch: pa.RecordBatch, mask: np.ndarray | None = None, keyed: bool = False) -> pa.RecordBatch:
    """Rows of `LINES` as rows of `MARKED`: dropped ones, or with their key open ones."""
    if mask is not None:
        batch = batch.filter(pa.array(mask))
    n = batch.num_rows
    key = [batch.column(0), batch.column(1)] if keyed else [pa.nulls(n, pa.int64())] * 2
    rest = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*batch.columns[2:], *key, *rest], schema=_MARKED)


class _Run:
    """The rows of one key in a task, of which more may come."""

    def __init__(self, key: tuple[int, int], first: bool, min_docs: int):
        self.key, self.first, self.min_docs = key, first, min_docs
        self.n_docs, self.top, self.last = 0, None, None
        self.held: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """More rows. Those of the first key of a task stay open, as it may have begun in
        the task before; others are held while too few documents are seen."""
        if self.top is None:
            self.top = int(doc[0])
        self.n_docs += int(np.count_nonzero(doc[1:] != doc[:-1])) + (self.last != int(doc[0]))
        self.last = int(doc[-1])
        if self.first:
            yield _marks(batch, keyed=True)
        elif self.n_docs < self.min_docs:
            self.held.append(batch)
        else:
            for part in [*self.held, batch]:
                yield _marks(part, part.column(2).to_numpy() != self.top)
            self.held = []

    def edge(self, task: int) -> Iterator[pa.RecordBatch]:
        for part in self.held:
            yield _marks(part, keyed=True)
        row = [self.top, None, None, *self.key, task, self.n_docs, self.last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(row, _MARKED, strict=True)], schema=_MARKED
        )


def _streamed(min_docs: int):
    """Sorted batches of `LINES` to the lines that go, open lines, and edges of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, open_run = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
            fresh = np.ones(len(h1), bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if open_run is None:
                open_run = _Run((int(h1[0]), int(h2[0])), True, min_docs)
            fresh[0] = open_run.key != (h1[0], h2[0])
            starts = np.flatnonzero(fresh)
            cut = int(starts[0]) if len(starts) else len(h1)
            if cut:
                yield from open_run.add(batch.slice(0, cut), doc[:cut])
            if not len(starts):
                continue
            if open_run.first:
                yield from open_run.edge(task)
            last = int(starts[-1])
            if last > cut:
                whole, begins = batch.slice(cut, last - cut), starts[:-1] - cut
                own = doc[cut:last]
                change = np.ones(len(own), bool)
                change[1:] = own[1:] != own[:-1]
                change[begins] = True
                run_of = np.cumsum(fresh[cut:last]) - 1
                n_docs = np.add.reduceat(change.astype(np.int64), begins)
                goes = (n_docs[run_of] >= min_docs) & (own != own[begins][run_of])
                if goes.any():
                    yield _marks(whole, goes)
            open_run = _Run((int(h1[last]), int(h2[last])), False, min_docs)
            yield from open_run.add(batch.slice(last), doc[last:])
        if open_run is not None:
            yield from open_run.edge(task)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, copy and position of every line that goes."""
    rows = identified(docs).where(F.col("doc_id").isNotNull())
    lines = materialize(rows.mapInArrow(_keyed(min_chars), LINES), "lines")
    order = ["h1", "h2", F.desc("doc_id"), "copy", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(ranged.mapInArrow(_streamed(min_docs), MARKED), "marked_lines")
    # Two rows per task at most: how many documents an edge key has, and the largest.
    before = F.lag("last_doc").over(Window.partitionBy("h1", "h2").orderBy("task"))
    edges = marked.where("task is not null").withColumn("again", (before == F.col("doc_id")).cast("int"))
    verdicts = edges.groupBy("h1", "h2").agg(
        (F.sum("n_docs") - F.sum(F.coalesce("again", F.lit(0)))).alias("docs"), F.max("doc_id").alias("top")
    )
    shared = verdicts.where(F.col("docs") >= min_docs).select("h1", "h2", "top")
    still_open = marked.where("task is null and h1 is not null").drop("task", "n_docs", "last_doc")
    settled = still_open.join(F.broadcast(shared), ["h1", "h2"]).where("doc_id <> top")
    sure = marked.where("task is null and h1 is null")
    return sure.select("doc_id", "copy", "pos").union(settled.select("doc_id", "copy", "pos"))


def bitmap(places: np.ndarray) -> bytes:
    """Compressed keep bits of a document up to its last dropped line; later lines stay, so
    the bits that fill the last byte up are 1."""
    keep = np.ones(-(-(int(places.max()) + 1) // 8) * 8, bool)
    keep[places] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def keeps(packed: bytes | None, n_lines: int) -> np.ndarray:
    """Which of `n_lines` lines stay by a bitmap; all without one."""
    out = np.ones(n_lines, bool)
    if packed is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[:n_lines]
        out[: len(bits)] = bits
    return out


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, copy and keep bitmap of every document that loses a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bitmap(np.asarray(places)) for places in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keep, pa.binary())], names=["doc_id", "copy", "keep"]
            )

    dropped = dropped_lines(docs, min_chars, min_docs)
    places = dropped.groupBy("doc_id", "copy").agg(F.collect_list("pos").alias("places"))
    return places.mapInArrow(run, "doc_id long, copy binary, keep binary")


def _kept(text: str, packed: bytes | None) -> tuple[str, int, int]:
    """The lines of a text that stay, joined again, their former and their dropped number."""
    if packed is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    stay = keeps(packed, len(lines))
    return "\n".join(x for x, k in zip(lines, stay.tolist(), strict=True) if k), len(lines), int((~stay).sum())


def report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row doc_id, n_lines, n_dropped, the SHA-256 of the text left, and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, packed = batch.column(1).to_pylist(), batch.column(2)
            found = [_kept(t, p) for t, p in zip(texts, packed.to_pylist(), strict=True)]
            sums = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([n for _, _, n in found], pa.int64()), pa.array(sums, pa.string()), packed,
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"],
            )

    both = identified(docs).join(keep_bitmaps(docs, min_chars, min_docs), ["doc_id", "copy"], "left")
    kind = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary"
    return both.select("doc_id", "text", "keep").mapInArrow(run, kind)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of `docs` with the dropped lines gone from `text`. A null text stays null,
    and `n_chars` is counted again where there is such a column."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, packed = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            kept = [t if p is None else _kept(t, p)[0] for t, p in zip(texts, packed, strict=True)]
            columns = [pa.array(kept, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    text = F.coalesce("text", F.lit(""))
    copy = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    rows = docs.select(*columns, F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy"))
    both = rows.join(keep_bitmaps(docs, min_chars, min_docs), ["doc_id", "copy"], "left")
    both = both.select(*(f"c{k}" for k in range(len(names))), "keep")
    kinds = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])
    out = both.mapInArrow(run, kinds).withColumnsRenamed({f"c{k}": c for k, c in enumerate(names)})
    if "n_chars" in names:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(n_chars, F.col("n_chars")))
    return out
