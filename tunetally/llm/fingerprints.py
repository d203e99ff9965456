"""Bottom-k sketches of word shingles as fingerprints of documents.

A sketch holds the `K` smallest shingle hashes of a text (upper 32 bits, sorted), or all of
them if there are fewer. Sketches of parts merge to the sketch of the whole, and two
sketches estimate resemblance, containment and the number of distinct shingles.

Defined results: a null or empty text and one without words has the empty sketch, whose
fingerprint is the empty string; two empty sketches have resemblance 1, an empty and a
full one 0. In the order of documents null doc_ids come last and rows that share a doc_id
are ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunetally.llm.words import binary_column, chunks, shingle_sets
from tunetally.session import materialize

SHINGLE = 5
K = 64
_SPACE = float(1 << 32)


def sketches(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of every text of a string column."""
    out = []
    for texts in chunks(column):
        hashes, bounds = shingle_sets(texts, shingle, fold=True)
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            out.append(np.unique(hashes[a:b][: K + 8])[:K])
    return out


def merge(*parts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:K]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all: of the smallest hashes of the union,
    those that both have."""
    union = merge(a, b)
    if not len(union):
        return 1.0
    return float(np.isin(union, a).astype(bool)[np.isin(union, b)].sum() / len(union))


def distinct(a: np.ndarray) -> float:
    """Estimated number of distinct shingles; exact below K."""
    return float(len(a)) if len(a) < K else (K - 1) * _SPACE / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of `a` that `b` has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b) * distinct(merge(a, b)) / distinct(a))


def packed(parts: list[np.ndarray]) -> pa.Array:
    """Sketches as a binary column, big-endian, so that bytes sort like numbers."""
    bounds = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return binary_column(flat.astype(">u4"), bounds)


def unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, ">u4").astype(np.uint32)


def fingerprint(sketch: Column) -> Column:
    return F.lower(F.hex(sketch))


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed(sketches(batch.column(1), shingle))], names=["doc_id", "sketch"]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, sketch binary")


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """One sketch per group of rows with a `sketch`.

    Hashes are ranked within the group and cut at K before and after the shuffle, so a
    group of any size sends K hashes per task.
    """
    starts = F.sequence(F.lit(1), F.octet_length("sketch") - 3, F.lit(4))
    words = F.transform(starts, lambda k: F.substring("sketch", k, 4))
    full = parts.where(F.octet_length("sketch") > 0).select(*keys, F.explode(words).alias("h"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    least = full.distinct().withColumn("rank", rank).where(F.col("rank") <= K)
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("h")), F.hex), ""))
    groups = parts.select(*keys).distinct()
    found = least.groupBy(*keys).agg(joined.alias("sketch"))
    same = [groups[k].eqNullSafe(found[k]) for k in keys]
    out = groups.join(found, same, "left")
    return out.select(*(groups[k] for k in keys), F.coalesce(found["sketch"], F.unhex(F.lit(""))).alias("sketch"))


def edited(text: str, following: str) -> str:
    """`text` with its second half replaced by the beginning of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = (
    "doc_id {key}, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary,"
    " near_edited double, near_next double"
)
NAMES = ["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next"]


def _compared(ids: pa.Array, texts: list[str], following: list[str], own: list, after: list) -> list[pa.Array]:
    """The columns `NAMES` for texts, the texts after them, and the sketches of both."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new = sketches(pa.array(changed, pa.string()))
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        packed(own),
        packed(new),
        pa.array([resemblance(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
        pa.array([resemblance(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
    ]


def beside_next(docs: DataFrame) -> DataFrame:
    """Every document with the fingerprints of its text and of its edited text, and its
    likeness to that text and to the next document (descending doc_id, then round).

    Documents are dealt by ranges, so most find the next one in their task. What is at the
    edge of a task, two documents per task, is written and matched in a second step.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    rows = rows.repartitionByRange(order).sortWithinPartitions(order, F.desc("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids, texts = part.column(0), part.column(1)
                found = texts.to_pylist(), sketches(texts)
                if held is None:
                    yield edge(ids.slice(0, 1), found[0][0], "first", task)
                else:
                    ids = pa.concat_arrays([held[0], ids])
                    found = held[1] + found[0], held[2] + found[1]
                columns = _compared(ids.slice(0, len(ids) - 1), found[0][:-1], found[0][1:], found[1][:-1], found[1][1:])
                n = len(ids) - 1
                rest = [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *rest], names=names)
                held = ids.slice(n), found[0][n:], found[1][n:]
        if held is not None:
            yield edge(held[0], held[1][0], "last", task)

    def edge(ids: pa.Array, text: str, side: str, task: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        own = [pa.array([text]), pa.array([side]), pa.array([task], pa.int32())]
        return pa.RecordBatch.from_arrays([ids, *(pa.nulls(1, k) for k in kinds), *own], names=names)

    names = [*NAMES, "text", "side", "task"]
    walked = materialize(rows.mapInArrow(walk, FIELDS.format(key=key) + ", text string, side string, task int"), "fingerprints")
    tasks = [r["task"] for r in walked.where("side = 'first'").select("task").orderBy("task").collect()]
    after = list(zip(tasks, tasks[1:] + tasks[:1], strict=True))  # one pair per task, not per document
    after = docs.sparkSession.createDataFrame(after, "task int, next_task int")
    lasts = walked.where("side = 'last'").select("doc_id", "text", "task").join(after, "task")
    firsts = walked.where("side = 'first'").select(F.col("task").alias("next_task"), F.col("text").alias("following"))

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column(1), batch.column(2)
            columns = _compared(batch.column(0), texts.to_pylist(), following.to_pylist(), sketches(texts), sketches(following))
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    edges = lasts.join(firsts, "next_task").select("doc_id", "text", "following")
    out = walked.where("side is null").select(*NAMES).union(edges.mapInArrow(join_edges, FIELDS.format(key=key)))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
