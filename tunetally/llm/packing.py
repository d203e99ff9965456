"""Packing of documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of a whole sequence each and one shorter rest. Only
the histogram of piece lengths, in steps of `GRAIN` and so of a fixed number of bins, comes
to the driver. There a linear program over patterns (how many pieces of each length one
sequence holds) is solved by column generation: a revised simplex keeps the basis, and a
knapsack by dynamic programming finds the pattern that improves it most. Patterns are used
as often as the solution says, rounded down; the few pieces left over, bounded by the
number of bins, get patterns of their own. On the cluster, the pieces of a length are
ranked, and a rank says which copy of which pattern a piece goes to.

Ranks come from a row number within each written file part and running counts over the
parts, so no length, however frequent, meets in one task.

Defined results: a null or empty text is one piece with the end id only; a null doc_id is
a document like any other; rows that repeat are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunetally.llm.tokens import END_ID, ids_of
from tunetally.session import materialize

LENGTH = 1024
GRAIN = 4
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Column generation ends when the bound shows that no more than this share can be won.
GAP = 2e-4
MAX_STEPS = 20_000
_RANK_BITS = 44

PIECES = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with `with_ids` also their ids, little-endian 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                yield pieces(batch.slice(first, 256))

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, sizes, sums, totals, parts = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1)):
            ids = ids_of(text.as_py(), tokenizer)
            for start in range(0, len(ids), length):
                own = ids[start : start + length].astype("<u4").tobytes()
                rows.append(row)
                starts.append(start)
                sizes.append(len(own) // 4)
                sums.append(zlib.crc32(own))
                totals.append(len(ids))
                parts.append(own)
        columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
        columns += [pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals)]
        if with_ids:
            columns.append(pa.array(parts, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kind = PIECES.format(key=docs.schema["doc_id"].dataType.simpleString()) + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits: an unbounded knapsack by dynamic programming."""
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    for space in range(1, room + 1):
        best[space] = best[space - 1]
        fits = np.searchsorted(sizes, space, "right")
        if fits:
            gains = best[space - sizes[:fits]] + values[:fits]
            k = int(gains.argmax())
            if gains[k] > best[space] + 1e-12:
                best[space], taken[space] = gains[k], k
    pattern, space = np.zeros(len(sizes), np.int64), room
    while space > 0:
        if taken[space] < 0:
            space -= 1
        else:
            pattern[taken[space]] += 1
            space -= sizes[taken[space]]
    return float(best[room]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with whole rows: threads of a numeric library, which may wait for
    each other beside a busy JVM, have no part in it."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def _greedy_basis(sizes: np.ndarray, wanted: np.ndarray, room: int) -> np.ndarray:
    """A first basis: fill sequences with the largest sizes left until one is used up.

    Every pattern uses up one size that no later one has, so the patterns (columns) are
    independent and their amounts positive.
    """
    left, basis = wanted.copy(), np.zeros((len(sizes), len(sizes)))
    for _ in sizes:
        pattern, space = np.zeros(len(sizes)), room
        for k in np.flatnonzero(left > 0)[::-1]:
            pattern[k] = space // sizes[k]
            space -= pattern[k] * sizes[k]
        copies = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        ends = int(copies.argmin())
        left -= copies[ends] * pattern
        left[ends] = 0
        basis[:, ends] = pattern
    return basis


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """Patterns (pieces of each size) and how often to use each, covering `demand` exactly.

    `sizes` ascend and are at most `room`.
    """
    if not len(sizes):
        return []
    # Equal demands make the simplex walk in circles; slightly different ones don't.
    wanted = demand + np.random.default_rng(0).uniform(0.01, 0.1, len(sizes))
    basis = _greedy_basis(sizes, wanted, room)
    inverse = _inverse(basis)
    amounts = np.maximum(_times(inverse, wanted), 0)
    for step in range(1, MAX_STEPS):
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(prices, sizes, room)
        if value <= 1 + GAP:
            break
        column = _times(inverse, pattern)
        usable = column > 1e-7
        ratios = np.where(usable, amounts / np.where(usable, column, 1), np.inf)
        # Of the patterns that leave first, the one with the largest share in the new one.
        near = ratios <= ratios.min() + 1e-9 * (1 + ratios.min())
        leaves = int(np.where(near, column, -1).argmax())
        basis[:, leaves] = pattern
        if step % 256:
            row = inverse[leaves] / column[leaves]
            inverse -= column[:, None] * row
            inverse[leaves] = row
        else:
            inverse = _inverse(basis)
        amounts = np.maximum(_times(inverse, wanted), 0)
    left = demand.astype(np.int64).copy()
    out = []
    for k in np.argsort(-amounts, kind="stable"):
        pattern = basis[:, k].astype(np.int64)
        used = pattern > 0
        copies = int(min(np.floor(amounts[k] + 1e-6), (left[used] // pattern[used]).min()))
        if copies > 0:
            out.append((copies, pattern))
            left -= copies * pattern
    while left.any():
        pattern, space = np.zeros(len(sizes), np.int64), room
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], space // sizes[k])
            space -= pattern[k] * sizes[k]
        used = pattern > 0
        copies = int((left[used] // pattern[used]).min())
        out.append((copies, pattern))
        left -= copies * pattern
    return out


def _places(histogram: dict[int, int], room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length class, runs of ranks: class and first rank as one number, the first
    sequence of the run, and the pieces of the class in each of its sequences."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    ranks = dict.fromkeys(sizes.tolist(), 0)
    runs, sequence = [], 0
    for copies, pattern in solve(sizes, demand, room):
        for k in np.flatnonzero(pattern):
            size, many = int(sizes[k]), int(pattern[k])
            runs.append(((size << _RANK_BITS) + ranks[size], sequence, many))
            ranks[size] += copies * many
        sequence += copies
    runs.sort()
    return tuple(np.array([r[i] for r in runs], np.int64) for i in range(3))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of `cut` with the sequence they are in and their place there."""
    pieces = cut(docs, tokenizer, length, with_ids).withColumn("part", F.spark_partition_id())
    pieces = materialize(pieces.withColumn("size", F.least(F.ceil(F.col("length") / GRAIN), F.lit(length // GRAIN))), "pieces")
    counts = materialize(pieces.groupBy("part", "size").agg(F.count("*").alias("pieces")), "piece-counts")
    histogram = {r["size"]: r["pieces"] for r in counts.groupBy("size").agg(F.sum("pieces").alias("pieces")).collect()}
    firsts, sequences, many = _places(histogram, length // GRAIN)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("rank_before"))
    own = Window.partitionBy("part", "size").orderBy("doc_id", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["part", "size"])
    code = F.shiftleft(F.col("size").cast("long"), _RANK_BITS) + F.col("rank") + F.col("rank_before")
    columns = [f.name for f in pieces.schema if f.name not in ("part", "size")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(batch.num_columns - 1).to_numpy()
            run = np.searchsorted(firsts, codes, "right") - 1
            found = sequences[run] + (codes - firsts[run]) // many[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.int64())], names=[*columns, "sequence_id"]
            )

    fields = {f.name: f.dataType.simpleString() for f in pieces.schema}
    kind = ", ".join(f"{c} {fields[c]}" for c in columns) + ", sequence_id long"
    placed = ranked.select(*columns, code.alias("code")).mapInArrow(place, kind)
    # At most `length` pieces share a sequence.
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
