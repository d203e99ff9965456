"""Token ids of documents packed into rows of a fixed length, as binary.

Documents longer than a row are split into full rows and a rest; no id is lost. Pieces are
packed best fit, longest first: each goes to the row with the least room that it fits in.
Rows with room are kept by their room in a segment tree, whose nodes count the rows below,
so the least sufficient room is found in as many steps as the tree is high. A task packs
`BLOCK_TOKENS` ids at a time, so memory has a bound and nothing is shuffled.

A packed row has `ids` (little-endian, 2 bytes if the vocabulary allows it, else 4, filled
up with `PAD`), `cu_seqlens` (where segments end, from 0), and per segment `doc_ids`,
`starts` (its first id's place in the document) and `resets` (where in the row positions
start again from 0).

Defined results: a null or empty text is the end id alone; null doc_ids stay null; rows
that repeat are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetally.llm.tokens import END_ID, ids_of

LENGTH = 2048
TOKENIZER = "byte_bpe_50k.tiktoken"
PAD = END_ID
BLOCK_TOKENS = 2 << 20


class Rooms:
    """Rows with room, by their room: a segment tree of counts."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.counts = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def _count(self, room: int, change: int) -> None:
        node = self.width + room
        while node:
            self.counts[node] += change
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row with the least room that is `need` or more; (room, row)."""
        node, counts = self.width + need, self.counts
        while not counts[node]:
            while node & 1:  # the right child: go up
                node >>= 1
                if not node:
                    return None
            node += 1  # the subtree to the right
            if node & (node - 1) == 0:  # there is none
                return None
        while node < self.width:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.width
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into `sizes`, longest first; no size is above `length`."""
    rooms, rows = Rooms(length), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = rooms.take(sizes[k])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        if room > sizes[k]:
            rooms.add(room - sizes[k], row)
    return rows


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, wide: bool = False) -> DataFrame:
    """The packed rows of all documents; `wide` takes 4 bytes per id."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids of rows are unique in the table: the task in front, the row's number after it.
        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = ids_of(text.as_py(), tokenizer)
                if not wide and ids.max() >= 1 << 16:
                    raise ValueError("ids don't fit 2 bytes; use wide=True")
                held += [(key.as_py(), at, ids[at : at + length]) for at in range(0, len(ids), length)]
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield block(held, number)
                    number, held, size = number + len(held), [], 0
        if held:
            yield block(held, number)

    def block(pieces: list[tuple], number: int) -> pa.RecordBatch:
        out = {name: [] for name in names}
        for row in best_fit([len(p[2]) for p in pieces], length):
            ids, ends = np.full(length, PAD, kind), [0]
            for k in row:
                own = pieces[k][2]
                ids[ends[-1] : ends[-1] + len(own)] = own
                ends.append(ends[-1] + len(own))
            out["row_id"].append(number + len(out["row_id"]))
            out["ids"].append(ids.tobytes())
            out["cu_seqlens"].append(ends)
            out["doc_ids"].append([pieces[k][0] for k in row])
            out["starts"].append([pieces[k][1] for k in row])
            out["resets"].append(ends[:-1])
        return pa.RecordBatch.from_pydict(out, schema)

    names = ["row_id", "ids", "cu_seqlens", "doc_ids", "starts", "resets"]
    key = docs.schema["doc_id"].dataType
    ints = pa.list_(pa.int32())
    from pyspark.sql.pandas.types import to_arrow_type

    types = [pa.int64(), pa.binary(), ints, pa.list_(to_arrow_type(key)), ints, ints]
    schema = pa.schema(list(zip(names, types, strict=True)))
    spark_kind = (
        f"row_id long, ids binary, cu_seqlens array<int>, doc_ids array<{key.simpleString()}>, starts array<int>, resets array<int>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, spark_kind)


def position_ids(cu_seqlens: Column) -> Column:
    """The position of every id of a row, from 0 in each segment."""
    ends = F.slice(cu_seqlens, F.lit(2), F.size(cu_seqlens))
    spans = F.zip_with(F.slice(cu_seqlens, F.lit(1), F.size(cu_seqlens) - 1), ends, lambda a, b: F.sequence(F.lit(0), b - a - 1))
    return F.flatten(spans)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed rows as Parquet, uncompressed within pages as ids hardly compress."""
    packed(docs, **options).write.option("compression", "none").parquet(path)
