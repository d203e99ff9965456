"""What a task does with a summary of bounded size: quantiles by compaction, heavy ids by
counters. Summaries of parts merge in any order, each with the error it has made so far."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Send what is below to the executors by value: they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Compactor:
    """Values in levels; one in level l stands for 2**l values.

    A level that holds 2k values is sorted and every other value goes up a level, the first
    or the second of each two in turn. That shifts the rank of any number by at most 2**l, and
    `error` is the sum of these shifts: the rank of a number in the summary is never farther
    from its rank among all values.
    """

    def __init__(self, k: int):
        self.k, self.n, self.error = k, 0, 0
        self.levels: list[np.ndarray] = []
        self._turn: list[int] = []

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._put(0, values)

    def merge(self, levels: list[np.ndarray], n: int, error: int) -> None:
        self.n += n
        self.error += error
        for level, values in enumerate(levels):
            self._put(level, values)

    def _put(self, level: int, values: np.ndarray) -> None:
        while level >= len(self.levels):
            self.levels.append(np.zeros(0))
            self._turn.append(0)
        held = np.concatenate([self.levels[level], values])
        if len(held) < 2 * self.k:
            self.levels[level] = held
            return
        held.sort()
        even = len(held) - len(held) % 2
        self.levels[level] = held[even:]
        up = held[self._turn[level] : even : 2]
        self._turn[level] ^= 1
        self.error += 1 << level
        self._put(level + 1, up)

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """For each share, the first value whose rank reaches that share of all values."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << l, np.int64) for l, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.ceil(np.array(shares) * self.n))
        return values[order][np.minimum(at, len(values) - 1)].tolist()


class Counters:
    """At most `size` ids with counts, and `lost`: an id has at least its count and at most
    so much more; one that is not held has at most `lost`."""

    def __init__(self, size: int):
        self.size, self.lost, self.negative = size, 0, False
        self.held: pa.Table | None = None

    def add(self, ids: pa.Array | pa.ChunkedArray, counts: pa.Array | pa.ChunkedArray) -> None:
        counts = pc.fill_null(counts.cast(pa.int64()), 0)
        if len(counts) and pc.min(counts).as_py() < 0:
            self.negative = True
        fresh = pa.table({"id": ids, "count": counts})
        both = fresh if self.held is None else pa.concat_tables([self.held, fresh])
        sums = both.group_by("id").aggregate([("count", "sum")])
        both = pa.table({"id": sums["id"], "count": sums["count_sum"]})
        if both.num_rows > self.size:
            found = both["count"].to_numpy()
            cut = int(np.partition(found, -self.size - 1)[-self.size - 1])
            both = both.filter(pc.greater(both["count"], cut))
            both = both.set_column(1, "count", pc.subtract(both["count"], cut))
            self.lost += cut
        self.held = both.combine_chunks()
