"""Runs of words that repeat with a period, found by string synchronising sets.

A run is a stretch of words with smallest period q, at least `EXPONENT` times as long as q,
that no neighbouring word extends. At the scale t (a power of two) a position is selected
if the hash of its t words is the least among the t + 1 positions from t before to it, or
from it on; this depends on the next 2t words only, so equal contexts of 2t words are
selected alike. Positions whose t words have a period of at most t / 4 have no hash, which
keeps the selection sparse where the text is highly periodic; those regions lie in runs that
smaller scales, or the direct comparison for periods 1 to 3, have found before.

Why nothing is missed: let a run have the smallest period q, t <= q < 2t, and 4q words. Were
none of its first t positions selected, its first 3t - 1 words had a period p of at most
t / 4, and as 3t - 1 >= p + q also the greatest common divisor of p and q, against the choice
of q. So some s among them is selected, and s + q as well, with an equal context; as the
context is longer than q, no position between them shares it. Neighbours in the order of
(context, position) that are t to 2t - 1 apart hence propose every such period, and each
proposal is extended word by word. Words and contexts are numbered exactly, hashes only
select, so no two different words count as equal.

Defined results: a null or empty text and one without words has no runs. Every row stands for
itself, so repeated doc_ids, null doc_ids and ties between rows need no rule; of the runs of
one text, ties go to the smaller start, then period. An empty table gives an empty result.
Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetally.llm.words import constants, mix

#: Least length of a run in words, and in periods. The proof above needs four periods.
MIN_WORDS = 6
EXPONENT = 4
#: Words that are looked at together; a longer text stands alone.
CHUNK_WORDS = 200_000
_U64 = np.uint64
_NONE = _U64(0xFFFFFFFFFFFFFFFF)
#: The smallest scale; shorter periods are compared directly.
BASE = 4
FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _islands(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    return edges[::2], edges[1::2]


def _short_periods(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs with periods below `BASE`."""
    found = []
    for q in range(1, BASE):
        if len(ids) <= q:
            break
        starts, ends = _islands(ids[:-q] == ids[q:])
        long = ends - starts >= (EXPONENT - 1) * q
        starts, ends = starts[long], ends[long] + q
        # 1 is the only smaller period that divides 2 or 3; then all words are the same.
        least = np.ones(len(starts), bool)
        if q > 1 and len(starts):
            least = (ids[starts[:, None] + np.arange(1, q)] != ids[starts][:, None]).any(1)
        found += [(s, e, q) for s, e in zip(starts[least].tolist(), ends[least].tolist(), strict=True)]
    return found


def _doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Exact numbers for stretches of 2t words from those for t words."""
    if len(names) <= t:
        return np.zeros(0, np.int64)
    both = names[:-t] * (int(names.max()) + 1) + names[t:]
    return pd.factorize(both)[0].astype(np.int64)


def _selected(names: np.ndarray, t: int, covered: np.ndarray) -> np.ndarray:
    """The synchronising set of scale t; `covered` positions have no hash."""
    key = mix(names.astype(_U64) + constants(t, 1)[0])
    key[covered] = _NONE
    low, width = key, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:-1], low[1:])
    return np.flatnonzero((low != _NONE) & ((low == key[: len(low)]) | (low == key[t : t + len(low)])))


def _covered(found: list[tuple[int, int, int]], t: int, n: int) -> np.ndarray:
    """Positions whose next t words lie in a found run with a period of at most t / 4."""
    edges = np.zeros(n + 1, np.int64)
    inner = [(s, e) for s, e, q in found if q * EXPONENT <= t and e - s >= t]
    if inner:
        at = np.array(inner)
        np.add.at(edges, at[:, 0], 1)
        np.add.at(edges, at[:, 1] - t + 1, -1)
    return np.cumsum(edges[:n]) > 0


def _extended(ids: np.ndarray, s: int, known: int, q: int) -> tuple[int, int]:
    """The stretch with period q around s, of which s to `known` (exclusive) is given."""
    end, step = known, 64
    while end < len(ids):
        right = ids[end : end + step]
        same = right == ids[end - q : end - q + len(right)]
        if not same.all():
            end += int(np.argmin(same))
            break
        end += len(right)
        step *= 2
    start, step = s, 64
    while start > 0:
        low = max(0, start - step)
        same = (ids[low:start] == ids[low + q : start + q])[::-1]
        if not same.all():
            start -= int(np.argmin(same))
            break
        start = low
        step *= 2
    return start, end


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least four periods in a sequence of exact word
    numbers. Texts are laid end to end with a number of its own after each; `longest` is the
    number of words of the longest one."""
    found = _short_periods(ids)
    names, t = ids, 1
    while t < BASE:
        names = _doubled(names, t)
        t *= 2
    while EXPONENT * t <= longest and len(names) > t:
        contexts = _doubled(names, t)
        at = _selected(names, t, _covered(found, t, len(names)))
        at = at[at < len(contexts)]
        order = np.argsort(contexts[at], kind="stable")
        at, context = at[order], contexts[at][order]
        apart = np.diff(at)
        near = (context[1:] == context[:-1]) & (apart >= t) & (apart < 2 * t)
        starts, periods = at[:-1][near], apart[near]
        order = np.lexsort((starts, periods))
        last_period, last_end = 0, 0
        for s, q in zip(starts[order].tolist(), periods[order].tolist(), strict=True):
            if q == last_period and s + q < last_end:
                continue  # in the run that was just extended
            start, end = _extended(ids, s, s + q + 2 * t, q)
            last_period, last_end = q, end
            if end - start >= EXPONENT * q:
                found.append((start, end, q))
        names, t = contexts, 2 * t
    return found


def _chunks(words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Rows of texts, about `CHUNK_WORDS` words at a time (one text at least)."""
    first, held = 0, 0
    for row, own in enumerate(words):
        if held and held + len(own) > CHUNK_WORDS:
            yield first, row
            first, held = row, 0
        held += len(own) + 1
    if first < len(words):
        yield first, len(words)


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact numbers of the words of some texts end to end, a number of its own after each
    text, and the place where each text starts."""
    sizes = np.array([len(own) for own in words], np.int64)
    flat = pa.array([w for own in words for w in own], pa.large_binary())
    own = flat.dictionary_encode()
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.arange(int(sizes.sum()) + len(words), dtype=np.int64) + len(own.dictionary)
    places = np.arange(len(flat)) + np.repeat(np.arange(len(words)), sizes)
    ids[places] = own.indices.to_numpy()
    return ids, starts


def _of_texts(words: list[list[bytes]], min_words: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text its runs (start, length, period) and what is left when each run keeps its
    first period only."""
    ids, starts = _numbered(words)
    per_text: dict[int, list[tuple[int, int, int]]] = {}
    found = [r for r in find_runs(ids, max(map(len, words))) if r[1] - r[0] >= min_words]
    if found:
        text_of = np.searchsorted(starts, [r[0] for r in found], "right") - 1
        for (s, e, q), row in zip(found, text_of.tolist(), strict=True):
            s -= int(starts[row])
            per_text.setdefault(row, []).append((s, e - int(starts[row]) - s, q))
    for row, own in enumerate(words):
        runs = sorted(per_text.get(row, ()), key=lambda r: (r[0], r[2]))
        if runs:
            edges = np.zeros(len(own) + 1, np.int64)
            at = np.array(runs)
            np.add.at(edges, at[:, 0] + at[:, 2], 1)
            np.add.at(edges, at[:, 0] + at[:, 1], -1)
            own = [w for w, k in zip(own, np.cumsum(edges[:-1]).tolist(), strict=True) if not k]
        yield runs, b" ".join(own)


def detected(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row doc_id, n_words, all runs by start and period, and the words that are left
    when each run keeps its first period only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            words = [t.encode().split() for t in texts]  # splits at the six white-space bytes
            for first, last in _chunks(words):
                found = list(_of_texts(words[first:last], min_words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([len(own) for own in words[first:last]], pa.int64()),
                        pa.array([[dict(start=s, length=n, period=q) for s, n, q in r] for r, _ in found], kind),
                        pa.array([c for _, c in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, {FIELDS}")


def _better(a: Column, b: Column) -> Column:
    """Order of two runs: greater exponent first, compared exactly, then start and period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    return (
        F.when(left > right, -1).when(left < right, 1)
        .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
        .otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    )


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row doc_id, the number of runs, the run of the greatest exponent, and digests of
    all runs and of the collapsed text."""
    found = detected(docs, min_words).withColumn("best", F.get(F.array_sort("runs", _better), F.lit(0)))
    lines = F.transform(
        "runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a repetition written into a tenth of the texts by their doc_id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    written = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, written).otherwise(F.col("text")).alias("text"))
