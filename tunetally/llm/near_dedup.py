"""MinHash near-duplicates with sequential Bayesian verification.

Texts with the same set of shingles are one node; nodes are numbered in the order of their
smallest doc_id, so that the smallest node of a component has its smallest doc_id. Signatures are cut into bands; nodes
that agree on a band are candidates. Candidates compare their signatures batch by batch:
after each batch, a pair goes on only if the posterior probability that its similarity
reaches the threshold, given the matches so far and a uniform prior, is at least
`MISS`. Pairs that come through are confirmed on the full sets.

A bucket of n nodes is not spread out into n * n pairs. What is wanted are components, so
the nodes of a bucket are first compared with two leaders of it, the smallest node and the
one with the smallest hash, which mostly are the same in all buckets of a group of copies.
Buckets that then still hold several components have the pairs between components
compared: small buckets as rows, large ones in blocks of nodes. A task gets two blocks with
signatures and sets, takes each pair in the first band it shares only, and returns links
that join components, so fewer than it has nodes.

Defined results: a null or empty text and one without words has an empty set and is linked
with nothing; a null doc_id is in no component and stays; rows that repeat have one result
each, and `near_dedup` keeps one of them; rows that share a doc_id but not a text are
linked each by its own text. An empty table gives an empty result. Other columns are left
alone, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetally.llm.components import components
from tunetally.llm.words import binary_column, chunks, constants, mix, new_key, shingle_sets
from tunetally.session import materialize

SHINGLE = 5
PERCENT = 80
BANDS = 24
BAND_ROWS = 4
#: Hashes that are compared before the posterior is looked at again.
BATCH = 32
#: A pair at the threshold may be lost by the bounds with about this probability.
MISS = 1e-7
#: Buckets up to this size are compared as rows; larger ones in blocks of nodes whose sets and
#: signatures have about `BLOCK_BYTES`.
SMALL_BUCKET = 32
BLOCK_BYTES = 16 << 20
N_HASHES = BANDS * BAND_ROWS
_U64 = np.uint64


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) for each batch.

    With a uniform prior, the posterior after m matches of n is Beta(m+1, n-m+1), whose
    tail beyond t is the chance of at most m successes in n+1 trials of probability t.
    """
    out = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two arrays of signatures may reach the threshold."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in bounds:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive, matches, done = alive[matches >= least], matches[matches >= least], n
    return alive


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over each non-empty set."""
    factors, masks = constants(11, N_HASHES), constants(12, N_HASHES)
    out = np.empty((len(bounds) - 1, N_HASHES), np.uint32)
    for k in range(N_HASHES):
        values = hashes ^ masks[k]
        values *= factors[k]
        out[:, k] = np.minimum.reduceat(values, bounds[:-1]) >> _U64(32)
    return out


def _set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two sums over each non-empty set, which stand for it."""
    return np.stack([np.add.reduceat(mix(hashes * factor), bounds[:-1]) for factor in constants(13, 2)])


def _text_hash() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def signed(docs: DataFrame, shingle: int, key: bytes) -> DataFrame:
    """doc_id, the hash of the text, n_shingles, set_a and set_b (128 bits that stand for the
    set), signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(2)):
                hashes, bounds = shingle_sets(texts, shingle, True, key)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                keys = np.zeros((2, texts.n), _U64)
                signatures = pa.nulls(texts.n, pa.binary())
                if len(full):
                    tight = np.append(bounds[full], bounds[-1])
                    keys[:, full] = _set_keys(hashes, tight)
                    flat = _signatures(hashes, tight).view(np.uint8).ravel()
                    packed = binary_column(flat, np.arange(len(full) + 1) * N_HASHES * 4)
                    at = np.full(texts.n, -1)
                    at[full] = np.arange(len(full))
                    signatures = packed.take(pa.array(at, mask=at < 0))
                columns = [batch.column(k).slice(texts.first, texts.n) for k in range(2)]
                columns.append(pa.array(sizes, pa.int64()))
                columns += [pa.array(k.view(np.int64)) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, signatures], names=names)

    names = ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "signature"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {kind}, text_hash binary, n_shingles long, set_a long, set_b long, signature binary"
    return docs.select("doc_id", _text_hash(), "text").mapInArrow(run, kind)


def _shingles(rows: DataFrame, shingle: int, key: bytes) -> DataFrame:
    """node and its sorted shingle hashes, 8 bytes each, of the rows (node, set_a, set_b, text)
    whose text has the set of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(3)):
                hashes, bounds = shingle_sets(texts, shingle, True, key)
                node, *wanted = (batch.column(k).slice(texts.first, texts.n) for k in range(3))
                own = np.diff(bounds) > 0
                if own.any():
                    keys = _set_keys(hashes, np.append(bounds[:-1][own], bounds[-1])).view(np.int64)
                    own[own] = np.all([k == w.to_numpy()[own] for k, w in zip(keys, wanted, strict=True)], axis=0)
                found = pa.RecordBatch.from_arrays([node, binary_column(hashes, bounds)], names=["node", "shingles"])
                yield found.filter(pa.array(own))

    return rows.select("node", "set_a", "set_b", "text").mapInArrow(run, "node long, shingles binary")


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, N_HASHES), np.uint32)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, N_HASHES)


class _Linker:
    """The tables that all rounds of one run share."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int, percent: int, key: bytes):
        self.key = "long"
        self.percent, self.bounds = percent, least_matches(percent / 100)
        self.nodes, self.members = nodes, members
        wanted = members.select("node").distinct()
        named = nodes.select("node", "doc_id", "set_a", "set_b").join(wanted, "node")
        rows = docs.select("doc_id", "text").join(named, "doc_id")
        self.sets = materialize(_shingles(rows, shingle, key).distinct(), "near-sets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that come through the bounds."""
        bounds = self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alive = survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
                yield batch.select(["a", "b"]).take(pa.array(alive))

        sides = pairs
        for side in "ab":
            own = self.nodes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"))
            sides = sides.join(own, side)
        return sides.select("a", "b", "sa", "sb").mapInArrow(run, f"a {self.key}, b {self.key}")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = np.zeros(batch.num_rows, bool)
                for k in range(batch.num_rows):
                    a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), _U64) for c in (2, 3))
                    small, large = (a, b) if len(a) <= len(b) else (b, a)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    linked[k] = 100 * both >= percent * (len(a) + len(b) - both)
                yield batch.select(["a", "b"]).filter(pa.array(linked))

        sides = pairs
        for side in "ba":
            own = self.sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
            sides = sides.join(own, side)
        found = sides.select("a", "b", "sa", "sb").mapInArrow(run, f"a {self.key}, b {self.key}")
        return found.distinct()

    def open_members(self, labels: DataFrame) -> DataFrame:
        """The members of buckets that hold several components: bucket, band, node, label
        and the size of the bucket."""
        named = self.members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
        named = materialize(named.select("bucket", "band", "node", "label"), "near-labels")
        sums = F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")
        open_ = named.groupBy("bucket").agg(*sums).where("lo < hi").select("bucket", "size")
        return materialize(named.join(open_, "bucket"), "near-open")

    def with_leaders(self) -> DataFrame:
        """Pairs of each node and the leaders of its buckets."""
        by_hash = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
        leaders = self.members.groupBy("bucket").agg(F.array(F.min("node"), F.min(by_hash)["n"]).alias("leaders"))
        met = self.members.join(leaders, "bucket").select("node", F.explode("leaders").alias("leader"))
        met = met.where("node <> leader")
        return met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()

    def in_small(self, members: DataFrame) -> DataFrame:
        """Pairs of different components in buckets up to `SMALL_BUCKET`."""
        small = members.where(F.col("size") <= SMALL_BUCKET)
        left = small.select("bucket", F.col("node").alias("a"), F.col("label").alias("la"))
        right = small.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"))
        return left.join(right, "bucket").where("a < b and la <> lb").select("a", "b").distinct()

    def in_large(self, members: DataFrame) -> DataFrame:
        """Links that join components in buckets beyond `SMALL_BUCKET`."""
        large = members.where(F.col("size") > SMALL_BUCKET)
        if large.isEmpty():
            return self.members.sparkSession.createDataFrame([], f"a {self.key}, b {self.key}")
        measured = large.join(self.nodes.select("node", (8 * F.col("n_shingles")).alias("bytes")), "node")
        total = measured.groupBy("bucket").agg(F.sum(F.col("bytes") + 4 * N_HASHES).alias("bytes"))
        blocks = F.ceil(F.col("bytes") / BLOCK_BYTES)
        large = large.join(total, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        large = large.join(self.nodes.select("node", "signature"), "node").join(self.sets, "node")
        # Every two blocks of a bucket meet once; a block meets itself as well.
        met = large.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        met = met.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
        met = met.select("bucket", "i", "j", "band", "node", "label", "block", "signature", "shingles")
        bounds, percent = self.bounds, self.percent

        def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_joining_links(key[1], key[2], rows, bounds, percent), columns=["a", "b"])

        return met.groupBy("bucket", "i", "j").applyInPandas(compare, f"a {self.key}, b {self.key}")


def _joining_links(i: int, j: int, rows: pd.DataFrame, bounds: list[tuple[int, int]], percent: int) -> list[tuple]:
    """Links between the nodes of blocks i and j that join different components."""
    signatures = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(-1, N_HASHES)
    nodes, block = rows["node"].to_numpy(), rows["block"].to_numpy()
    labels = pd.factorize(rows["label"])[0]
    band = int(rows["band"].iloc[0]) * BAND_ROWS
    sizes = np.array([len(x) // 8 for x in rows["shingles"]])
    starts = np.cumsum(sizes) - sizes
    distinct, codes = np.unique(np.frombuffer(b"".join(rows["shingles"]), _U64), return_inverse=True)
    marked, found = np.zeros(len(distinct), np.int64), []
    for k in np.flatnonzero(block == i):
        others = np.flatnonzero((block == j) & (labels != labels[k]))
        if i == j:
            others = others[others > k]
        if not len(others):
            continue
        same = (signatures[others, :band] == signatures[k, :band]).reshape(len(others), -1, BAND_ROWS)
        others = others[~same.all(axis=2).any(axis=1)]
        mine = np.broadcast_to(signatures[k], (len(others), N_HASHES))
        others = others[survivors(mine, signatures[others], bounds)]
        if not len(others):
            continue
        own = codes[starts[k] : starts[k] + sizes[k]]
        marked[own] = 1
        both = np.add.reduceat(marked[codes], starts)[others]
        marked[own] = 0
        for other in others[100 * both >= percent * (sizes[k] + sizes[others] - both)]:
            if labels[other] != labels[k]:
                labels[labels == labels[other]] = labels[k]
                found.append((min(nodes[k], nodes[other]), max(nodes[k], nodes[other])))
    return found


def _verdicts(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, text_hash, n_shingles, component_id, kept, and whether its
    set is the first one of its component (`leads`)."""
    key = new_key()
    rows = materialize(signed(docs, shingle, key), "near-signed")
    full = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    keys = ["set_a", "set_b", "n_shingles"]
    nodes = full.groupBy(keys).agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    # Ids that rise from row to row and from range to range; written once, they are fixed.
    nodes = nodes.orderBy("doc_id", *keys).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "near-nodes")
    width = 4 * BAND_ROWS
    bands = [F.xxhash64(F.lit(k), F.substring("signature", 1 + k * width, width)) for k in range(BANDS)]
    banded = nodes.select("node", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(shared.select("bucket"), "bucket", "left_semi"), "near-members")
    linker = _Linker(docs, nodes, members, shingle, percent, key)
    pairs = materialize(linker.with_leaders(), "near-pairs")
    links = materialize(linker.confirmed(linker.likely(pairs)), "near-links")
    labels = components(links, "near-components")
    members = linker.open_members(labels)
    rest = linker.in_small(members).join(pairs, ["a", "b"], "left_anti")
    fresh = linker.confirmed(linker.likely(rest)).union(linker.in_large(members))
    links = links.union(materialize(fresh, "near-links"))
    labels = components(links, "near-components")
    smallest = nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("smallest"))
    moved = labels.where("node <> component").join(smallest, "component").select("node", "smallest")
    own = nodes.select("node", *keys, F.col("doc_id").alias("first")).join(moved, "node", "left")
    own = own.select(*keys, F.coalesce("smallest", "first").alias("component_id"), F.col("smallest").isNull().alias("leads"))
    out = rows.drop("signature").join(own, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    leads = kept & F.coalesce("leads", F.lit(True))
    return out.select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"), leads.alias("leads")
    )


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, and kept, which is whether both are
    the same; rows that repeat or share a doc_id are all kept then."""
    return _verdicts(docs, shingle, percent).drop("text_hash", "leads")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that are the first of their component, unchanged; of rows with
    the same doc_id and text one stays. Rows without a doc_id stay."""
    verdicts = _verdicts(docs, shingle, percent).where("not leads")
    verdicts = verdicts.select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    same = (docs["doc_id"] == verdicts["gone_id"]) & (F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == verdicts["text_hash"])
    good = docs.join(verdicts, same, "left_anti").select(*docs.columns)
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return good
    once = good.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return once.union(good.where(F.col("doc_id").isNull()))
