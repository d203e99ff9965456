"""Candidates for similar items by signed random projections, each verified exactly.

Every user has 128 signs, the bits of the MD5 of the user's id. The signs of an item are those of
the sums of its counts times the signs of its users; two items agree in a bit with probability
1 - angle / pi. Items that agree in all bits of a band are candidates. There are 256 buckets in
a band, so their pairs grow with the square of the items: the pairs above the threshold are
searched exactly in tiles, where no pair is a row before it reaches it, and those stay that
share a band. With `sorted_buckets`, small buckets give all their pairs, large ones are sorted
by all bits instead and each item is paired with the next `NEXT`, which finds less.

The exact search stays the default: this one finds pairs above a threshold with a recall that
depends on it, and only what it returns is exact. Items with more than `LONG_COLUMN` listeners
would be long to verify as rows; all their pairs come from the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetally.functions.columns import cosine
from tunetally.operators.reaching import reaching_pairs
from tunetally.operators.similarity import item_norms
from tunetally.session import materialize

DIGITS = 32
BITS = 4 * DIGITS
BAND_BITS = 8
# Buckets up to this size give all their pairs.
SMALL_BUCKET = 512
NEXT = 64
LONG_COLUMN = 50_000


def signatures(cells: DataFrame) -> DataFrame:
    """`item_id` and its bits as 32 hexadecimal digits; a sum of 0 is a 1."""
    marks = F.md5(F.col("user_id").cast("string"))
    code = [F.ascii(F.substring(marks, j + 1, 1)) for j in range(DIGITS)]
    digits = [F.when(c >= 97, c - 87).otherwise(c - 48).alias(f"d{j}") for j, c in enumerate(code)]
    # By item first: the 128 partial sums of an item are a long row.
    signed = cells.select("user_id", "item_id", "play_count").repartition("item_id")
    signed = signed.select("item_id", "play_count", *digits)
    sums = [
        F.sum(F.col("play_count") * (1 - 2 * F.shiftright(f"d{j}", b).bitwiseAND(1))).alias(f"s{4 * j + b}")
        for j in range(DIGITS) for b in range(4)
    ]
    summed = signed.groupBy("item_id").agg(*sums)

    def digit(j: int) -> Column:
        bits = [F.when(F.col(f"s{4 * j + b}") >= 0, 1 << b).otherwise(0) for b in range(4)]
        return F.lower(F.hex(sum(bits[1:], bits[0])))

    return summed.select("item_id", F.concat(*(digit(j) for j in range(DIGITS))).alias("bits"))


def _bands(bits: str, band_bits: int) -> list[Column]:
    width = band_bits // 4
    return [F.substring(bits, 1 + k * width, width) for k in range(DIGITS // width)]


def _members(signs: DataFrame, band_bits: int) -> DataFrame:
    """The items of each bucket with more than one, with its size."""
    banded = signs.select("item_id", "bits", F.posexplode(F.array(*_bands("bits", band_bits))).alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    # At most 2**band_bits buckets per band.
    return materialize(banded.join(F.broadcast(sizes), ["band", "key"]), "bands")


def _small_pairs(members: DataFrame) -> DataFrame:
    small = members.where(F.col("size") <= SMALL_BUCKET)
    a = small.select("band", "key", F.col("item_id").alias("item_a"))
    b = small.select("band", "key", F.col("item_id").alias("item_b"))
    return a.join(b, ["band", "key"]).where(F.col("item_a") < F.col("item_b")).select("item_a", "item_b")


def candidates(signs: DataFrame, band_bits: int = BAND_BITS) -> DataFrame:
    """Pairs `item_a` < `item_b` that share a band, once each; in large buckets those of
    neighbours in the order of their bits only."""
    members = _members(signs, band_bits)
    return _small_pairs(members).union(_sorted_pairs(members.where(F.col("size") > SMALL_BUCKET))).distinct()


def _sorted_pairs(members: DataFrame) -> DataFrame:
    """Each item of a large bucket with the next ones in the order of their bits. Ranges of that
    order go to the tasks, so a bucket that holds most items is spread; at the end of a task
    some items have fewer pairs."""
    order = ["band", "key", "bits", "item_id"]
    ranged = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = members.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch.select(["band", "key", "item_id"])])
            fresh = 0 if held is None else held.num_rows
            held = table if held is None else pa.concat_tables([held, table])
            held = held.combine_chunks()
            bucket = np.array([f"{x}:{y}" for x, y in zip(held["band"].to_pylist(), held["key"].to_pylist())])
            at = np.arange(held.num_rows)
            left, right = [], []
            for step in range(1, NEXT + 1):
                # The second of the pair is new, the first may have been held back.
                second = at[max(fresh, step) :]
                same = second[bucket[second] == bucket[second - step]]
                left.append(same - step)
                right.append(same)
            items = held["item_id"].combine_chunks()
            pairs = [items.take(pa.array(np.concatenate(x))) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(pairs, names=["x", "y"])
            held = held.slice(max(0, held.num_rows - NEXT))

    pairs = ranged.mapInArrow(run, f"x {kind}, y {kind}")
    return pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def verified(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with a common listener and their exact similarity."""
    cells = cells.select("user_id", "item_id", F.col("play_count").cast("double").alias("w"))
    norms = item_norms(cells.withColumnRenamed("w", "play_count"))
    a = cells.select("user_id", F.col("item_id").alias("item_a"), F.col("w").alias("wa"))
    b = cells.select("user_id", F.col("item_id").alias("item_b"), F.col("w").alias("wb"))
    met = pairs.join(a, "item_a").join(b, ["item_b", "user_id"])
    dots = met.groupBy("item_a", "item_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    for item, name in (("item_a", "na"), ("item_b", "nb")):
        dots = dots.join(norms.select(F.col("item_id").alias(item), F.col("norm").alias(name)), item)
    return dots.select("item_a", "item_b", cosine(F.col("dot"), F.col("na"), F.col("nb")).alias("similarity"))


def _sharing(pairs: DataFrame, signs: DataFrame, band_bits: int) -> DataFrame:
    """The pairs whose items agree in a band."""
    a = signs.select(F.col("item_id").alias("item_a"), F.array(*_bands("bits", band_bits)).alias("bands_a"))
    b = signs.select(F.col("item_id").alias("item_b"), F.array(*_bands("bits", band_bits)).alias("bands_b"))
    both = pairs.join(a, "item_a").join(b, "item_b")
    same = F.exists(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), lambda x: x)
    return both.where(same).select("item_a", "item_b", "similarity")


def similar_pairs(
    cells: DataFrame, least: float, band_bits: int = BAND_BITS, sorted_buckets: bool = False
) -> DataFrame:
    """Pairs with a similarity of at least `least`, which is above 0: those that share a band, and
    all that have an item with a long column."""
    if least <= 0:
        raise ValueError("the threshold must be above 0")
    cells = materialize(cells, "cells")
    listeners = cells.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    long = materialize(listeners.where(F.col("n") > LONG_COLUMN).select("item_id"), "long-columns")
    any_long = not long.isEmpty()
    short = cells.join(long, "item_id", "left_anti") if any_long else cells
    if sorted_buckets:
        signs = materialize(signatures(short), "signatures")
        found = verified(short, candidates(signs, band_bits))
    else:
        near = materialize(reaching_pairs(short, least), "near")
        items = near.select(F.explode(F.array("item_a", "item_b")).alias("item_id")).distinct()
        signs = materialize(signatures(short.join(items, "item_id", "left_semi")), "signatures")
        found = _sharing(near, signs, band_bits)
    if any_long:
        found = found.union(reaching_pairs(cells, least, long))
    return found.where(F.col("similarity") >= least).distinct()
