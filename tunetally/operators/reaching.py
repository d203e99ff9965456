"""All pairs of items whose similarity reaches a threshold, exactly.

The tiles are those of `similarity.nearest`, squares or bands; a task returns the pairs of its tile that reach the
threshold, so what leaves it follows the result. A tile that too many users share, or that would
form too many products, is added up by several tasks first. No pair is lost to a cap.

Counts of 0 add nothing to a similarity and are left out, and the threshold is above 0. The
similarity is that of `similarity.nearest_items` to the last digit.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetally.functions.columns import cosine
from tunetally.operators import similarity
from tunetally.operators.ids import encode_ids
from tunetally.operators.lookup import FactSize, lookup
from tunetally.operators.similarity import DIGITS, item_norms
from tunetally.operators.tiles import ABOVE, SUMS, Grid, above_of_sums, above_of_tile, sums_of_slab
from tunetally.session import materialize

# Rounding of similarities; what it lets through is measured by the rounded value.
SLACK = 2.0 / 10**DIGITS


def reaching_pairs(
    cells: DataFrame,
    least: float,
    only_items: DataFrame | None = None,
    block_items: int = similarity.BLOCK_ITEMS,
    bands: bool | None = None,
) -> DataFrame:
    """`item_a` < `item_b` and their similarity, at least `least`, each pair once; with
    `only_items`, the pairs that have one of these. `bands` is that of `similarity.nearest`."""
    if least <= 0:
        raise ValueError("the threshold must be above 0")
    cells = similarity.with_histories(cells.where(F.col("play_count") != 0))
    items = materialize(encode_ids(item_norms(cells, similarity.products_of_item()), "item_id", "code"), "items")
    size = FactSize.measure(items, "listeners")
    blocks = similarity._block_count(size.keys, block_items, cells.sparkSession.sparkContext.defaultParallelism)
    symmetric = only_items is None
    if bands is None:
        band_items = max(block_items**2 // max(size.keys, 1), similarity.BAND_ITEMS)
        bands = similarity._bands_are_cheaper(cells, size.keys, blocks, band_items, 0)
    if bands:
        items, found = similarity.banded(
            cells, items, size, similarity.band_products(block_items), similarity.TILE_ROWS,
            only_items=only_items, symmetric=symmetric,
        )
        at_least = least - SLACK
        pairs = found.apply(above_of_tile(found.grid, at_least), above_of_sums(found.grid, at_least), ABOVE)
        return _reaching(pairs, items, least, symmetric)
    if symmetric:
        items = items.withColumn("left_code", F.col("code"))
        left_count, left_blocks = size.keys, blocks
    else:
        wanted = items.join(only_items.select("item_id").distinct(), "item_id", "left_semi")
        codes = encode_ids(wanted.select("item_id"), "item_id", "left_code")
        items = materialize(items.join(codes, "item_id", "left"), "items")
        left_count = items.agg(F.count("left_code")).first()[0]
        left_blocks = max(ceil(left_count / block_items), 1)
    weighted = lookup(cells, items, "item_id", "listeners", size).select(
        "user_id", "code", "left_code", F.col("play_count").cast("double").alias("w"), F.col("norm").alias("n")
    )
    weighted = weighted.repartition("user_id")
    right = similarity._segments(weighted, "code", blocks)
    left = right if symmetric else similarity._segments(
        weighted.where(F.col("left_code").isNotNull()), "left_code", left_blocks
    )
    height, width = ceil(left_count / left_blocks), ceil(size.keys / blocks)
    grid = Grid(left_blocks, blocks, height, width, symmetric=symmetric, k=0, digits=DIGITS)
    tiles = similarity._tiles(left, right, left_blocks, symmetric, whole_history=symmetric)
    products = similarity._heavy_tiles(left, right, size.facts, grid)
    if products is not None or similarity._largest_tile(items, grid) > similarity.TILE_ROWS:
        slabs = similarity._slabs(similarity._slab_counts(tiles, items, grid, similarity.TILE_ROWS, products))
        sums = slabs.groupBy("a", "b", "slab").applyInArrow(sums_of_slab(grid), SUMS)
        pairs = sums.groupBy("a", "b").applyInArrow(above_of_sums(grid, least - SLACK), ABOVE)
    else:
        pairs = tiles.drop("user_id").groupBy("a", "b").applyInArrow(above_of_tile(grid, least - SLACK), ABOVE)
    return _reaching(pairs, items, least, symmetric)


def _reaching(pairs: DataFrame, items: DataFrame, least: float, symmetric: bool) -> DataFrame:
    out = _named(pairs, items).where(F.col("similarity") >= least)
    # Two of the wanted items meet twice.
    return out if symmetric else out.distinct()


def _named(pairs: DataFrame, items: DataFrame) -> DataFrame:
    left = items.select("left_code", F.col("item_id").alias("x"), F.col("norm").alias("norm_x"))
    right = items.select(F.col("code").alias("right_code"), F.col("item_id").alias("y"), F.col("norm").alias("norm_y"))
    both = pairs.join(left, "left_code").join(right, "right_code").where(F.col("x") != F.col("y"))
    return both.select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"),
        cosine(F.col("dot"), F.col("norm_x"), F.col("norm_y")).alias("similarity"),
    )
