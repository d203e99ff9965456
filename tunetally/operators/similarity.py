"""Item-to-item cosine similarity and the k nearest items.

The similarity of two items is the cosine of their columns in the user x item matrix
of summed play counts. Pairs are never emitted as rows: items are split into blocks,
each user's history into one segment per block, and a task multiplies the segments of
one pair of blocks (a tile) into a small array, from which only the best k per item
leave the task. A tile too large for one task is added up by several first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.functions.columns import cosine, distance
from tunetally.operators.ids import encode_ids, running_totals
from tunetally.operators.lookup import MAX_BROADCAST_ROWS, FactSize, lookup
from tunetally.operators.tiles import (
    CANDIDATES,
    SUMS,
    Grid,
    TileTask,
    best_of_sums,
    best_of_tile,
    packed_by_band,
    sums_of_slab,
)
from tunetally.session import materialize

# Items per block: a tile is at most BLOCK_ITEMS² cells of 8 bytes in a Python worker.
BLOCK_ITEMS = 2_048
# With at most this many blocks a user's segments are joined in one task.
SEGMENTS_PER_TASK = 64
# Otherwise a history is split over one task per so many of its items …
PART_CELLS = 4_096
# … and its right side, if not cut by block, into chunks of about as many.
CHUNK_CELLS = 4_096
# With at most this many blocks the squares are always cheap enough.
FEW_BLOCKS = 16
# Where bands are compared with squares, a band has at least so many items.
BAND_ITEMS = 16
# About the bytes in a shuffle of a pair of segments, an entry of one, and a candidate.
PAIR_BYTES, ENTRY_BYTES, CANDIDATE_BYTES = 150, 20, 24
# Segment pairs of one tile in one task before the tile is split over several tasks, and
# the products, which are at least the entries, of a band.
TILE_ROWS = 20_000_000
TILE_ENTRIES = 100_000_000
# Products of one tile in one task; a tile with more is split by user.
TILE_PRODUCTS = 2_000_000_000
# Entries that bands shuffle at a time: so many, or times the cells. Beyond, they go in passes.
PASS_ENTRIES, PASS_OF_CELLS = 200_000_000, 8
DIGITS = 9
# Types of counts and the largest they hold.
WHOLE = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1}


def interaction_matrix(plays: DataFrame) -> DataFrame:
    """One row per (user, item) with the summed count: the sparse matrix in long form.

    A pair is in the matrix once it has a row, also with a count of 0.
    """
    return (
        plays.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
        .groupBy("user_id", "item_id")
        .agg(F.coalesce(F.sum("play_count"), F.lit(0)).alias("play_count"))
    )


def item_norms(cells: DataFrame, *more: Column) -> DataFrame:
    """Length of each item's column, over all users, its number of listeners, and `more`."""
    count = F.col("play_count").cast("double")
    return cells.groupBy("item_id").agg(
        F.sqrt(F.sum(count * count)).alias("norm"),
        F.count(F.lit(1)).alias("listeners"),
        *more,
    )


def matrix_stats(cells: DataFrame) -> DataFrame:
    """Users, items, stored cells and density of the matrix."""
    return cells.agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.count(F.lit(1)).alias("cells"),
    ).withColumn("density", F.col("cells") / (F.col("users").cast("double") * F.col("items")))


def encode_matrix(cells: DataFrame) -> DataFrame:
    """The matrix with row and column numbers in place of ids."""
    cells = materialize(cells, "cells")
    for id_col, code in (("user_id", "user_index"), ("item_id", "item_index")):
        ids = cells.groupBy(id_col).agg(F.count(F.lit(1)).alias("_cells"))
        codes = encode_ids(ids, id_col, code)
        cells = lookup(cells, codes, id_col, "_cells", FactSize.measure(codes, "_cells"))
    return cells.select("user_index", "item_index", "play_count")


class Nearest(NamedTuple):
    """The neighbour list with what a caller needs to join it to the matrix again."""

    rows: DataFrame
    cells: DataFrame
    size: FactSize


def nearest_items(cells: DataFrame, k: int, only_items: DataFrame | None = None) -> DataFrame:
    """The k most similar other items of every item, or of `only_items`, ranked from 1.

    Ties go to the lower id. Items without a common listener are no neighbours.
    """
    return nearest(cells, k, only_items).rows.select(
        "item_id", "neighbor_id", "similarity", distance(F.col("similarity")).alias("distance"),
        "rank",
    )


def nearest(
    cells: DataFrame,
    k: int,
    only_items: DataFrame | None = None,
    block_items: int = BLOCK_ITEMS,
    tile_rows: int = TILE_ROWS,
    bands: bool | None = None,
    norms: DataFrame | None = None,
) -> Nearest:
    """As `nearest_items`. `bands` sets the shape of the tiles, which else is measured. If
    `cells` are some of the cells of a matrix only, `norms` has the norms of the whole.

    Squares are blocks by blocks, of which only half are needed: best for long histories,
    which share the segments of a block. Bands are ranges of items by all items: best for
    short ones, whose segments would be single items, as the items of a user in a range meet
    the whole history in one row and not in one row per other block.
    """
    cells = with_histories(cells)
    own = item_norms(cells, products_of_item())
    if norms is not None:
        own = own.drop("norm").join(norms.select("item_id", "norm"), "item_id")
    items = materialize(encode_ids(own, "item_id", "code"), "items")
    size = FactSize.measure(items, "listeners")
    cores = cells.sparkSession.sparkContext.defaultParallelism
    blocks = _block_count(size.keys, block_items, cores)
    if bands is None:
        band_items = max(block_items**2 // max(size.keys, 1), BAND_ITEMS)
        bands = _bands_are_cheaper(cells, size.keys, blocks, band_items, k)
    if bands:
        items, found = banded(cells, items, size, band_products(block_items), tile_rows, k, only_items)
        best = found.apply(best_of_tile(found.grid), best_of_sums(found.grid), CANDIDATES)
        return Nearest(_merge(best, items, k), cells.drop("met"), size)
    symmetric = only_items is None
    if symmetric:
        items = items.withColumn("left_code", F.col("code"))
        left_count, left_blocks = size.keys, blocks
    else:
        wanted = items.join(only_items.select("item_id").distinct(), "item_id", "left_semi")
        left_codes = encode_ids(wanted.select("item_id"), "item_id", "left_code")
        items = materialize(items.join(left_codes, "item_id", "left"), "items")
        left_count = items.agg(F.count("left_code")).first()[0]
        left_blocks = max(ceil(left_count / block_items), 1)

    count = F.col("play_count").cast("double")
    # By user from here on: the segments and their join need no further shuffle.
    weighted = (
        lookup(cells, items, "item_id", "listeners", size)
        .select("user_id", "code", "left_code", count.alias("w"), F.col("norm").alias("n"))
        .repartition("user_id")
    )
    right = _segments(weighted, "code", blocks)
    left = right if symmetric else _segments(
        weighted.where(F.col("left_code").isNotNull()), "left_code", left_blocks
    )
    grid = Grid(
        left_blocks,
        blocks,
        height=ceil(left_count / left_blocks),
        width=ceil(size.keys / blocks),
        symmetric=symmetric,
        k=k,
        digits=DIGITS,
    )
    tiles = _tiles(left, right, left_blocks, symmetric, whole_history=symmetric)
    products = _heavy_tiles(left, right, size.facts, grid)
    if products is not None or (size.facts > tile_rows and _largest_tile(items, grid) > tile_rows):
        sums = (
            _slabs(_slab_counts(tiles, items, grid, tile_rows, products))
            .groupBy("a", "b", "slab")
            .applyInArrow(sums_of_slab(grid), SUMS)
        )
        best = sums.groupBy("a", "b").applyInArrow(best_of_sums(grid), CANDIDATES)
    else:
        best = (
            tiles.drop("user_id")
            .groupBy("a", "b")
            .applyInArrow(best_of_tile(grid), CANDIDATES)
        )
    return Nearest(_merge(best, items, k), cells.drop("met"), size)


def with_histories(cells: DataFrame) -> DataFrame:
    """The cells, written by user, with the number of them that the user has."""
    met = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return materialize(cells.withColumn("met", met), "cells")


def band_products(block_items: int) -> int:
    """Products of a band: as many as a square has cells, twice, as they are formed twice."""
    return 2 * block_items**2


def products_of_item() -> Column:
    """Products of an item: a cell forms as many as its user has cells."""
    return F.sum("met").alias("products")


class Bands(NamedTuple):
    """Segment pairs of bands: those that a task can add up, and those split by user; and the
    first and last bands of each pass."""

    light: DataFrame
    heavy: DataFrame | None
    grid: Grid
    passes: list[tuple[int, int]]

    def apply(
        self, of_tile: TileTask, of_sums: TileTask, schema: str, then: Callable[[DataFrame], DataFrame] = lambda found: found
    ) -> DataFrame:
        """What the tasks find, and `then` makes of it, written pass by pass, so that the disk
        holds the shuffle of one pass. Segment pairs are packed before they are shuffled."""
        found = []
        for first, last in self.passes:
            among = F.col("a").between(first, last)
            out = _packed(self.light.where(among)).groupBy("a", "b").applyInArrow(of_tile, schema)
            if self.heavy is not None:
                slabs = _packed(self.heavy.where(among)).groupBy("a", "b", "slab")
                sums = slabs.applyInArrow(sums_of_slab(self.grid), SUMS)
                out = out.unionByName(sums.groupBy("a", "b").applyInArrow(of_sums, schema))
            found.append(materialize(then(out), "found"))
        return reduce(DataFrame.unionByName, found)


def _packed(pairs: DataFrame) -> DataFrame:
    return pairs.mapInArrow(*packed_by_band({f.name: f.dataType.simpleString() for f in pairs.schema}))


def banded(
    cells: DataFrame,
    items: DataFrame,
    size: FactSize,
    band_products: int,
    tile_rows: int,
    k: int = 0,
    only_items: DataFrame | None = None,
    symmetric: bool = False,
    head: Column | None = None,
) -> tuple[DataFrame, Bands]:
    """`items` with `left_code`, and the bands of `items`, or of `only_items`, by all items;
    `cells` are `with_histories` and `items` have `products`.

    Bands are ranges of codes with about `band_products` products each, so a user is sent to
    as many tasks as the user's items fall in ranges, with the whole history once in each. With
    `head`, of a cell and the `cut` of its item, only cells where it holds are on the right; with
    `symmetric`, a pair is added up once, with the lower code on the left.
    """
    wanted = items
    if only_items is not None:
        wanted = items.join(only_items.select("item_id").distinct(), "item_id", "left_semi")
    totals = running_totals(wanted.select("item_id", "code", "products"), ["code"], {"before": F.col("products")})
    band = F.floor(F.col("before") / band_products).cast("int")
    totals = totals.select("item_id", F.col("code").alias("left_code"), band.alias("a"))
    items = materialize(items.join(totals, "item_id", "left"), "bands")
    per_band = items.where(F.col("a").isNotNull()).groupBy("a").agg(
        F.sum("products").alias("products"), F.sum("listeners").alias("cells")
    )
    most = float(min(TILE_ENTRIES, TILE_PRODUCTS))
    slabs = F.ceil(F.greatest(F.col("products") / most, F.col("cells") / tile_rows))
    # Few: all products are at most the sum of theirs.
    heavy = materialize(per_band.select("a", slabs.alias("slabs")).where("slabs > 1"), "heavy-bands")
    count, norm = _narrow(cells, items)
    heads, cut = ([], []) if head is None else ([head.alias("head")], ["cut"])
    weighted = lookup(
        cells, items.select("item_id", "code", "a", "norm", "listeners", *cut), "item_id", "listeners", size
    )
    weighted = weighted.select("user_id", "met", "code", "a", count.alias("w"), norm.alias("n"), *heads)
    weighted = weighted.repartition("user_id")
    short = min(PART_CELLS, CHUNK_CELLS)
    any_long = (cells.agg(F.max("met")).first()[0] or 0) > short
    whole = _whole_histories(weighted.where(F.col("met") <= short))
    long = weighted.where(F.col("met") > short) if any_long else None

    def tiles_of(among: Column) -> DataFrame:
        tiles = _band_tiles(whole, among, symmetric)
        if not any_long:
            return tiles
        left = long.where(F.col("a").isNotNull() & among).groupBy("user_id", F.col("a").alias("block"))
        left = left.agg(F.collect_list(_entry()).alias("cells")).select("user_id", "block", *_entries())
        right = _chunks(long.where("head") if heads else long)
        # There are at most as many bands as items. Heads are fewer than the history.
        all_cells = not heads and only_items is None
        return tiles.unionByName(_tiles(left, right, size.keys, False, whole_history=all_cells))

    grid = Grid(1, 1, max(size.keys, 1), max(size.keys, 1), symmetric, k, DIGITS, bands=True)
    passes = _passes(per_band, whole, long, size.facts)
    if heavy.isEmpty():
        return items, Bands(tiles_of(F.lit(True)).drop("user_id"), None, grid, passes)
    # Few: a heavy band has a share of all products.
    bands = [row["a"] for row in heavy.select("a").collect()]
    split = tiles_of(F.col("a").isin(bands)).join(F.broadcast(heavy), "a")
    return items, Bands(tiles_of(~F.col("a").isin(bands)).drop("user_id"), _slabs(split), grid, passes)


def _passes(
    per_band: DataFrame, whole: DataFrame, long: DataFrame | None, facts: int
) -> list[tuple[int, int]]:
    """The first and last bands of passes that shuffle about as many entries each, which are a
    few times the cells, however often histories are sent."""
    most = max(PASS_ENTRIES, PASS_OF_CELLS * facts)
    # A cell in a band brings as many entries as it forms products, or fewer.
    products, last = per_band.agg(F.sum("products"), F.max("a")).first()
    if (products or 0) <= most:
        return [(0, last or 0)]
    entries = whole.select(F.explode(_bands_of("cells")).alias("a"), F.size("cells").alias("n"))
    if long is not None:
        sent = long.where(F.col("a").isNotNull()).select("user_id", "a", F.col("met").cast("int").alias("n")).distinct()
        entries = entries.unionByName(sent.select("a", "n"))
    entries = entries.groupBy("a").agg(F.sum("n").alias("n"))
    totals = running_totals(entries, ["a"], {"before": F.col("n")})
    first = totals.groupBy(F.floor(F.col("before") / most).alias("pass")).agg(F.min("a").alias("a"))
    # As many as the cells are sent, by `PASS_OF_CELLS`.
    starts = sorted(row["a"] for row in first.collect())
    return list(zip(starts, [a - 1 for a in starts[1:]] + [last]))


def _whole_histories(weighted: DataFrame) -> DataFrame:
    """The cells of each user in order of code, written, as passes read them again."""
    more = ["head"] if "head" in weighted.columns else []
    cell = F.struct(F.col("code").cast("int").alias("i"), "w", "n", "a", *more)
    whole = weighted.groupBy("user_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return materialize(whole, "histories")


def _bands_of(cells: str) -> Column:
    return F.array_distinct(F.filter(f"{cells}.a", lambda a: a.isNotNull()))


def _band_tiles(whole: DataFrame, among: Column, half: bool) -> DataFrame:
    """The bands of each user's history that are `among` those asked for, with the whole
    history, or the heads of it, on the right; of `half`, what follows the first on the left."""
    heads = "head" in whole.select(F.col("cells")[0].alias("c")).select("c.*").columns
    met = whole.select("user_id", "cells", F.explode(_bands_of("cells")).alias("a")).where(among)
    left = F.filter("cells", lambda c: c["a"] == F.col("a"))
    met = met.select("user_id", "cells", "a", F.lit(0).alias("b"), left.alias("left"))
    keep = [lambda c: c["head"]] * heads + [lambda c: c["i"] > F.col("left")[0]["i"]] * half
    right = F.filter("cells", lambda c: reduce(Column.__and__, [k(c) for k in keep])) if keep else F.col("cells")
    met = met.select("user_id", "a", "b", "left", right.alias("right"))
    names = [F.col(f"{side}.{x}").alias(f"{x}{end}") for side, end in (("left", "a"), ("right", "b")) for x in "iwn"]
    return met.select("user_id", "a", "b", *names)


def _narrow(cells: DataFrame, items: DataFrame) -> tuple[Column, Column]:
    """Counts in the smallest type that holds all, and norms as their squares if whole."""
    count, norm = F.col("play_count"), F.col("norm")
    if not isinstance(cells.schema["play_count"].dataType, T.IntegralType):
        return count.cast("double"), norm
    low, high = cells.agg(F.min("play_count"), F.max("play_count")).first()
    most = max(-(low or 0), high or 0)
    kind = next((t for t, end in WHOLE.items() if most <= end), "double")
    square = F.round(norm * norm)
    whole = F.bool_and((F.sqrt(square) == norm) & (square <= WHOLE["int"]))
    squares = items.agg(F.coalesce(whole, F.lit(False))).first()[0]
    return count.cast(kind), square.cast("int") if squares else norm


def nearest_by_pairs(
    cells: DataFrame, listened_cells: DataFrame, k: int, norms: DataFrame | None = None
) -> DataFrame:
    """The k nearest items of the few items in `listened_cells`, which is broadcast.

    `listened_cells` holds all cells of these items; the caller has checked its size. If
    `cells` are not the whole matrix but only its users with such an item, `norms` has the
    norms of the whole. The products are summed before the norms divide them, so the sums
    are exact.
    """
    count = F.col("play_count").cast("double")
    own_norms = item_norms(listened_cells).select("item_id", F.col("norm").alias("own_norm"))
    listened = listened_cells.select("user_id", "item_id", count.alias("own_count"))
    others = cells.select("user_id", F.col("item_id").alias("neighbor_id"), count.alias("count"))
    norms = item_norms(cells) if norms is None else norms
    norms = norms.select(F.col("item_id").alias("neighbor_id"), "norm")
    order = Window.partitionBy("item_id").orderBy(F.desc("similarity"), "neighbor_id")
    return (
        others.join(F.broadcast(listened), "user_id")
        .where(F.col("item_id") != F.col("neighbor_id"))
        .groupBy("item_id", "neighbor_id")
        .agg(F.sum(F.col("own_count") * F.col("count")).alias("dot"))
        .join(norms, "neighbor_id")
        .join(F.broadcast(own_norms), "item_id")
        .select(
            "item_id",
            "neighbor_id",
            cosine(F.col("dot"), F.col("own_norm"), F.col("norm")).alias("similarity"),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def _block_count(items: int, block_items: int, cores: int) -> int:
    """Blocks of at most `block_items` items, and enough tiles to keep the cores busy."""
    return max(min(items, max(ceil(items / block_items), min(isqrt(4 * cores) + 1, 64))), 1)


def _segments(weighted: DataFrame, code: str, blocks: int) -> DataFrame:
    """Each user's history as one row per item block, at most one block long.

    Codes are dealt to the blocks in turn, so blocks are of equal size and a run of
    popular neighbours in id order spreads over all of them.
    """
    return (
        weighted.groupBy("user_id", (F.col(code) % blocks).cast("int").alias("block"))
        .agg(
            F.collect_list(
                F.struct(F.floor(F.col(code) / blocks).cast("int").alias("i"), "w", "n")
            ).alias("cells")
        )
        .select("user_id", "block", *_entries())
    )


def _chunks(weighted: DataFrame) -> DataFrame:
    """Each user's history in as few rows as its length allows, with whole item codes."""
    chunks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("user_id")) / CHUNK_CELLS)
    return (
        weighted.withColumn("chunk", F.pmod(F.xxhash64("code"), chunks))
        .groupBy("user_id", "chunk")
        .agg(
            F.collect_list(_entry()).alias("cells")
        )
        .select("user_id", F.lit(0).alias("block"), *_entries())
    )


def _entry() -> Column:
    return F.struct(F.col("code").cast("int").alias("i"), "w", "n")


def _entries() -> list[Column]:
    """Places, counts and norms of the items of a segment, as three arrays."""
    return [F.col(f"cells.{name}").alias(name) for name in ("i", "w", "n")]


def _bands_are_cheaper(
    cells: DataFrame, items: int, blocks: int, band_items: int, k: int
) -> bool:
    """Compare the bytes that either shape of the tiles would shuffle: the segments of all
    users, and the candidates, which every item has in each block it is compared with.
    """
    if blocks <= FEW_BLOCKS:
        return False
    n = F.col("n")
    in_blocks = F.least(n, F.lit(blocks))
    in_bands = F.least(n, F.lit(ceil(items / band_items)))
    chunks = F.ceil(n / CHUNK_CELLS)
    squares = (in_blocks * in_blocks * PAIR_BYTES + 2 * n * in_blocks * ENTRY_BYTES) / 2
    bands = in_bands * chunks * PAIR_BYTES + n * (in_bands + chunks) * ENTRY_BYTES
    cost = (
        cells.groupBy("user_id")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .agg(F.sum(squares).alias("squares"), F.sum(bands).alias("bands"))
        .first()
    )
    candidates = items * (k + 1) * CANDIDATE_BYTES
    return cost["bands"] + candidates < cost["squares"] + candidates * blocks


def _tiles(
    left: DataFrame, right: DataFrame, left_blocks: int, symmetric: bool, whole_history: bool
) -> DataFrame:
    """Pairs of segments of one user, one row per user and pair of blocks."""
    a = left.select("user_id", F.col("block").alias("a"), F.col("i").alias("ia"),
                    F.col("w").alias("wa"), F.col("n").alias("na"))
    b = right.select("user_id", F.col("block").alias("b"), F.col("i").alias("ib"),
                     F.col("w").alias("wb"), F.col("n").alias("nb"))
    keys = ["user_id"]
    if left_blocks > SEGMENTS_PER_TASK:
        # Deal the left segments of a long history to several tasks and send its right
        # ones to each of these.
        def parts(entries: str) -> Column:
            if not whole_history:
                return F.lit(ceil(left_blocks / SEGMENTS_PER_TASK)).cast("long")
            length = F.sum(F.size(entries)).over(Window.partitionBy("user_id"))
            return F.ceil(length / PART_CELLS)

        a = a.withColumn("part", F.col("a") % parts("ia"))
        b = b.withColumn("parts", parts("ib")).select(
            "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        ).drop("parts")
        keys.append("part")
    # Both sides are partitioned alike already; broadcasting one would only copy it.
    pairs = a.join(b.hint("merge"), keys)
    if symmetric:
        # Half of the tiles; within the diagonal ones a lone item has no partner.
        pairs = pairs.where(
            (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.size("ia") > 1))
        )
    return pairs.select("user_id", "a", "b", "ia", "wa", "na", "ib", "wb", "nb")


def _block_cells(items: DataFrame, code: str, blocks: int, block: str, name: str) -> DataFrame:
    """Cells per block, one row per block, from the listeners of its items."""
    return (
        items.where(F.col(code).isNotNull())
        .groupBy((F.col(code) % blocks).cast("int").alias(block))
        .agg(F.sum("listeners").alias(name))
    )


def _largest_tile(items: DataFrame, grid: Grid) -> int:
    """Bound on the rows of a tile: it has at most as many as either block has cells."""
    left = _block_cells(items, "left_code", grid.left_blocks, "a", "n")
    right = _block_cells(items, "code", grid.right_blocks, "b", "n")
    return min(side.agg(F.max("n")).first()[0] or 0 for side in (left, right))


def _heavy_tiles(left: DataFrame, right: DataFrame, cells: int, grid: Grid) -> DataFrame | None:
    """The products of each tile, if one may have more than a task should form."""
    # A cell of a tile's side meets at most all items of the other side.
    if cells * min(grid.height, grid.width) <= TILE_PRODUCTS:
        return None
    a = left.select("user_id", F.col("block").alias("a"), F.size("i").cast("double").alias("la"))
    b = right.select("user_id", F.col("block").alias("b"), F.size("i").cast("double").alias("lb"))
    pairs = a.join(b.hint("merge"), "user_id")
    if grid.symmetric:
        pairs = pairs.where(F.col("a") <= F.col("b"))
    products = pairs.groupBy("a", "b").agg(F.sum(F.col("la") * F.col("lb")).alias("products"))
    products = materialize(products.where(F.col("products") > TILE_PRODUCTS), "heavy-tiles")
    return None if products.isEmpty() else products


def _slab_counts(
    tiles: DataFrame, items: DataFrame, grid: Grid, tile_rows: int, products: DataFrame | None = None
) -> DataFrame:
    """The tiles of squares with the slabs each is split into, by its rows and its products."""
    # One row per block, of which there are at most a quarter of the items.
    left = _block_cells(items, "left_code", grid.left_blocks, "a", "cells_a")
    right = _block_cells(items, "code", grid.right_blocks, "b", "cells_b")
    slabs = F.ceil(F.least("cells_a", "cells_b") / tile_rows)
    if products is not None:
        # The tiles with too many products only, of which there are few or the join shuffles.
        few = products.count() <= MAX_BROADCAST_ROWS
        tiles = tiles.join(F.broadcast(products) if few else products, ["a", "b"], "left")
        heavy = F.ceil(F.coalesce("products", F.lit(0.0)) / TILE_PRODUCTS)
        slabs = F.greatest(slabs, heavy)
    return tiles.join(F.broadcast(left), "a").join(F.broadcast(right), "b").withColumn("slabs", slabs)


def _slabs(tiles: DataFrame) -> DataFrame:
    """Split each tile into its `slabs` by user, so that no task gets too much."""
    slab = F.pmod(F.xxhash64("user_id"), F.col("slabs")).cast("int")
    return tiles.select("a", "b", slab.alias("slab"), "ia", "wa", "na", "ib", "wb", "nb")


def _merge(best: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The candidates of all tiles, by id, cut to the best k per item."""
    own = items.select("left_code", "item_id", F.col("code").alias("own_code"), "listeners")
    other = items.select(F.col("code").alias("right_code"), F.col("item_id").alias("neighbor_id"))
    order = Window.partitionBy("left_code").orderBy(F.desc("similarity"), "right_code")
    return (
        best.join(own, "left_code")
        .where(F.col("own_code") != F.col("right_code"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .join(other, "right_code")
        .select("item_id", "neighbor_id", "similarity", "rank", "listeners")
    )
