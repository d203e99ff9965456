"""Nearest items that follow new plays: a batch is added to a stored matrix as a version.

The cells of the matrix are stored by user, in a folder with one part per version. A version adds
what its plays add to the counts; reading sums the versions up, and `compact` writes the sums as
a new base. The lists are those of one fit of the summed cells, in tiles. The dot products of
all pairs are not stored: there are as many as the squares of the histories add up to, many
times the cells, and each reading would sort them all.

All sums are whole numbers, so any order of updates gives the same digits as one fit of all
plays. A version counts once its marker is written, and one that failed is written again.
`changes` and `changed_dots` tell what a batch changes, `pair_dots` are the products of all pairs.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetally.operators import similarity
from tunetally.operators.ids import encode_ids
from tunetally.operators.lookup import FactSize, lookup
from tunetally.operators.similarity import interaction_matrix, item_norms
from tunetally.operators.tiles import SUMS, Grid, sums_of_slab
from tunetally.session import materialize, shuffles_deleted

# Folders of users; an update opens those of its users.
PARTS = 64
# Changed cells of one user that one task joins with the user's history.
CHANGED_CELLS = 4_096
CELLS, MARKERS = "cells", "versions"
SCHEMA = "user_id {user}, item_id {item}, play_count long, part int"


class State(NamedTuple):
    """The written version that reading starts from, the last one, and the types of ids."""

    base: int
    last: int
    user: str
    item: str


def start(plays: DataFrame, path: str) -> int:
    """Write version 0 of the matrix from the plays there are."""
    return _write(path, 0, 0, interaction_matrix(plays))


def add(spark: SparkSession, path: str, plays: DataFrame) -> int:
    """Write the next version, with what `plays` add, and return its number."""
    state = read_state(spark, path)
    return _write(path, state.last + 1, state.base, interaction_matrix(plays))


def cells_of(spark: SparkSession, path: str, state: State, delta: DataFrame) -> DataFrame:
    """The cells of the users of `delta`, from the folders these are in."""
    users = delta.select("user_id").distinct().withColumn("part", _part())
    parts = [row["part"] for row in users.select("part").distinct().collect()]  # PARTS at most
    cells = _read(spark, path, state)
    return cells.where(F.col("part").isin(parts)).join(users, ["part", "user_id"], "left_semi")


def changes(delta: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changed cells, and all cells of their users: `old` count, `more` that is added
    (null where nothing is), `known` if the cell was there."""
    old = cells.groupBy("user_id", "item_id").agg(F.sum("play_count").alias("known"))
    more = delta.select("user_id", "item_id", F.col("play_count").alias("more"))
    both = old.join(more, ["user_id", "item_id"], "full_outer")
    history = materialize(both.withColumn("old", F.coalesce("known", F.lit(0).cast("long"))), "history")
    return history.where(F.col("more").isNotNull()), history


def changed_dots(changed: DataFrame, history: DataFrame) -> DataFrame:
    """What changed cells add to the dot products of pairs, `item_a` below `item_b`.

    A user with many changed cells has them dealt to several tasks.
    """
    tasks = changed.groupBy("user_id").agg(
        F.ceil(F.count(F.lit(1)) / CHANGED_CELLS).alias("tasks")
    )
    deal = F.pmod(F.xxhash64("item_id"), F.col("tasks"))
    left = changed.join(tasks, "user_id").select(
        "user_id", deal.alias("task"), F.col("item_id").alias("item"),
        F.col("old").alias("c"), F.col("more").alias("d"),
    )
    right = history.join(tasks, "user_id").select(
        "user_id", F.col("item_id").alias("other"), F.col("old").alias("oc"), F.col("more").alias("od"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"),
    )
    pairs = left.join(right, ["user_id", "task"]).where(
        # Two changed cells meet twice and count once.
        (F.col("item") != F.col("other")) & (F.col("od").isNull() | (F.col("item") < F.col("other")))
    )
    both = (F.col("c") + F.col("d")) * (F.col("oc") + F.col("od")) - F.col("c") * F.col("oc")
    return _paired(
        pairs.select(
            F.col("item").alias("x"), F.col("other").alias("y"),
            F.when(F.col("od").isNull(), F.col("d") * F.col("oc")).otherwise(both).alias("dot"),
        )
    ).groupBy("item_a", "item_b").agg(F.sum("dot").alias("dot"))


def _paired(pairs: DataFrame) -> DataFrame:
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(low.alias("item_a"), high.alias("item_b"), "dot")


def pair_dots(cells: DataFrame, block_items: int = similarity.BLOCK_ITEMS) -> DataFrame:
    """The dot product of every two items with a common listener, added up in tiles, each
    split by user so that no task has too many rows."""
    items = materialize(encode_ids(item_norms(cells), "item_id", "code"), "items")
    size = FactSize.measure(items, "listeners")
    cores = cells.sparkSession.sparkContext.defaultParallelism
    blocks = similarity._block_count(size.keys, block_items, cores)
    weighted = (
        lookup(cells, items, "item_id", "listeners", size)
        .select("user_id", "code", F.col("play_count").cast("double").alias("w"), F.col("norm").alias("n"))
        .repartition("user_id")
    )
    side = similarity._segments(weighted, "code", blocks)
    height = ceil(size.keys / blocks)
    grid = Grid(blocks, blocks, height, height, symmetric=True, k=0, digits=similarity.DIGITS)
    tiles = similarity._tiles(side, side, blocks, True, whole_history=True)
    items = items.withColumn("left_code", F.col("code"))
    slabs = similarity._slabs(similarity._slab_counts(tiles, items, grid, similarity.TILE_ROWS))
    sums = slabs.groupBy("a", "b", "slab").applyInArrow(sums_of_slab(grid), SUMS)
    cell = F.explode(F.arrays_zip("columns", "sums")).alias("cell")
    # A tile of a block with itself has both orders.
    once = (F.col("a") < F.col("b")) | (F.col("left_code") < F.col("right_code"))
    dots = sums.select("a", "b", "row", cell).select(
        "a", "b",
        (F.col("row").cast("long") * blocks + F.col("a")).alias("left_code"),
        (F.col("cell.columns").cast("long") * blocks + F.col("b")).alias("right_code"),
        F.col("cell.sums").cast("long").alias("dot"),
    ).where(once)
    dots = dots.groupBy("left_code", "right_code").agg(F.sum("dot").alias("dot"))
    for code, name in (("left_code", "x"), ("right_code", "y")):
        dots = dots.join(items.select(F.col("code").alias(code), F.col("item_id").alias(name)), code)
    return _paired(dots)


def nearest_items(spark: SparkSession, path: str, k: int) -> DataFrame:
    """As `similarity.nearest_items`, from the stored versions."""
    return similarity.nearest_items(_summed(spark, path, read_state(spark, path)), k)


def compact(spark: SparkSession, path: str) -> int:
    """Write the sums of all versions as a version that reading starts from."""
    state = read_state(spark, path)
    return _write(path, state.last + 1, state.last + 1, _summed(spark, path, state))


def _summed(spark: SparkSession, path: str, state: State) -> DataFrame:
    cells = _read(spark, path, state)
    return cells.groupBy("user_id", "item_id").agg(F.sum("play_count").alias("play_count"))


def _part():
    return F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int")


def _write(path: str, version: int, base: int, cells: DataFrame) -> int:
    by_user = cells.withColumn("part", _part()).repartition("part").sortWithinPartitions("part", "user_id")
    with shuffles_deleted(cells.sparkSession):
        by_user.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{CELLS}/version={version}")
    types = (F.lit(cells.schema[c].dataType.simpleString()) for c in ("user_id", "item_id"))
    marker = [F.lit(base), F.lit(version), *types]
    marker = cells.sparkSession.range(1).select(*(c.alias(n) for c, n in zip(marker, State._fields)))
    marker.write.mode("overwrite").parquet(f"{path}/{MARKERS}/v{version}")
    return version


def read_state(spark: SparkSession, path: str) -> State:
    markers = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{MARKERS}")
    return State(*markers.orderBy(F.desc("last")).select(*State._fields).first())


def _read(spark: SparkSession, path: str, state: State) -> DataFrame:
    schema = SCHEMA.format(user=state.user, item=state.item)
    folders = [f"{path}/{CELLS}/version={v}" for v in range(state.base, state.last + 1)]
    out = spark.read.schema(schema).parquet(folders[0])
    for folder in folders[1:]:
        out = out.unionByName(spark.read.schema(schema).parquet(folder))
    return out
