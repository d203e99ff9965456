"""Prefix sums over a sorted table, dense ids, distinct values and their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.session import materialize

# An offset up to this many rows is a top-n; a larger one uses dense positions.
MAX_TOP_ROWS = 10_000


def running_totals(df: DataFrame, order_by: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Add, per entry of `amounts` (whole numbers), its sum over all rows before this one.

    The table is range-partitioned by `order_by` and each range is summed while it passes
    through its task, so no task holds more than a batch and there is one shuffle. Rows
    with equal order share a range: count copies first. The ranges are written down: their
    borders come from sampling and must not move between the passes that use them.
    """
    names = list(amounts)
    own = df.withColumns({f"_{n}": F.coalesce(a, F.lit(0)).cast("long") for n, a in amounts.items()})
    sums = [T.StructField(f"_before_{n}", T.LongType()) for n in names]
    schema = T.StructType([*own.schema, *sums, T.StructField("_range", T.IntegerType())])
    places = [own.columns.index(f"_{n}") for n in names]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, totals = TaskContext.get().partitionId(), [0] * len(places)
        for batch in batches:
            before = []
            for k, place in enumerate(places):
                amount = batch.column(place).to_numpy()
                after = totals[k] + np.cumsum(amount)
                before.append(pa.array(after - amount))
                totals[k] = int(after[-1]) if len(after) else totals[k]
            ranges = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, ranges], names=schema.names)

    ranged = own.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ranged = materialize(ranged.mapInArrow(add_up, schema), "ranges")
    # One row per range, so at most one per shuffle partition.
    per_range = ranged.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in names]
    )
    return ranged.join(F.broadcast(starts), "_range").select(
        *df.columns, *[(F.col(f"_start_{n}") + F.col(f"_before_{n}")).alias(n) for n in names]
    )


def one_row() -> Column:
    """The amount that makes a running total count rows."""
    return F.lit(1).cast("long")


def encode_ids(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """Number the rows of a table of distinct ids 0, 1, 2, … in id order."""
    return running_totals(df, [id_col], {code: one_row()})


def distinct_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col).where(F.col(id_col).isNotNull()).distinct()


def first_seen(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Distinct ids with the place of their first appearance."""
    return (
        df.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(order_col).alias("first_seen"))
    )


def nth_seen(df: DataFrame, id_col: str, order_col: str, n: int) -> DataFrame:
    """The n-th distinct id, from 0, in order of first appearance."""
    firsts = first_seen(df, id_col, order_col)
    if n < MAX_TOP_ROWS:
        return firsts.orderBy("first_seen", id_col).offset(n).limit(1)
    places = running_totals(firsts, ["first_seen", id_col], {"_place": one_row()})
    return places.where(F.col("_place") == n).drop("_place")
