"""Arrays stored end to end: one flat run of values and a start offset per row.

A row's array runs from its offset to the next row's, the last one's to the end of the
run. The values may be arrays themselves, which gives two-dimensional slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetally.schemas import offset_column

# Positions per bucket of the range join between values and slices.
BUCKET = 256


def slice_arrays(df: DataFrame, flat: str, offsets: str, name: str = "slice") -> DataFrame:
    """Slice a container that holds its flat run and its offsets as two arrays.

    One row per offset: the other columns, `row_no` from 0 and the slice.
    """
    end = F.coalesce(
        F.try_element_at(F.col(offsets), F.col("row_no") + 2), F.size(flat)
    )
    return (
        df.select("*", F.posexplode(offsets).alias("row_no", "_start"))
        .withColumn(
            name, F.slice(F.col(flat), F.col("_start") + 1, F.greatest(end - F.col("_start"),
                                                                      F.lit(0)))
        )
        .drop(flat, offsets, "_start")
    )


def slice_rows(offsets: DataFrame, values: DataFrame, container: str) -> DataFrame:
    """Slice runs that are tables, leaving one row per value.

    In `offsets(container, row_no, start, …)` the rows of a container are numbered without
    gaps; `start` and the `pos` of `values(container, pos, value)` count alike. The result has the columns of `offsets` with
    `pos` and `value`. Every join is on the container and a row number or a bucket of
    positions, so one container of any length spreads over all tasks.
    """
    last = offsets.groupBy(container).agg(F.max("row_no").alias("row_no"))
    length = values.groupBy(container).agg((F.max("pos") + 1).alias("end"))
    ends = offsets.select(
        container, (F.col("row_no") - 1).alias("row_no"), F.col("start").alias("end")
    ).unionByName(last.join(length, container))
    spans = (
        offsets.join(ends, [container, "row_no"])
        .where(F.col("end") > F.col("start"))
        .withColumn("_first", F.floor(F.col("start") / BUCKET))
        .withColumn("_last", F.floor((F.col("end") - 1) / BUCKET))
        .withColumn("_bucket", F.explode(F.sequence("_first", "_last")))
    )
    return (
        values.withColumn("_bucket", F.floor(F.col("pos") / BUCKET))
        .join(spans, [container, "_bucket"])
        .where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
        .select(*offsets.columns, "pos", "value")
    )


def slice_table(
    offsets: DataFrame, values: DataFrame, container: str, name: str = "slice"
) -> DataFrame:
    """As `slice_rows`, with each row's values as one array; an empty slice is empty.

    A slice has to fit one row; `slice_rows` has no such bound.
    """
    filled = (
        slice_rows(offsets, values, container)
        .groupBy(container, "row_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_cells"))
        .select(container, "row_no", F.col("_cells.value").alias(name))
    )
    empty = F.array().cast(f"array<{values.schema['value'].dataType.simpleString()}>")
    return (
        offsets.join(filled, [container, "row_no"], "left")
        .withColumn(name, F.coalesce(F.col(name), empty))
        .drop("start")
    )


def song_arrays(songs: DataFrame, values: DataFrame, field: str) -> DataFrame:
    """One ragged field of the songs of many files: `source_file`, `row_no` and the array.

    `songs` has `source_file`, `row_no` and the field's offset column; `values` is the
    field's run of each file, `(source_file, pos, value)`.
    """
    offsets = songs.select("source_file", "row_no", F.col(offset_column(field)).alias("start"))
    return slice_table(offsets, values, "source_file", field)
