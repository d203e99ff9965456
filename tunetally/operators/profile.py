"""Counts, summaries, null counts, top lists and samples of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.functions.columns import nan_flag, null_flag
from tunetally.operators.ids import running_totals

QUARTILES = (0.25, 0.5, 0.75)
SUMMARY = ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


def overview(plays: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct users and distinct items in one pass."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return plays.agg(
        F.count(F.lit(1)).alias("interactions"),
        distinct("user_id").alias("users"),
        distinct("item_id").alias("items"),
    )


def top_by_plays(plays: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    """The n ids with the most plays; equal totals by id."""
    return (
        plays.groupBy(id_col)
        .agg(F.sum("play_count").alias("total_plays"))
        .orderBy(F.desc("total_plays"), id_col)
        .limit(n)
    )


def sample_rows(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*order_by).limit(n)


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls and NaNs per column: `column`, `nulls`, `nans`. One pass, one row per column."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    zero = F.lit(0).cast("long")
    counted = df.agg(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.coalesce(F.sum(null_flag(F.col(name))), zero).alias("nulls"),
                (F.coalesce(F.sum(nan_flag(F.col(name))), zero) if name in floats else zero)
                .alias("nans"),
            ).alias(f"c{i}")
            for i, name in enumerate(df.columns)
        ]
    )
    return counted.select(_rows([F.col(c) for c in counted.columns]))


def schema_listing(df: DataFrame) -> DataFrame:
    """`position`, `column`, `type`, `nullable` and the number of values of each column."""
    counted = df.agg(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(field.nullable).alias("nullable"),
                F.count(field.name).alias("values"),
            ).alias(f"c{i}")
            for i, field in enumerate(df.schema)
        ]
    )
    return counted.select(_rows([F.col(c) for c in counted.columns]))


def numeric_summary(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per numeric column.

    The quartiles are `percentile_approx`'s, in the same pass. With `exact` they are
    interpolated from all values, and everything comes from one table of distinct values.
    """
    if exact:
        rows = _exact_summary(df, columns, list(QUARTILES))
        absent = [F.struct(F.lit(c).alias("column")) for c in columns]
        # A column without values has a row as well.
        named = df.sparkSession.range(1).select(_rows(absent))
        rows = named.join(rows, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    else:
        wide = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.mean(c).cast("double").alias("mean"),
                    F.stddev_samp(c).alias("stddev"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                    F.percentile_approx(F.col(c).cast("double"), list(QUARTILES)).alias("quartiles"),
                ).alias(f"c{i}")
                for i, c in enumerate(columns)
            ]
        )
        rows = wide.select(_rows([F.col(c) for c in wide.columns]))
    return rows.select(
        "column",
        "count",
        "mean",
        "stddev",
        "min",
        *[F.col("quartiles")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))],
        "max",
    )


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact interpolated quantiles: `column`, `quartiles` (an array, one per share)."""
    return _exact_summary(df, columns, shares).select("column", "quartiles")


def _exact_summary(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Count, mean, sample deviation, min, max and quantiles of the columns with values.

    Equal values are counted first, and a running total over the sorted distinct values
    finds the ones at the wanted places: no task holds all values of a column, and the
    source is read once.
    """
    values = (
        df.select(
            _rows(
                [
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        )
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    placed = running_totals(values, ["column", "value"], {"before": F.col("copies")})
    # The running total goes on from column to column; each starts at its lowest place.
    spans = placed.groupBy("column").agg(
        F.min("before").alias("start"),
        F.sum("copies").alias("total"),
        (F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    first = F.col("before") - F.col("start")

    def value_at(place: Column) -> Column:
        here = (first <= place) & (place < first + F.col("copies"))
        return F.max(F.when(here, F.col("value")))

    at = [F.lit(share) * (F.col("total") - 1) for share in shares]
    off = F.col("value") - F.col("mean")
    found = (
        placed.join(F.broadcast(spans), "column")
        .groupBy("column", "total", "mean", "min", "max")
        .agg(
            F.sum(off * off * F.col("copies")).alias("squares"),
            *[value_at(F.floor(place)).alias(f"low{i}") for i, place in enumerate(at)],
            *[value_at(F.ceil(place)).alias(f"high{i}") for i, place in enumerate(at)],
        )
    )
    return found.select(
        "column",
        F.col("total").alias("count"),
        "mean",
        F.when(F.col("total") > 1, F.sqrt(F.col("squares") / (F.col("total") - 1))).alias("stddev"),
        "min",
        "max",
        F.array(
            *[
                F.col(f"low{i}")
                + (F.col(f"high{i}") - F.col(f"low{i}")) * (place - F.floor(place))
                for i, place in enumerate(at)
            ]
        ).alias("quartiles"),
    )
