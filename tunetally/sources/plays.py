"""Plays as text: three tab-separated columns without a header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetally.schemas import PLAYS_COLUMNS

_POSITIONS = "c1 string, c2 string, c3 string"


def whole_number(value: Column, strict: bool = True) -> Column:
    """Text as an int; other text is an error, or null with `strict=False`."""
    number = value.try_cast("int")
    if not strict:
        return number
    message = F.concat(F.lit("not a whole number: "), value)
    return F.when(value.isNotNull() & number.isNull(), F.raise_error(message)).otherwise(number)


def read_plays_tsv(
    spark: SparkSession,
    path: str,
    names: Sequence[str] = PLAYS_COLUMNS,
    strict: bool = True,
) -> DataFrame:
    """Plays with columns named by position and the third as an int.

    A line with more columns is an error, or has a null count with `strict=False`.
    """
    count = names[2]
    lines = (
        spark.read.schema(f"{_POSITIONS}, c4 string")
        .option("sep", "\t")
        .csv(path)
        .toDF(*names, "_more")
    )
    more = F.col("_more").isNotNull()
    number = whole_number(F.col(count), strict)
    if strict:
        message = F.concat(F.lit("more than three columns: "), F.concat_ws(" ", *names, "_more"))
        number = F.when(more, F.raise_error(message).cast("int")).otherwise(number)
    else:
        number = F.when(~more, number)
    return lines.withColumn(count, number).drop("_more")


def write_plays_tsv(plays: DataFrame, path: str) -> None:
    plays.write.mode("overwrite").option("sep", "\t").csv(path)
