"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_path(path: Column) -> Column:
    """A file URI as a plain path: `file:///x`, `file:/x` and `/x` all give `/x`."""
    return F.regexp_replace(path, r"^file:(//)?", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def text(value: Column) -> Column:
    """UTF-8 bytes as a string."""
    return F.decode(value, "UTF-8")


def null_flag(value: Column) -> Column:
    """1 for null, else 0. NaN is a value, not a null."""
    return value.isNull().cast("int")


def nan_flag(value: Column) -> Column:
    """1 for NaN, else 0 (also for null)."""
    return F.coalesce(F.isnan(value).cast("int"), F.lit(0))


def typed(value: Column, kind: T.DataType) -> Column:
    """Text as a value of `kind`, or null where the text does not hold one.

    Whole numbers accept a fractional part and drop it towards zero, so "12.7" is 12;
    NaN has no whole number and gives null.
    """
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BinaryType):
        return F.encode(value, "UTF-8")
    # The JSON reader gives the tokens NaN and Infinity as text in quotes.
    number = F.btrim(value, F.lit('"'))
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.coalesce(number.try_cast(kind), number.try_cast("double").try_cast(kind))
    if isinstance(kind, T.ArrayType):
        parts = F.from_json(value, T.ArrayType(T.StringType()))
        whole = F.transform(parts, lambda part: typed(part, kind.elementType))
        broken = F.exists(
            parts, lambda part: part.isNotNull() & typed(part, kind.elementType).isNull()
        )
        return F.when(~broken, whole)
    return number.try_cast(kind)


def number(value: Column, kind: str) -> Column:
    """A numeric column as `kind`; whole numbers are cut towards zero, NaN gives null."""
    return value.try_cast(kind)


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity to nine digits; 0 where an item has no weight at all.

    Divided and rounded once, by the same steps as in the tasks of the blocked search.
    """
    exact = F.coalesce(dot / F.nullif(norm_a * norm_b, F.lit(0.0)), F.lit(0.0))
    return F.floor(exact * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def report_line(position: Column, artist: Column, title: Column, unnamed: Column) -> Column:
    """`1. Artist - Title`, or `1. [song_id] id` for a song without a name."""
    place = F.concat(position.cast("string"), F.lit(". "))
    return F.when(unnamed, F.concat(place, F.lit("[song_id] "), artist)).otherwise(
        F.concat(place, artist, F.lit(" - "), title)
    )
