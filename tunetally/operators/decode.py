"""Record payloads to typed rows, with a stated policy for bad records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.functions.columns import number, text, typed
from tunetally.schemas import (
    RAGGED_SONG_FIELDS,
    RAW_SONG_FIELDS,
    SCALAR_SONG_FIELDS,
    SONG_COLUMNS,
)

_BROKEN = "_broken"
_GOOD = "_good_record"


def _parsed(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """The fields of a JSON record as columns of text, and `_broken` if it is no record.

    The record is parsed in a generator, which filters on its fields do not pass: a
    filter on a plain column would parse the payload again for every field it names.
    """
    fields = [T.StructField(f.name, T.StringType()) for f in schema]
    record = F.from_json(
        payload,
        T.StructType([*fields, T.StructField(_BROKEN, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN},
    )
    return df.select("*", F.inline(F.array(record)))


def _decoded(
    parsed: DataFrame, kept: list[str], schema: T.StructType, usable: Column | None = None
) -> DataFrame:
    values = {f.name: typed(F.col(f.name), f.dataType) for f in schema}
    if usable is not None:
        values = {name: F.when(usable, value) for name, value in values.items()}
    return parsed.select(*kept, *[value.alias(name) for name, value in values.items()])


def decode_null_bad(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """Decode `payload` into the columns of `schema`; a bad field is null, the row stays."""
    kept = [c for c in df.columns if c != payload]
    return _decoded(_parsed(df, payload, schema), kept, schema, F.col(_BROKEN).isNull())


def decode_drop_bad(
    df: DataFrame, payload: str, schema: T.StructType, counts: Observation | None = None
) -> DataFrame:
    """Decode `payload`; a record with any bad field is dropped.

    A number has to be there and be one; NaN is a fractional number but not a whole one.
    `counts` gets the number of `records`, `kept` and `dropped` from the pass that uses the
    result.
    """
    kept = [c for c in df.columns if c != payload]
    good = F.col(payload).isNotNull() & good_record(schema)
    parsed = _parsed(df, payload, schema)
    if counts is not None:
        good = F.coalesce(good, F.lit(False))
        parsed = parsed.withColumn(_GOOD, good)
        good = F.col(_GOOD)
        records = F.count(F.lit(1)).alias("records")
        parsed = parsed.observe(
            counts, records, F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped")
        )
    return _decoded(parsed.where(good), kept, schema)


def split_records(df: DataFrame, payload: str, every: bool) -> DataFrame:
    """Payloads that hold an array of records as one payload per record, or the first
    record only; other payloads stay as they are, an array that cannot be read is null.

    Adds `record_no`, the record's place in its payload from 0. An empty array has no rows.
    """
    records = F.from_json(payload, T.ArrayType(T.StringType()))
    packed = F.col(payload).rlike(r"^\s*\[")
    # What is no array is its own only record; so is an array that is broken, as a null.
    rows = F.when(packed, F.coalesce(records, F.array(F.lit(None).cast("string"))))
    rows = F.coalesce(rows, F.array(payload))
    if not every:
        rows = F.slice(rows, 1, 1)
    kept = [c for c in df.columns if c != payload]
    return df.select(*kept, F.posexplode(rows).alias("record_no", payload))


def good_record(schema: T.StructType) -> Column:
    """Whether a row of `_parsed` has every number that `schema` asks for."""
    good = F.col(_BROKEN).isNull()
    for field in schema:
        if not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            good = good & typed(F.col(field.name), field.dataType).isNotNull()
    return good


def record_counts(df: DataFrame, payload: str, schema: T.StructType, by: str) -> DataFrame:
    """Per value of `by`: the records read, and how many `decode_drop_bad` keeps and drops."""
    known = df.where(F.col(payload).isNotNull())
    return (
        _parsed(known, payload, schema)
        .select(by, F.when(good_record(schema), 1).alias("_good"))
        .unionByName(df.where(F.col(payload).isNull()).select(by, F.lit(None).cast("int").alias("_good")))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("records"), F.count("_good").alias("kept"))
        .withColumn("dropped", F.col("records") - F.col("kept"))
    )


def explode_records(df: DataFrame, records: str = "records") -> DataFrame:
    """One row per record of a container, with its place in it from 0."""
    return df.select(
        *[c for c in df.columns if c != records],
        F.posexplode(records).alias("record_no", "_record"),
    ).select("*", "_record.*").drop("_record")


def first_record(df: DataFrame, records: str = "records") -> DataFrame:
    """The first record of each container; an empty container gives none."""
    return (
        df.withColumn("_record", F.try_element_at(records, F.lit(1)))
        .where(F.col("_record").isNotNull())
        .select(*[c for c in df.columns if c != records], "_record.*")
    )


def records_per_container(df: DataFrame, container: str) -> DataFrame:
    """Number of records of each container, from its records as rows."""
    return df.groupBy(container).agg(F.count(F.lit(1)).alias("records"))


def decode_text(df: DataFrame, *columns: str) -> DataFrame:
    """Replace columns of UTF-8 bytes by their text."""
    return df.withColumns({c: text(F.col(c)) for c in columns})


def song_projection(df: DataFrame) -> DataFrame:
    """The typed song columns, in table order; one that `df` lacks is null."""
    have = dict(df.dtypes)

    def column(name: str, kind: str) -> Column:
        if name not in have:
            return F.lit(None).cast(kind)
        if have[name] == "binary":
            return text(F.col(name)).cast(kind)
        return F.col(name).cast(kind) if kind == "string" else number(F.col(name), kind)

    return df.select(*[column(n, k).alias(n) for n, k in SONG_COLUMNS.items()])


def song_fields(df: DataFrame, names: Iterable[str], source_file: str = "source_file") -> DataFrame:
    """The named song fields that `df` has, by name, as `get_<field>`, and the source file."""
    known = {*SCALAR_SONG_FIELDS, *RAGGED_SONG_FIELDS}
    unknown = sorted(set(names) - known)
    if unknown:
        raise ValueError(f"no such song fields: {', '.join(unknown)}")
    have = [name for name in sorted(names) if name in df.columns]
    return df.select(*[F.col(n).alias(f"get_{n}") for n in have], source_file)


def raw_song_fields(df: DataFrame, source_file: str = "source_file") -> DataFrame:
    """The fields of the raw song table."""
    return song_fields(df, RAW_SONG_FIELDS, source_file)
