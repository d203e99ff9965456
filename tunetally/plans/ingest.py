"""Ingest jobs: text or record files in, typed Parquet out. The writing is one map-only stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.functions.columns import text
from tunetally.operators.decode import (
    decode_drop_bad,
    decode_null_bad,
    raw_song_fields,
    record_counts,
    song_projection,
    split_records,
)
from tunetally.schemas import RAW_SONG_SCHEMA, SONG_COLUMNS, SONG_SCHEMA
from tunetally.sources.files import read_payloads, write_table
from tunetally.sources.plays import read_plays_tsv


def ingest_plays(spark: SparkSession, source: str, target: str, strict: bool = True) -> DataFrame:
    """Tab-separated plays to Parquet."""
    write_table(read_plays_tsv(spark, source, strict=strict), target)
    return spark.read.parquet(target)


def ingest_songs(
    spark: SparkSession,
    source: str,
    target: str,
    glob: str = "*.json",
    whole_file: bool = True,
    records: str = "first",
    counts: Observation | None = None,
) -> DataFrame:
    """Song record files to the typed song table; a record with a bad field is dropped.

    Of a payload that holds an array of records, the first one is read, or all of them
    with `records="all"`. `counts` gets how many records were read, kept and dropped, from
    the pass that writes.
    """
    payloads = song_payloads(spark, source, glob, whole_file, records)
    songs = song_projection(decode_drop_bad(payloads, "payload", SONG_SCHEMA, counts))
    write_table(songs, target)
    return spark.read.schema(SONG_SCHEMA).parquet(target)


def ingest_raw_songs(
    spark: SparkSession,
    source: str,
    target: str,
    glob: str = "*.json",
    whole_file: bool = True,
    records: str = "all",
) -> DataFrame:
    """Song record files to the raw song table, all records of a payload; a bad field is
    null."""
    payloads = song_payloads(spark, source, glob, whole_file, records)
    songs = raw_song_fields(decode_null_bad(payloads, "payload", RAW_SONG_SCHEMA))
    write_table(songs, target)
    return spark.read.parquet(target)


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    """The typed song columns of a folder that either ingest, or both, have written to.

    The two tables share no column, so the files' schemas merge; a row has its values from
    the typed columns or from the raw ones, whose text is bytes and whose numbers are wider.
    """
    both = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    return song_projection(both.select(*(_either(both, name) for name in SONG_COLUMNS)))


def _either(both: DataFrame, name: str) -> Column:
    known = dict(both.dtypes)
    kind = SONG_COLUMNS[name]
    found = []
    if name in known:
        found.append(F.col(name))
    if f"get_{name}" in known:
        raw = F.col(f"get_{name}")
        found.append(text(raw) if known[f"get_{name}"] == "binary" else raw.try_cast(kind))
    return F.coalesce(*found, F.lit(None).cast(kind)).alias(name)


def song_payloads(
    spark: SparkSession, source: str, glob: str, whole_file: bool, records: str
) -> DataFrame:
    if records not in ("first", "all"):
        raise ValueError(f"records is 'first' or 'all', not {records!r}")
    payloads = read_payloads(spark, source, glob, whole_file)
    return split_records(payloads, "payload", records == "all").drop("record_no")


def file_account(listing: DataFrame, payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """Per listed file (`path`): records read, kept and dropped, 0 for a file without any.
    Spark's listings leave out files of no bytes.

    `payloads` has `source_file` and `payload`; what counts as good is what
    `decode_drop_bad` keeps.
    """
    counts = record_counts(payloads, "payload", schema, "source_file")
    zero = F.lit(0).cast("long")
    return listing.join(counts, F.col("path") == F.col("source_file"), "left").select(
        "path", *[F.coalesce(c, zero).alias(c) for c in ("records", "kept", "dropped")]
    )
