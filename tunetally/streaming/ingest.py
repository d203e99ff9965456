"""Ingest of the files that are new since the last run.

A run reads the files below the source that its log does not have, writes their songs, and
ends. The log is the checkpoint of the stream: a run that fails is repeated with the same
files, and the file sink's own log makes its output count once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.operators.decode import (
    decode_drop_bad,
    decode_null_bad,
    raw_song_fields,
    song_projection,
    split_records,
)
from tunetally.schemas import RAW_SONG_SCHEMA, SONG_SCHEMA
from tunetally.sources.files import source_file


class Run(NamedTuple):
    """The table after a run, and the payloads that the run read."""

    table: DataFrame
    payloads: int


def ingest_new_songs(
    spark: SparkSession,
    source: str,
    target: str,
    log: str,
    glob: str = "*.json",
    whole_file: bool = True,
    records: str = "first",
) -> Run:
    """As `ingest.ingest_songs`, from new files only; the target grows."""
    payloads = _new_payloads(spark, source, glob, whole_file, records == "all")
    songs = song_projection(decode_drop_bad(payloads, "payload", SONG_SCHEMA))
    return _run(songs, target, log, SONG_SCHEMA)


def ingest_new_raw_songs(
    spark: SparkSession,
    source: str,
    target: str,
    log: str,
    glob: str = "*.json",
    whole_file: bool = True,
    records: str = "all",
) -> Run:
    """As `ingest.ingest_raw_songs`, from new files only."""
    payloads = _new_payloads(spark, source, glob, whole_file, records == "all")
    songs = raw_song_fields(decode_null_bad(payloads, "payload", RAW_SONG_SCHEMA))
    return _run(songs, target, log, songs.schema)


def _new_payloads(spark: SparkSession, source: str, glob: str, whole_file: bool, every: bool) -> DataFrame:
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("wholetext", whole_file)
        .schema("value string")
        .format("text")
        .load(source)
        .select(source_file(), F.col("value").alias("payload"))
    )
    return split_records(lines, "payload", every).drop("record_no")


def _run(songs: DataFrame, target: str, log: str, schema: T.StructType) -> Run:
    query = (
        songs.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    read = sum(progress["numInputRows"] for progress in query.recentProgress)
    return Run(songs.sparkSession.read.schema(schema).parquet(target), read)
