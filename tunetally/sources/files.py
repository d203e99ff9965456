"""File listings and payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetally.functions.columns import base_name, clean_path


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Plain paths of the files below `root` whose names match `glob`; none is opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select(clean_path(F.col("path")).alias("path"))
    )


def read_payloads(
    spark: SparkSession, root: str, glob: str, whole_file: bool = True
) -> DataFrame:
    """`source_file` and `payload` of the record files below `root`.

    A file is one payload, or one per line with `whole_file=False`.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root, wholetext=whole_file)
        .select(source_file(), F.col("value").alias("payload"))
    )


def source_file():
    """Plain path of the file a row was read from."""
    return clean_path(F.col("_metadata.file_path")).alias("source_file")


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows by the base name of the file they come from."""
    return (
        df.select(base_name(source_file()).alias("source_file"))
        .groupBy("source_file")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def write_table(df: DataFrame, path: str) -> None:
    """Write Parquet, replacing what is there."""
    df.write.mode("overwrite").parquet(path)
