"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetally.llm import (
    blob_ledger,
    fingerprints,
    language,
    lexical,
    line_dedup,
    near_dedup,
    oracle,
    packing,
    periodic_runs,
    pieces,
    pii,
    quality,
    sequences,
    substrings,
)

#: A key for tests; the operator itself has none.
TEST_KEY = "key of the registered query"
Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.linked(documents(spark, sf_dir), shingle=4)


def op3_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two steps: half of the table, an earlier state of it, is scanned first, and then the
    whole table against the ledger of that."""
    docs = documents(spark, sf_dir)
    return blob_ledger.report(docs, docs.where(F.col("doc_id") % 2 == 0))


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir), TEST_KEY)


def op5_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op6_difference_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(documents(spark, sf_dir))


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op9_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.packed(documents(spark, sf_dir))


def op11_synchronising_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts has a repetition written into it first."""
    return periodic_runs.report(periodic_runs.planted(documents(spark, sf_dir)))


def op12_hybrid_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.ranked(documents(spark, sf_dir), items)


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir)).drop("keep_bitmap")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_blob_ledger_secrets(spark, sf_dir).select(
        "doc_id", *(f"n_{k}" for k in blob_ledger.BASE_KINDS), "base_sha256"
    )


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", *quality.BASE, "base_failed")


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_blob_ledger_secrets": op3_blob_ledger_secrets,
    "op4_feistel_pii": op4_feistel_pii,
    "op5_byte_network_language": op5_byte_network_language,
    "op6_difference_cover_substrings": op6_difference_cover_substrings,
    "op7_bottom_k_fingerprints": op7_bottom_k_fingerprints,
    "op8_quality_rules": op8_quality_rules,
    "op9_cutting_stock_packing": op9_cutting_stock_packing,
    "op10_packed_token_ids": op10_packed_token_ids,
    "op11_synchronising_runs": op11_synchronising_runs,
    "op12_hybrid_lexical_search": op12_hybrid_lexical_search,
    "op13_line_bitmaps": op13_line_bitmaps,
    "base_secrets": base_secrets,
    "base_quality_counts": base_quality_counts,
}
#: Of the others, tests hold each against brute force, a library, an exact round trip or
#: held-out labels.
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
