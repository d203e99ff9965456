"""Profiles of the two tables, as a set of DataFrames by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetally.operators.profile import (
    null_counts,
    numeric_summary,
    overview,
    sample_rows,
    schema_listing,
    top_by_plays,
)


def profile(
    df: DataFrame, numeric: list[str], order_by: list[str], exact: bool = False
) -> dict[str, DataFrame]:
    """Schema, row count, ten rows, summary of the numeric columns and null counts."""
    return {
        "schema": schema_listing(df),
        "rows": df.agg(F.count(F.lit(1)).alias("rows")),
        "sample": sample_rows(df, order_by, 10),
        "summary": numeric_summary(df, numeric, exact),
        "nulls": null_counts(df),
    }


def profile_songs(songs: DataFrame, exact: bool = False) -> dict[str, DataFrame]:
    return profile(songs, ["duration", "tempo", "loudness", "year"], ["song_id"], exact)


def profile_plays(plays: DataFrame, exact: bool = False) -> dict[str, DataFrame]:
    return {
        **profile(plays, ["play_count"], ["user_id", "item_id", "play_count"], exact),
        "overview": overview(plays),
        "top_users": top_by_plays(plays, "user_id"),
        "top_items": top_by_plays(plays, "item_id"),
    }
