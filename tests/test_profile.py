import math
import statistics

import pytest
from conftest import values

from tunetally.operators import profile
from tunetally.plans import profiles


@pytest.fixture
def numbers(spark):
    rows = [(1, 1.0), (2, float("nan")), (3, None), (None, -2.5), (7, 4.0)]
    return spark.createDataFrame(rows, "n int, x double")


def test_null_and_nan_are_counted_apart(numbers):
    assert values(profile.null_counts(numbers)) == [("n", 1, 0), ("x", 1, 1)]


def test_null_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "n int, x double")
    assert values(profile.null_counts(empty)) == [("n", 0, 0), ("x", 0, 0)]


def test_schema_listing(numbers):
    assert values(profile.schema_listing(numbers)) == [
        (0, "n", "int", True, 4),
        (1, "x", "double", True, 4),
    ]


@pytest.mark.parametrize("exact", [True, False])
def test_summary(spark, exact):
    data = [5, 1, 1, 9, 7, 3, 3, 3, 8, 100, 2]
    table = spark.createDataFrame([(v, v * -0.5) for v in data], "n int, x double")
    got = {r["column"]: r for r in profile.numeric_summary(table, ["n", "x"], exact).collect()}
    assert got["n"]["count"] == len(data)
    assert got["n"]["mean"] == pytest.approx(statistics.mean(data))
    assert got["n"]["stddev"] == pytest.approx(statistics.stdev(data))
    assert (got["n"]["min"], got["n"]["max"]) == (1.0, 100.0)
    if exact:
        quartiles = statistics.quantiles(data, n=4, method="inclusive")
        assert [got["n"][p] for p in ("p25", "p50", "p75")] == pytest.approx(quartiles)
        assert [got["x"][p] for p in ("p75", "p50", "p25")] == pytest.approx(
            [q * -0.5 for q in quartiles]
        )
    else:
        assert [got["n"][p] for p in ("p25", "p50", "p75")] == [2.0, 3.0, 8.0]


def test_summary_of_a_column_without_values(spark):
    table = spark.createDataFrame([(None,)], "n int")
    (row,) = profile.numeric_summary(table, ["n"], exact=True).collect()
    assert row["count"] == 0 and row["p50"] is None and row["max"] is None


def test_exact_quantiles_of_many_values(spark):
    table = spark.range(10_001).selectExpr("cast(id * 7 % 10001 as double) AS v")
    (row,) = profile.quantiles(table, ["v"], [0.1, 0.5, 0.999]).collect()
    assert row["quartiles"] == pytest.approx([1000.0, 5000.0, 9990.0])


def test_nan_makes_the_mean_nan(numbers):
    (row,) = profile.numeric_summary(numbers, ["x"]).collect()
    assert math.isnan(row["mean"]) and row["count"] == 4


def test_top_lists_and_overview(plays):
    table = plays(("u1", "a", 3), ("u2", "a", 1), ("u2", "b", 2), ("u3", "b", 9))
    top = profile.top_by_plays(table, "user_id", 2)
    assert [tuple(r) for r in top.collect()] == [("u3", 9), ("u1", 3)]
    assert values(profile.overview(table)) == [(4, 3, 2)]
    assert values(profile.overview(table, approximate=True)) == [(4, 3, 2)]


def test_profiles_hold_their_parts(plays, spark):
    parts = profiles.profile_plays(plays(("u1", "a", 3), ("u2", "a", 1)))
    assert set(parts) == {
        "schema", "rows", "sample", "summary", "nulls", "overview", "top_users", "top_items"
    }
    assert values(parts["rows"]) == [(2,)]
    assert [tuple(r) for r in parts["top_items"].collect()] == [("a", 4)]
    songs = spark.createDataFrame(
        [("s", 1.0, 2.0, 3.0, 4)],
        "song_id string, duration double, tempo double, loudness double, year int",
    )
    summary = profiles.profile_songs(songs)["summary"]
    assert values(summary, "column") == [("duration",), ("loudness",), ("tempo",), ("year",)]
