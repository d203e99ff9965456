import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from tunetally.operators import ids


def test_codes_follow_id_order(spark):
    names = [f"user{i:04}" for i in range(500)]
    random.Random(1).shuffle(names)
    table = spark.createDataFrame([(n,) for n in names], "id string").repartition(5)
    got = values(ids.encode_ids(table, "id", "code"))
    assert got == [(n, i) for i, n in enumerate(sorted(names))]


def test_running_totals(spark):
    table = spark.range(1000).select("id", (F.col("id") % 5).alias("n"))
    got = ids.running_totals(table, ["id"], {"before": F.col("n"), "place": ids.one_row()})
    total = 0
    for row in got.orderBy("id").collect():
        assert (row["before"], row["place"]) == (total, row["id"])
        total += row["n"]


def test_an_empty_table_has_no_codes(spark):
    assert values(ids.encode_ids(spark.createDataFrame([], "id int"), "id", "code")) == []


@pytest.mark.parametrize("bound", [10_000, 1])
def test_order_of_first_appearance(spark, monkeypatch, bound):
    monkeypatch.setattr(ids, "MAX_TOP_ROWS", bound)
    rows = [(3, "c"), (1, "b"), (2, "c"), (5, "a"), (4, "b"), (6, None)]
    table = spark.createDataFrame(rows, "at int, user string")
    assert values(ids.first_seen(table, "user", "at")) == [("a", 5), ("b", 1), ("c", 2)]
    assert values(ids.distinct_ids(table, "user")) == [("a",), ("b",), ("c",)]
    for n, user in enumerate(["b", "c", "a"]):
        assert ids.nth_seen(table, "user", "at", n).first()["user"] == user
    assert values(ids.nth_seen(table, "user", "at", 3)) == []
