import random

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from tunetally.operators import profile, sketches
from tunetally.operators.summaries import Compactor, Counters
from tunetally.session import materialize

KINDS = {
    "even": lambda rng, n: rng.random(n),
    "sorted": lambda rng, n: np.arange(n, dtype=float),
    "ties": lambda rng, n: rng.integers(0, 5, n).astype(float),
    "skewed": lambda rng, n: rng.pareto(0.5, n),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("parts", [1, 7, 300])
def test_ranks_stay_within_the_error_of_the_sketch(kind, parts):
    rng = np.random.default_rng(3)
    all_values = KINDS[kind](rng, 200_000)
    merged = Compactor(256)
    for part in np.array_split(all_values, parts):
        own = Compactor(256)
        for piece in np.array_split(part, 3):
            own.add(piece)
        merged.merge(own.levels, own.n, own.error)
    assert merged.n == len(all_values) and merged.error <= 0.03 * merged.n
    assert sum(len(v) for v in merged.levels) <= 2 * 256 * len(merged.levels)
    ranked = np.sort(all_values)
    for share, value in zip((0.001, 0.2, 0.5, 0.9, 1.0), merged.quantiles([0.001, 0.2, 0.5, 0.9, 1.0])):
        low, high = np.searchsorted(ranked, value, "left"), np.searchsorted(ranked, value, "right")
        assert low - merged.error <= share * merged.n <= high + merged.error


def test_small_sketches_are_exact():
    sketch = Compactor(256)
    sketch.add(np.array([3.0, 1.0, 2.0]))
    assert sketch.error == 0 and sketch.quantiles([0.0, 0.34, 0.5, 1.0]) == [1.0, 2.0, 2.0, 3.0]
    assert Compactor(8).quantiles([0.5]) == [None]


def test_written_quantile_sketches_merge(spark):
    df = spark.range(50_000).select(
        (F.col("id") * 7919 % 50_000).alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("y"),
    )
    for parts in (1, 9):
        written = materialize(sketches.quantile_sketches(df.repartition(parts), ["x", "y"], 64), "sketches")
        assert written.count() == 2 * parts
        for r in sketches.quantiles(written, [0.1, 0.5, 0.9], 64).collect():
            known = 50_000 if r.column == "x" else 16_667
            assert r.n == known and r.error < 0.2 * known
            rank = r.value if r.column == "x" else (r.value - 1) / 3
            assert abs(rank - r.share * known) <= r.error + 1
    none = sketches.quantiles(sketches.quantile_sketches(df.limit(0), ["x"]), [0.5]).collect()
    assert [(r.value, r.n) for r in none] in ([], [(None, 0)])


def test_distinct_sketches_of_files_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("user"), (F.col("id") % 7).alias("file"), F.lit(None).cast("string").alias("none"))
    written = materialize(sketches.distinct_sketches(df, ["user", "none"], ["file"]), "distinct")
    assert written.count() == 7
    told = sketches.distinct_counts(written, ["user", "none"]).first()
    assert abs(told.user - 20_000) <= sketches.DISTINCT_BOUND * 20_000 and told.none == 0
    again = sketches.merged_distinct(written, ["user"]).union(written.select("user").limit(3))
    assert sketches.distinct_counts(again, ["user"]).first().user == told.user


def test_counters_bound_every_id():
    rng = random.Random(2)
    import pyarrow as pa

    true, merged = {}, Counters(50)
    for _ in range(20):
        part = Counters(50)
        for _ in range(5):
            ids = [min(int(rng.paretovariate(0.7)), 5000) for _ in range(400)]
            counts = [rng.randrange(5) for _ in ids]
            for i, c in zip(ids, counts):
                true[i] = true.get(i, 0) + c
            part.add(pa.array(ids), pa.array(counts))
        merged.add(part.held["id"], part.held["count"])
        merged.lost += part.lost
    held = dict(zip(merged.held["id"].to_pylist(), merged.held["count"].to_pylist()))
    assert len(held) <= 50 and 0 < merged.lost <= sum(true.values()) / 20
    assert all(held.get(i, 0) <= c <= held.get(i, 0) + merged.lost for i, c in true.items())


@pytest.mark.parametrize("counters", [20, 60, 10_000])
def test_top_ids_equal_the_full_count(spark, plays, counters):
    rng = random.Random(4)
    rows = [(f"u{int(rng.paretovariate(0.8))}", "i", rng.randrange(1, 9)) for _ in range(3000)] + [(None, "i", 70), ("n", "i", None)]
    table = plays(*rows).repartition(6)
    for n in (1, 5, 40):
        want = [tuple(r) for r in profile.top_by_plays(table, "user_id", n).collect()]
        assert [tuple(r) for r in sketches.top_by_counters(table, "user_id", n, counters).collect()] == want


def test_counts_below_zero_and_no_plays(spark, plays):
    table = plays(("a", "i", 5), ("b", "i", -9), ("b", "i", 20), ("c", "i", 1))
    want = values(profile.top_by_plays(table, "user_id", 2))
    assert values(sketches.top_by_counters(table, "user_id", 2, 2)) == want
    assert sketches.top_by_counters(table.limit(0), "user_id").count() == 0
