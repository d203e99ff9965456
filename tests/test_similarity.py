import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from tunetally.operators import lookup as lookups
from tunetally.operators import similarity as sim
from tunetally.operators import tiles


def brute(rows, k, only=None):
    """Neighbour lists by plain loops over all pairs of items."""
    cells = defaultdict(float)
    for user, item, count in rows:
        cells[item, user] += count
    columns = defaultdict(dict)
    for (item, user), count in cells.items():
        columns[item][user] = count
    norm = {i: math.sqrt(sum(c * c for c in col.values())) for i, col in columns.items()}
    out = []
    for a in columns:
        if only is not None and a not in only:
            continue
        near = []
        for b in columns:
            both = columns[a].keys() & columns[b].keys()
            if a == b or not both:
                continue
            dot = sum(columns[a][u] * columns[b][u] for u in both)
            size = norm[a] * norm[b]
            near.append((-(math.floor(dot / size * 1e9 + 0.5) / 1e9) if size else 0.0, b))
        out += [(a, b, -s) for s, b in sorted(near)[:k]]
    return out


def found(df):
    return sorted((r.item_id, r.neighbor_id, r.similarity) for r in df.collect())


def assert_same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert [g[2] for g in got] == [w[2] for w in sorted(want)]


def random_rows(seed, users=40, items=60, n=700):
    """Plays with one user who has every item and one item that every user has."""
    pick = random.Random(seed)
    rows = [
        (f"u{pick.randrange(users):02}", f"i{pick.randrange(items):02}", pick.randrange(0, 6))
        for _ in range(n)
    ]
    rows += [("u00", f"i{i:02}", 1 + i % 3) for i in range(items)]
    rows += [(f"u{u:02}", "i00", 2) for u in range(users)]
    return rows


@pytest.mark.parametrize("block_items, tile_rows", [(2048, 10**9), (7, 10**9), (16, 5)])
def test_blocks_and_slabs_give_the_brute_force_result(plays, block_items, tile_rows):
    rows = random_rows(1)
    cells = sim.interaction_matrix(plays(*rows))
    near = sim.nearest(cells, 4, block_items=block_items, tile_rows=tile_rows)
    assert_same(found(near.rows), brute(rows, 4))


@pytest.mark.parametrize("block_items, tile_rows", [(2048, 10**9), (7, 10**9), (16, 5)])
def test_only_the_asked_items_are_searched(spark, plays, block_items, tile_rows):
    rows = random_rows(2)
    asked = [f"i{i:02}" for i in range(0, 60, 5)] + ["missing"]
    only = spark.createDataFrame([(i,) for i in asked], "item_id string")
    near = sim.nearest(
        sim.interaction_matrix(plays(*rows)), 3, only, block_items=block_items, tile_rows=tile_rows
    )
    assert_same(found(near.rows), brute(rows, 3, set(asked)))


@pytest.mark.parametrize("bands, block_items", [(False, 4), (True, 16)])
def test_a_long_history_is_split_over_tasks(plays, monkeypatch, bands, block_items):
    for name, bound in (("SEGMENTS_PER_TASK", 3), ("PART_CELLS", 8), ("CHUNK_CELLS", 10)):
        monkeypatch.setattr(sim, name, bound)
    rows = random_rows(3)
    cells = sim.interaction_matrix(plays(*rows))
    near = sim.nearest(cells, 5, block_items=block_items, bands=bands)
    assert_same(found(near.rows), brute(rows, 5))


@pytest.mark.parametrize("tile_rows", [10**9, 5])
def test_bands_give_the_brute_force_result(plays, tile_rows):
    rows = random_rows(6)
    cells = sim.interaction_matrix(plays(*rows))
    near = sim.nearest(cells, 4, block_items=16, tile_rows=tile_rows, bands=True)
    assert_same(found(near.rows), brute(rows, 4))


def test_the_shape_of_tiles_follows_the_length_of_histories(spark):
    short = spark.range(30_000).selectExpr("id % 1000 AS user_id")
    long = spark.range(2_000_000).selectExpr("id % 10 AS user_id")
    assert sim._bands_are_cheaper(short, 200_000, 98, 20, 10)
    assert not sim._bands_are_cheaper(long, 200_000, 98, 20, 10)
    assert not sim._bands_are_cheaper(short, 20_000, 10, 200, 10)
    assert sim._bands_are_cheaper(short, 10_000_000, 4_883, sim.BAND_ITEMS, 10)


def test_heavy_items_are_looked_up_apart(spark, plays, monkeypatch):
    monkeypatch.setattr(lookups, "HEAVY_SHARE", 20)
    rows = random_rows(4)
    cells = sim.interaction_matrix(plays(*rows))
    dim = sim.item_norms(cells)
    size = lookups.FactSize.measure(dim, "listeners")
    assert size.largest_key * 20 > size.facts
    apart = lookups.lookup(cells, dim, "item_id", "listeners", size, max_broadcast_rows=0)
    plain = cells.join(dim.drop("listeners"), "item_id")
    assert values(apart, *plain.columns) == values(plain)


def test_long_ids_count_towards_a_broadcast(spark, plays, monkeypatch):
    cells = sim.interaction_matrix(plays(("u1", "a" * 1000, 1), ("u2", "b" * 1000, 2)))
    dim = sim.item_norms(cells)
    size = lookups.FactSize.measure(dim, "listeners")
    assert 2_000 < size.bytes < 2_200

    def broadcast():
        plan = lookups.lookup(cells.hint("merge"), dim, "item_id", "listeners", size)
        return "ResolvedHint (strategy=broadcast)" in plan._jdf.queryExecution().analyzed().toString()

    assert broadcast()
    monkeypatch.setattr(lookups, "MAX_BROADCAST_BYTES", 1_000)
    monkeypatch.setattr(lookups, "HEAVY_SHARE", 1)
    assert not broadcast()


def test_ties_go_to_the_lower_id(plays):
    rows = [("u1", i, 1) for i in "abcdef"]
    near = sim.nearest_items(sim.interaction_matrix(plays(*rows)), 2)
    assert found(near) == [
        (i, j, 1.0) for i in "abcdef" for j in [x for x in "abcdef" if x != i][:2]
    ]
    assert {(r.rank, r.distance) for r in near.collect()} == {(1, 0.0), (2, 0.0)}


def test_duplicates_are_summed(plays):
    split = [("u1", "a", 1), ("u1", "a", 2), ("u1", "b", 3), ("u2", "a", 3), ("u2", "b", 4)]
    whole = [("u1", "a", 3), ("u1", "b", 3), ("u2", "a", 3), ("u2", "b", 4)]
    results = [found(sim.nearest_items(sim.interaction_matrix(plays(*r)), 5))
               for r in (split, whole)]
    assert results[0] == results[1]
    assert results[0][0][2] == math.floor(21 / (math.sqrt(18) * 5) * 1e9 + 0.5) / 1e9


def test_an_item_without_weight_has_similarity_zero(plays):
    rows = [("u1", "z", 0), ("u1", "b", 2), ("u2", "z", 0), ("u2", "b", 1)]
    assert found(sim.nearest_items(sim.interaction_matrix(plays(*rows)), 5)) == [
        ("b", "z", 0.0),
        ("z", "b", 0.0),
    ]


def test_null_ids_are_dropped(plays):
    rows = [(None, "a", 1), ("u1", None, 1), ("u1", "b", 1)]
    assert values(sim.interaction_matrix(plays(*rows))) == [("u1", "b", 1)]


def test_no_plays_no_neighbours(plays):
    assert found(sim.nearest_items(sim.interaction_matrix(plays()), 5)) == []


def test_matrix_facts(plays):
    cells = sim.interaction_matrix(plays(("u1", "a", 3), ("u1", "b", 4), ("u2", "a", 4)))
    assert values(sim.matrix_stats(cells)) == [(2, 2, 3, 0.75)]
    assert values(sim.item_norms(cells)) == [("a", 5.0, 2), ("b", 4.0, 1)]
    assert values(sim.encode_matrix(cells)) == [(0, 0, 3), (0, 1, 4), (1, 0, 4)]


@pytest.mark.parametrize("density", [0.02, 0.9])
def test_best_of_a_tile(density):
    pick = np.random.default_rng(5)
    rows, columns = np.nonzero(pick.random((30, 50)) < density)
    units = pick.integers(0, 100, len(rows))
    keep = tiles._best(rows, columns, units, 4)
    want = []
    for r in range(30):
        ranked = sorted((-u, c) for u, c in zip(units[rows == r], columns[rows == r]))[:4]
        want += [(r, c, -u) for u, c in ranked]
    assert list(zip(rows[keep], columns[keep], units[keep])) == want


@pytest.mark.parametrize("cells, products", [(1_000, 50), (100, 5_000), (10**12, 4_000)])
def test_sums_of_a_tile_follow_its_products(monkeypatch, cells, products):
    """Full tiles get an array; thin ones, however large, hold their products only."""
    monkeypatch.setattr(tiles, "PRODUCT_CHUNK", 64)
    pick = np.random.default_rng(1)
    grid = tiles.Grid(1, 1, cells // 10, 10, False, 3, 9)
    at, value = pick.integers(0, cells, products), pick.integers(1, 9, products).astype(float)
    parts = ((at[k : k + 50], value[k : k + 50]) for k in range(0, products, 50))
    places, sums = tiles._add_up(grid, parts)
    want = defaultdict(float)
    for cell, part in zip(at, value):
        want[cell] += part
    assert dict(zip(places, sums)) == want and (np.diff(places) > 0).all()


def border_rows():
    """u1 has a, b and c; the cosine of a and b is 41 / (64 * 80), a border of rounding, and
    that of a and c is a little less, but the same after rounding down."""
    rows = [("u1", "a", 1), ("u1", "b", 41)]
    rows += [(f"a{k}", "a", n) for k, n in enumerate((63, 11, 2, 1))]
    return rows + [(f"b{k}", "b", n) for k, n in enumerate((68, 9, 3, 2, 1))]


def test_one_formula_for_all_shapes(spark, plays):
    """A cosine at the border of rounding: dot 41, norms 64 and 80."""
    rows = border_rows()
    cells = sim.interaction_matrix(plays(*rows))
    duckdb = pytest.importorskip("duckdb")
    want = duckdb.sql("SELECT round(41 / (64.0::DOUBLE * 80.0::DOUBLE), 9)").fetchall()[0][0]
    assert want == 0.008007812
    for options in ({}, {"bands": True}, {"block_items": 1}, {"tile_rows": 1}):
        near = sim.nearest(cells, 2, **options)
        assert found(near.rows) == [("a", "b", want), ("b", "a", want)], options
    pairs = sim.nearest_by_pairs(cells, cells.where("item_id = 'a'"), 2)
    assert found(pairs) == [("a", "b", want)]


def test_products_are_formed_in_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tiles, "PRODUCT_CHUNK", 3)
    batch = pa.RecordBatch.from_pydict(
        {
            "ia": pa.array([[0, 1], [], [2]], pa.list_(pa.int32())),
            "wa": [[1.0, 2.0], [], [3.0]],
            "ib": pa.array([[0, 1, 2, 3, 4], [1], [1, 3]], pa.list_(pa.int32())),
            "wb": [[1.0, 2.0, 3.0, 4.0, 5.0], [9.0], [10.0, 20.0]],
        }
    )
    dot = np.zeros(3 * 5)
    for cell, product in tiles._products(batch, 5):
        np.add.at(dot, cell, product)
    assert dot.reshape(3, 5).tolist() == [
        [1.0, 2.0, 3.0, 4.0, 5.0],
        [2.0, 4.0, 6.0, 8.0, 10.0],
        [0.0, 30.0, 0.0, 60.0, 0.0],
    ]


@pytest.mark.parametrize("bands", [False, True])
def test_tiles_are_split_by_products(plays, monkeypatch, bands):
    rows = random_rows(8)
    cells = sim.interaction_matrix(plays(*rows))
    slabs, seen = sim._slabs, []

    def counted(*args):
        out = slabs(*args)
        seen.append(out.groupBy("a", "b").agg(F.count_distinct("slab").alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(sim, "_slabs", counted)
    near = sim.nearest(cells, 4, block_items=16, bands=bands)
    assert not seen
    monkeypatch.setattr(sim, "TILE_PRODUCTS", 100)
    split = sim.nearest(cells, 4, block_items=16, bands=bands)
    assert seen and seen[0] > 1
    assert found(split.rows) == found(near.rows)
    assert_same(found(split.rows), brute(rows, 4))


def test_a_user_is_sent_once_to_each_range(plays):
    """In bands a row carries the history, so there are as few as the user's items allow."""
    rows = [(f"u{u}", f"i{g}{i:02}", 1 + i % 3) for g in range(5) for u in range(10 * g, 10 * g + 10) for i in range(20)]
    cells = sim.with_histories(sim.interaction_matrix(plays(*rows)))
    items = sim.encode_ids(sim.item_norms(cells, sim.products_of_item()), "item_id", "code")
    size = lookups.FactSize.measure(items, "listeners")
    _, bands = sim.banded(cells, items, size, 4_000, 10**9)
    # Five groups of 10 users with 20 items each: 4,000 products a group.
    assert bands.light.count() == 50 and bands.heavy is None
    kinds = {f.name: f.dataType.simpleString() for f in bands.light.schema}
    assert kinds["ib"] == kinds["nb"] == "array<int>" and kinds["wb"] == "array<tinyint>"
    near = sim.nearest(sim.interaction_matrix(plays(*rows)), 4, block_items=45, bands=True)
    assert_same(found(near.rows), brute(rows, 4))


@pytest.mark.parametrize("count", [-3, 100, 1_000, 100_000])
def test_bands_hold_counts_of_any_size(plays, count):
    rows = [(u, i, count + n) for n, (u, i) in enumerate((u, i) for u in "uvw" for i in "abcd")]
    near = sim.nearest(sim.interaction_matrix(plays(*rows)), 3, bands=True)
    assert_same(found(near.rows), brute(rows, 3))


def test_bands_of_some_items_and_heavy_ones(spark, plays, monkeypatch):
    rows = random_rows(9)
    asked = [f"i{i:02}" for i in range(0, 60, 7)]
    only = spark.createDataFrame([(i,) for i in asked], "item_id string")
    for entries in (10**8, 1_500):
        monkeypatch.setattr(sim, "TILE_ENTRIES", entries)
        near = sim.nearest(sim.interaction_matrix(plays(*rows)), 3, only, block_items=16, bands=True)
        assert_same(found(near.rows), brute(rows, 3, set(asked)))
        whole = sim.nearest(sim.interaction_matrix(plays(*rows)), 3, block_items=16, bands=True)
        assert_same(found(whole.rows), brute(rows, 3))


def test_bands_in_passes_give_the_same_rows(plays, monkeypatch):
    """The shuffle of bands grows with the ranges a history falls in; passes bound it."""
    rows = random_rows(31)
    monkeypatch.setattr(sim, "PASS_ENTRIES", 1_500)
    monkeypatch.setattr(sim, "PASS_OF_CELLS", 1)
    seen, passes = [], sim._passes
    monkeypatch.setattr(sim, "_passes", lambda *a: seen.append(passes(*a)) or seen[-1])
    for entries, short in ((1_500, 4_096), (10**8, 10)):
        monkeypatch.setattr(sim, "TILE_ENTRIES", entries)
        monkeypatch.setattr(sim, "PART_CELLS", short)
        near = sim.nearest(sim.interaction_matrix(plays(*rows)), 3, block_items=16, bands=True)
        assert_same(found(near.rows), brute(rows, 3))
    assert all(len(ranges) > 1 for ranges in seen)
    for ranges in seen:
        assert ranges[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))


def test_segment_pairs_are_packed():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    codes = [np.sort(rng.choice(50_000, 40, replace=False)) for _ in range(500)]
    counts = [rng.integers(1, 50, 40).astype(np.int8) for _ in codes]
    norms = [rng.integers(20_000, 30_000, 40).astype(np.int32) for _ in codes]
    sides = {"i": [c.astype(np.int32) for c in codes], "w": counts, "n": norms}
    lists = {f"{x}{side}": [v[: 1 if side == "a" else None][::step] for v in values]
             for side, step in (("a", 1), ("b", -1)) for x, values in sides.items()}
    keys = {"a": np.arange(500, dtype=np.int32) % 3, "b": np.zeros(500, np.int32)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in (keys | lists).items()})
    pack, _ = tiles.packed_by_band({"a": "int", "b": "int"})
    packed, = pack(iter([batch]))
    assert packed.column("a").to_pylist() == [0, 1, 2]
    assert 2 * packed.nbytes < batch.nbytes + 500 * 6 * 16
    for k, pairs in enumerate(tiles._pairs_of(packed)):
        mine = range(k, 500, 3)
        assert pairs.la.tolist() == [1] * len(mine) and pairs.lb.tolist() == [40] * len(mine)
        assert pairs.ia.tolist() == [codes[j][0] for j in mine]
        for got, want in ((pairs.ib, codes), (pairs.wb, counts), (pairs.nb, norms)):
            assert got.tolist() == np.concatenate([want[j] for j in mine]).tolist()


@pytest.mark.parametrize("values", [[], [-3, 4, 0], [1.5, -2.0], [2**40, 1], [0]])
def test_packed_values_come_back(values):
    assert tiles._unpack(tiles._pack(np.array(values))).tolist() == values


def test_steps_of_empty_segments():
    lengths = np.array([0, 2, 0, 0, 3, 0])
    places = np.array([5, 9, 1, 2, 8])
    assert tiles._walked(tiles._steps(places, lengths), lengths).tolist() == places.tolist()
    assert tiles._walked(np.zeros(0, np.int64), np.zeros(2, np.int64)).tolist() == []
