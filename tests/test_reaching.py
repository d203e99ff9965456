import random

import pytest
from test_similarity import random_rows

from tunetally.operators import projections as proj
from tunetally.operators import similarity as sim
from tunetally.operators.reaching import reaching_pairs


def brute_pairs(rows, least):
    columns = {}
    for user, item, n in rows:
        column = columns.setdefault(item, {})
        column[user] = column.get(user, 0) + n
    norm = {i: sum(w * w for w in c.values()) ** 0.5 for i, c in columns.items()}
    out = {}
    for a in columns:
        for b in columns:
            if a < b and norm[a] and norm[b]:
                dot = sum(w * columns[b].get(u, 0) for u, w in columns[a].items())
                if round(dot / (norm[a] * norm[b]), 9) >= least:
                    out[a, b] = dot / (norm[a] * norm[b])
    return out


def found(df):
    rows = df.collect()
    out = {(r.item_a, r.item_b): r.similarity for r in rows}
    assert len(out) == len(rows)
    return out


def assert_pairs(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 2e-9 for p in want)


@pytest.mark.parametrize("least", [0.05, 0.4, 1.0])
def test_pairs_equal_brute_force(plays, least):
    rows = [*random_rows(21), ("u", "twin1", 3), ("u", "twin2", 5), ("u", "none", 0), ("v", "none", 0)]
    cells = sim.interaction_matrix(plays(*rows))
    assert_pairs(found(reaching_pairs(cells, least, block_items=8)), brute_pairs(rows, least))


def test_pairs_of_some_items(spark, plays):
    rows = random_rows(22)
    items = sorted({r[1] for r in rows})[:5]
    only = spark.createDataFrame([(i,) for i in items + items], "item_id string")
    got = found(reaching_pairs(sim.interaction_matrix(plays(*rows)), 0.2, only, block_items=4))
    assert_pairs(got, {p: s for p, s in brute_pairs(rows, 0.2).items() if set(p) & set(items)})


def test_tiles_split_by_user(plays, monkeypatch):
    rows = random_rows(23)
    want = brute_pairs(rows, 0.3)
    monkeypatch.setattr(sim, "TILE_ROWS", 5)
    assert_pairs(found(reaching_pairs(sim.interaction_matrix(plays(*rows)), 0.3, block_items=8)), want)
    monkeypatch.setattr(sim, "TILE_PRODUCTS", 50)
    assert_pairs(found(reaching_pairs(sim.interaction_matrix(plays(*rows)), 0.3, block_items=8)), want)


def test_no_plays_and_no_threshold(plays):
    cells = sim.interaction_matrix(plays(("u", "a", 1)))
    assert reaching_pairs(cells, 0.5).collect() == []
    assert reaching_pairs(cells.limit(0), 0.5).collect() == []
    with pytest.raises(ValueError):
        reaching_pairs(cells, 0.0)


def test_large_buckets_lose_no_pair_that_shares_a_band(plays, monkeypatch):
    pick = random.Random(4)
    rows = [(f"u{pick.randrange(30)}", f"i{k:03}", pick.randrange(1, 5)) for k in range(90) for _ in range(6)]
    cells = sim.interaction_matrix(plays(*rows))
    want = found(proj.similar_pairs(cells, 0.3))
    assert len(want) > 50
    monkeypatch.setattr(proj, "SMALL_BUCKET", 1)
    assert found(proj.similar_pairs(cells, 0.3)) == want
    monkeypatch.setattr(proj, "SMALL_BUCKET", 6)
    assert found(proj.similar_pairs(cells, 0.3)) == want
    monkeypatch.setattr(proj, "NEXT", 1)
    few = found(proj.similar_pairs(cells, 0.3, sorted_buckets=True))
    assert few.items() <= want.items()


@pytest.mark.parametrize("least", [0.05, 0.4])
def test_bands_give_the_same_pairs(spark, plays, monkeypatch, least):
    rows = [*random_rows(24), ("u", "twin1", 3), ("u", "twin2", 5), ("u", "none", 0), ("v", "none", 0)]
    cells, want = sim.interaction_matrix(plays(*rows)), brute_pairs(rows, least)
    only = spark.createDataFrame([("i03",), ("i07",), ("twin1",)], "item_id string")
    some = {p: s for p, s in want.items() if set(p) & {"i03", "i07", "twin1"}}
    for entries in (10**8, 500):
        monkeypatch.setattr(sim, "TILE_ENTRIES", entries)
        assert_pairs(found(reaching_pairs(cells, least, block_items=8, bands=True)), want)
        assert_pairs(found(reaching_pairs(cells, least, only, block_items=8, bands=True)), some)


def test_short_histories_of_many_items_take_bands(spark, monkeypatch):
    """30,000 users with 4 of 40,000 items each: squares would be a row per pair of items."""
    cells = spark.range(120_000).selectExpr("id div 4 AS user_id", "id % 40000 AS item_id", "1L AS play_count")
    asked, banded = [], sim.banded
    monkeypatch.setattr(sim, "banded", lambda *a, **k: asked.append(1) or banded(*a, **k))
    assert reaching_pairs(cells, 0.9).count() == 60_000 and asked == [1]


def test_no_bucket_gives_its_pairs_as_rows(plays, monkeypatch):
    rows = random_rows(25)
    cells = sim.interaction_matrix(plays(*rows))
    want = found(proj.similar_pairs(cells, 0.3, band_bits=4))
    monkeypatch.setattr(proj, "_small_pairs", lambda members: 1 / 0)
    assert found(proj.similar_pairs(cells, 0.3, band_bits=4)) == want
    assert want.items() <= found(reaching_pairs(cells, 0.3)).items() and want


def test_the_right_side_starts_after_the_left_one(plays, monkeypatch):
    """A pair is met once, so a history's lower cells are not sent to its higher ones."""
    rows = [("u", f"i{i}", 1 + i) for i in range(10)]
    cells = sim.with_histories(sim.interaction_matrix(plays(*rows)))
    items = sim.encode_ids(sim.item_norms(cells, sim.products_of_item()), "item_id", "code")
    size = sim.FactSize.measure(items, "listeners")
    sent = {}
    for symmetric in (False, True):
        _, bands = sim.banded(cells, items, size, 10, 10**9, symmetric=symmetric)
        sent[symmetric] = bands.light.selectExpr("sum(size(ib))").first()[0]
    assert sent == {False: 100, True: 45}
    monkeypatch.setattr(sim, "PASS_ENTRIES", 50)
    monkeypatch.setattr(sim, "PASS_OF_CELLS", 1)
    assert_pairs(found(reaching_pairs(sim.interaction_matrix(plays(*rows)), 0.4, block_items=2, bands=True)), brute_pairs(rows, 0.4))
