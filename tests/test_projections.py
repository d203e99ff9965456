import random

import pytest
from conftest import values

from tunetally.operators import projections as proj
from tunetally.operators import similarity as sim


def grouped_rows(seed, groups=25, users=20, n=6):
    """Groups of items with nearly the same listeners."""
    pick, rows = random.Random(seed), []
    for g in range(groups):
        for u in range(users):
            base = pick.randrange(1, 9)
            for i in range(n):
                rows.append((f"u{g}_{u}", f"g{g:02}i{i}", base + (pick.random() < 0.15)))
    rows += [(f"u{pick.randrange(groups)}_{pick.randrange(users)}", f"g{pick.randrange(groups):02}i0", 1) for _ in range(200)]
    return rows


def exact_pairs(cells, least):
    near = sim.nearest_items(cells, 200).where(f"similarity >= {least}").collect()
    return {(min(r.item_id, r.neighbor_id), max(r.item_id, r.neighbor_id)): r.similarity for r in near}


@pytest.mark.parametrize("small, next_", [(512, 64), (2, 12)])
def test_recall_and_exact_similarities(plays, monkeypatch, small, next_):
    monkeypatch.setattr(proj, "SMALL_BUCKET", small)
    monkeypatch.setattr(proj, "NEXT", next_)
    cells = sim.interaction_matrix(plays(*grouped_rows(1)))
    want = exact_pairs(cells, 0.8)
    rows = proj.similar_pairs(cells, 0.8).collect()
    got = {(r.item_a, r.item_b): r.similarity for r in rows}
    assert len(got) == len(rows) and len(want) > 300
    assert all(want[pair] == value for pair, value in got.items())
    assert len(got) >= 0.9 * len(want)


def test_long_columns_are_searched_exactly(plays, monkeypatch):
    monkeypatch.setattr(proj, "LONG_COLUMN", 5)
    cells = sim.interaction_matrix(plays(*grouped_rows(2, groups=6)))
    got = {(r.item_a, r.item_b): r.similarity for r in proj.similar_pairs(cells, 0.5).collect()}
    assert got == exact_pairs(cells, 0.5)


def test_one_large_bucket_gives_few_pairs(spark, plays, monkeypatch):
    monkeypatch.setattr(proj, "SMALL_BUCKET", 4)
    monkeypatch.setattr(proj, "NEXT", 3)
    cells = sim.interaction_matrix(plays(*[("u", f"i{k:03}", 1) for k in range(200)]))
    signs = proj.signatures(cells)
    assert signs.select("bits").distinct().count() == 1
    assert proj.candidates(signs).count() <= 3 * 200
    assert values(proj.similar_pairs(cells.limit(0), 0.5)) == []
