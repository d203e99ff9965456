import random

from conftest import values

from tunetally.operators import incremental as inc
from tunetally.operators import similarity as sim


def batches(seed, n=6):
    """Plays in batches: new users, new items, cells that grow, counts of 0."""
    pick = random.Random(seed)
    rows = [
        (f"u{pick.randrange(30):02}", f"i{pick.randrange(40):02}", pick.randrange(0, 6))
        for _ in range(500)
    ]
    rows += [("u00", f"i{i:02}", 1 + i % 3) for i in range(40)]
    rows += [("new", "i01", 2), ("new", "fresh", 0), ("u03", "fresh", 4), (None, "i01", 1), ("u01", None, 1)]
    return [rows[k::n] for k in range(n)]


def test_updates_equal_one_fit(spark, plays, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "CHANGED_CELLS", 2)
    parts, path = batches(1, 3), str(tmp_path)
    assert inc.start(plays(*parts[0]), path) == 0
    done = parts[0]
    for k, more in enumerate(parts[1:]):
        assert inc.add(spark, path, plays(*more)) == k + 1
        done += more
        want = sim.nearest_items(sim.interaction_matrix(plays(*done)), 4)
        assert values(inc.nearest_items(spark, path, 4), *want.columns) == values(want)
    before = values(inc.nearest_items(spark, path, 4))
    assert inc.compact(spark, path) == 3 and values(inc.nearest_items(spark, path, 4)) == before
    assert inc.add(spark, path, plays(("u00", "fresh", 3))) == 4
    want = sim.nearest_items(sim.interaction_matrix(plays(*done, ("u00", "fresh", 3))), 4)
    assert values(inc.nearest_items(spark, path, 4), *want.columns) == values(want)


def test_dots_of_blocks_equal_those_of_loops(plays):
    rows = [r for part in batches(3) for r in part]
    cells = {}
    for user, item, count in rows:
        if user and item:
            cells[user, item] = cells.get((user, item), 0) + count
    want = {}
    for (user, a), x in cells.items():
        for (other, b), y in cells.items():
            if user == other and a < b:
                want[a, b] = want.get((a, b), 0) + x * y
    got = inc.pair_dots(sim.interaction_matrix(plays(*rows)), block_items=7).collect()
    assert {(r.item_a, r.item_b): r.dot for r in got} == want and len(got) == len(want)


def test_an_update_reads_its_users_only(spark, plays, tmp_path):
    parts, path = batches(2, 2), str(tmp_path)
    inc.start(plays(*parts[0]), path)
    delta = sim.interaction_matrix(plays(("u05", "i01", 3), ("u07", "x", 1)))
    read = inc.cells_of(spark, path, inc.read_state(spark, path), delta)
    own = {(u, i) for u, i, _ in parts[0] if u in ("u05", "u07") and i}
    assert {(r.user_id, r.item_id) for r in read.collect()} == own
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("PartitionFilters: [isnotnull(part", "PartitionFilters: [part")
    changed, history = inc.changes(delta, read)
    assert changed.count() == 2 and history.count() == len(own | {("u05", "i01"), ("u07", "x")})


def test_a_version_without_its_marker_does_not_count(spark, plays, tmp_path):
    path = str(tmp_path)
    inc.start(plays(("u", "a", 1), ("u", "b", 2)), path)
    plays(("u", "a", 100)).write.parquet(f"{path}/{inc.CELLS}/version=1/part=0")
    assert inc.add(spark, path, plays(("v", "a", 1), ("v", "b", 1))) == 1
    want = sim.nearest_items(sim.interaction_matrix(plays(("u", "a", 1), ("u", "b", 2), ("v", "a", 1), ("v", "b", 1))), 3)
    assert values(inc.nearest_items(spark, path, 3), *want.columns) == values(want)


def test_no_plays(spark, plays, tmp_path):
    path = str(tmp_path)
    empty = plays(("u", "a", 1)).limit(0)
    inc.start(empty, path)
    assert inc.nearest_items(spark, path, 3).count() == 0
    inc.add(spark, path, empty)
    inc.add(spark, path, plays(("u", "a", 1), ("u", "b", 1)))
    assert inc.nearest_items(spark, path, 3).count() == 2


def test_products_of_pairs_are_not_stored(spark, plays, tmp_path):
    """What is written follows the plays, not the squares of the histories."""
    path = str(tmp_path)
    inc.start(plays(*[("u", f"i{k:03}", 1) for k in range(100)]), path)
    inc.add(spark, path, plays(("u", "i000", 1), ("v", "i001", 1)))
    assert {p.name for p in tmp_path.iterdir()} == {inc.CELLS, inc.MARKERS}
    near = inc.nearest_items(spark, path, 2)
    assert near.count() == 200
