import pytest
from conftest import values

from tunetally.operators import ragged


@pytest.mark.parametrize(
    "offsets, flat, want",
    [
        ([0, 2], [1, 2, 3, 4, 5], [[1, 2], [3, 4, 5]]),
        ([0, 0, 3], [1, 2, 3], [[], [1, 2, 3], []]),
        ([0, 2, 2], [1, 2], [[1, 2], [], []]),
    ],
)
def test_slices(spark, offsets, flat, want):
    packed = spark.createDataFrame([("f", offsets, flat)], "file string, off array<int>, flat array<int>")
    got = ragged.slice_arrays(packed, "flat", "off")
    assert [r["slice"] for r in got.orderBy("row_no").collect()] == want

    starts = spark.createDataFrame(
        [("f", i, o) for i, o in enumerate(offsets)], "file string, row_no int, start int"
    )
    cells = spark.createDataFrame(
        [("f", i, v) for i, v in enumerate(flat)], "file string, pos int, value int"
    )
    table = ragged.slice_table(starts, cells, "file")
    assert [r["slice"] for r in table.orderBy("row_no").collect()] == want


def test_long_slices_cross_buckets(spark):
    n = 4 * ragged.BUCKET + 3
    cuts = [0, 5, ragged.BUCKET - 1, ragged.BUCKET, 3 * ragged.BUCKET + 1]
    starts = spark.createDataFrame(
        [(f, i, c) for f in "xy" for i, c in enumerate(cuts)], "file string, row_no int, start int"
    )
    cells = spark.createDataFrame(
        [(f, p, p) for f in "xy" for p in range(n)], "file string, pos int, value int"
    )
    rows = ragged.slice_rows(starts, cells, "file")
    sizes = {(r["file"], r["row_no"]): r["count"] for r in rows.groupBy("file", "row_no").count().collect()}
    ends = [*cuts[1:], n]
    assert sizes == {(f, i): e - c for f in "xy" for i, (c, e) in enumerate(zip(cuts, ends))}


def test_two_dimensional_values(spark):
    packed = spark.createDataFrame(
        [([0, 1], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])],
        "off array<int>, flat array<array<double>>",
    )
    got = ragged.slice_arrays(packed, "flat", "off").orderBy("row_no").collect()
    assert [r["slice"] for r in got] == [[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]]
    starts = spark.createDataFrame([("f", 0, 0), ("f", 1, 1)], "file string, row_no int, start int")
    cells = spark.createDataFrame(
        [("f", 0, [1.0, 2.0]), ("f", 1, [3.0, 4.0])], "file string, pos int, value array<double>"
    )
    assert values(ragged.slice_table(starts, cells, "file"), "row_no", "slice") == [
        (0, [[1.0, 2.0]]),
        (1, [[3.0, 4.0]]),
    ]


def test_song_arrays_share_offsets(spark):
    songs = spark.createDataFrame(
        [("f", 0, 0), ("f", 1, 1), ("g", 0, 0)],
        "source_file string, row_no int, idx_artist_terms int",
    )
    runs = spark.createDataFrame(
        [("f", 0, 0.5), ("f", 1, 0.25), ("f", 2, 1.0), ("g", 0, 2.0)],
        "source_file string, pos int, value double",
    )
    assert values(ragged.song_arrays(songs, runs, "artist_terms_freq")) == [
        ("f", 0, [0.5]),
        ("f", 1, [0.25, 1.0]),
        ("g", 0, [2.0]),
    ]
