import json

import pytest
from conftest import values
from pyspark.sql import functions as F

from tunetally.functions.columns import clean_path
from tunetally.plans import ingest
from tunetally.schemas import SONG_COLUMNS, SONG_SCHEMA
from tunetally.sources import files, plays


def test_tab_separated_plays(spark, tmp_path):
    path = tmp_path / "plays.txt"
    path.write_text("u1\ta\t3\nu1\tb\t0\nu2\n")
    got = plays.read_plays_tsv(spark, str(path))
    assert got.dtypes == [("user_id", "string"), ("song_id", "string"), ("play_count", "int")]
    assert values(got) == [("u1", "a", 3), ("u1", "b", 0), ("u2", None, None)]


def test_a_bad_count_is_an_error_or_null(spark, tmp_path):
    path = tmp_path / "plays.txt"
    path.write_text("u1\ta\tabc\n")
    with pytest.raises(Exception, match="not a whole number"):
        plays.read_plays_tsv(spark, str(path)).collect()
    assert values(plays.read_plays_tsv(spark, str(path), strict=False)) == [("u1", "a", None)]


def test_a_fourth_column_is_an_error_or_nulls_the_count(spark, tmp_path):
    path = tmp_path / "plays.txt"
    path.write_text("u1\ta\t1\tx\nu2\tb\t2\n")
    with pytest.raises(Exception, match="more than three columns"):
        plays.read_plays_tsv(spark, str(path)).collect()
    got = plays.read_plays_tsv(spark, str(path), strict=False)
    assert values(got) == [("u1", "a", None), ("u2", "b", 2)]


def test_overwrite_does_not_double(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame([("u", "s", 1)], "user_id string, song_id string, play_count int")
    plays.write_plays_tsv(table, source)
    for _ in range(2):
        got = ingest.ingest_plays(spark, source, target)
    assert values(got) == [("u", "s", 1)]


def test_listing_is_recursive_and_filtered(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("a.h5", "d/b.h5", "d/e/c.h5", "d/e/c.txt"):
        (tmp_path / name).write_text("x")
    got = files.list_files(spark, str(tmp_path), "*.h5")
    assert values(got) == [(str(tmp_path / n),) for n in ("a.h5", "d/b.h5", "d/e/c.h5")]


def test_path_prefixes(spark):
    table = spark.createDataFrame([("file:///x/a.h5",), ("file:/x/a.h5",), ("/x/a.h5",)], "p string")
    assert values(table.select(clean_path(F.col("p")))) == [("/x/a.h5",)] * 3


def song(number, **changes):
    record = {n: f"{n}{number}" if k == "string" else number for n, k in SONG_COLUMNS.items()}
    return json.dumps({**record, **changes})


def test_song_ingest_policies(spark, tmp_path):
    source = tmp_path / "songs"
    (source / "deep").mkdir(parents=True)
    (source / "1.json").write_text(song(1))
    (source / "deep" / "2.json").write_text(song(2, year="x"))
    (source / "deep" / "3.txt").write_text(song(3))
    typed = ingest.ingest_songs(spark, str(source), str(tmp_path / "typed"))
    assert values(typed, "song_id", "year") == [("song_id1", 1)]
    raw = ingest.ingest_raw_songs(spark, str(source), str(tmp_path / "raw"))
    got = values(raw.withColumn("id", F.decode("get_song_id", "UTF-8")), "id", "get_year", "source_file")
    assert got == [
        ("song_id1", 1, str(source / "1.json")),
        ("song_id2", None, str(source / "deep" / "2.json")),
    ]
    assert len(raw.columns) == 24


def test_files_with_several_records(spark, tmp_path):
    source = tmp_path / "songs"
    source.mkdir()
    (source / "1.json").write_text(f"\n [{song(1)}, {song(2, year='x')}, {song(3)}]")
    (source / "2.json").write_text(song(4))
    (source / "3.json").write_text("[" + song(5))
    (source / "4.json").write_text("[]")
    (source / "5.json").write_text(f"[{song(6, year='x')}, {song(7)}]")

    def typed(name, **how):
        got = ingest.ingest_songs(spark, str(source), str(tmp_path / name), **how)
        return values(got, "song_id", "tempo")

    assert typed("first") == [("song_id1", 1.0), ("song_id4", 4.0)]
    assert typed("all", records="all") == [(f"song_id{n}", float(n)) for n in (1, 3, 4, 7)]
    raw = ingest.ingest_raw_songs(spark, str(source), str(tmp_path / "raw"))
    got = values(raw.withColumn("id", F.decode("get_song_id", "UTF-8")), "id", "get_year")
    assert got == [("song_id1", 1), ("song_id2", None), ("song_id3", 3), ("song_id4", 4),
                   ("song_id6", None), ("song_id7", 7), (None, None)]
    with pytest.raises(ValueError):
        ingest.song_payloads(spark, str(source), "*.json", True, "some")


def test_account_of_files(spark, tmp_path):
    for name, lines in (("a.txt", [song(1), song(2, year="x")]), ("b.txt", ["{"]), ("c.txt", ["{}"])):
        (tmp_path / name).write_text("\n".join(lines))
    listed = files.list_files(spark, str(tmp_path), "*.txt")
    read = files.read_payloads(spark, str(tmp_path), "[ab].txt", whole_file=False)
    got = ingest.file_account(listed, read, SONG_SCHEMA)
    assert values(got) == [(str(tmp_path / n), *c) for n, c in
                           (("a.txt", (2, 1, 1)), ("b.txt", (1, 0, 1)), ("c.txt", (0, 0, 0)))]


def test_rows_per_file(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("a\nb\n")
    assert values(files.rows_per_file(spark.read.text(str(path)))) == [("t.txt", 2)]
