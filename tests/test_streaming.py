import json

from conftest import values
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tunetally.plans import ingest
from tunetally.sources import files
from tunetally.schemas import SONG_COLUMNS, SONG_SCHEMA
from tunetally.streaming import ingest as new_files


def song(number, **more):
    record = {name: {"string": f"{name} {number}", "int": number, "double": number / 8}[kind] for name, kind in SONG_COLUMNS.items()}
    return {**record, **more}


def write(folder, name, *songs):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(list(songs) if len(songs) > 1 else songs[0]))


def test_a_run_reads_new_files_only(spark, tmp_path):
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    for k in range(3):
        write(source, k, song(k), song(k + 50))
    write(source, "bad", song(9, year="unknown"))
    first = new_files.ingest_new_songs(spark, str(source), target, log)
    assert first.payloads == 4 and first.table.count() == 3
    write(source / "deeper", "x", song(20))
    write(source, "y", song(21))
    second = new_files.ingest_new_songs(spark, str(source), target, log)
    assert second.payloads == 2 and second.table.count() == 5
    assert new_files.ingest_new_songs(spark, str(source), target, log).payloads == 0
    whole = ingest.ingest_songs(spark, str(source), str(tmp_path / "batch"))
    assert values(second.table) == values(whole) and second.table.schema == SONG_SCHEMA


def test_raw_songs_of_new_files(spark, tmp_path):
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    write(source, 1, song(1), song(2, year="unknown"))
    assert new_files.ingest_new_raw_songs(spark, str(source), target, log).table.count() == 2
    write(source, 2, song(3))
    run = new_files.ingest_new_raw_songs(spark, str(source), target, log)
    whole = ingest.ingest_raw_songs(spark, str(source), str(tmp_path / "batch"))
    assert run.payloads == 1 and values(run.table, *whole.columns) == values(whole)


def test_the_pass_that_writes_counts(spark, tmp_path):
    source = tmp_path / "in"
    write(source, 1, song(1), song(2, year="unknown"), song(3, tempo=None))
    write(source, 2, song(4))
    (source / "3.json").write_text("[broken")
    counts = Observation()
    songs = ingest.ingest_songs(spark, str(source), str(tmp_path / "out"), records="all", counts=counts)
    assert counts.get == {"records": 5, "kept": 2, "dropped": 3} and songs.count() == 2
    payloads = ingest.song_payloads(spark, str(source), "*.json", True, "all")
    listing = files.list_files(spark, str(source), "*.json")
    account = ingest.file_account(listing, payloads, SONG_SCHEMA)
    sums = account.agg(*(F.sum(c).alias(c) for c in ("records", "kept", "dropped"))).first()
    assert sums.asDict() == counts.get


def test_both_ingests_read_from_one_path(spark, tmp_path):
    source, both = tmp_path / "in", tmp_path / "both"
    write(source, 1, song(1), song(2))
    write(source, 2, song(3, year="unknown"))
    ingest.ingest_songs(spark, str(source), str(both / "typed"))
    ingest.ingest_raw_songs(spark, str(source), str(both / "raw"))
    songs = ingest.read_songs(spark, str(both))
    assert songs.schema == SONG_SCHEMA
    assert sorted(r.song_id for r in songs.collect()) == ["song_id 1", "song_id 1", "song_id 2", "song_id 3"]
    assert {r.year for r in songs.where("song_id = 'song_id 3'").collect()} == {None}
    for part in ("typed", "raw"):
        rows = ingest.read_songs(spark, str(both / part))
        assert rows.schema == SONG_SCHEMA and rows.where("song_id = 'song_id 1' and tempo = 0.125").count() == 1
