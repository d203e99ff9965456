import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tunetally import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder)
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_configured_folder_is_used():
    assert session.shared_folder(fake("yarn", "hdfs:///ck/")) == "hdfs:///ck/app-1"


def test_only_a_local_master_falls_back_to_a_temporary_folder():
    assert session.shared_folder(fake("local[4]")).endswith("/app-1")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("local-cluster[2,1,1024]"))


def test_partitions_follow_the_input():
    assert session.shuffle_partitions(0) == 200
    assert session.shuffle_partitions(100 * 10**12) > 700_000


def test_the_folder_goes_with_the_session(tmp_path):
    """In a process of its own: the session of the tests has to stay."""
    code = f"""
from tunetally.session import *
s = build_session("x", "local[1]", input_bytes=1, **{{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.ui.enabled": "false"}})
assert s.conf.get("spark.sql.shuffle.partitions") == "200"
assert materialize(s.range(3), "t").count() == 3
import os
folder = shared_folder(s)
assert os.listdir(folder)
close_session(s)
assert not os.path.exists(folder)
"""
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr


def test_materialized_rows_and_types_stay(spark):
    table = spark.createDataFrame([(1, [0.5], None)], "n int, x array<double>, t string")
    kept = session.materialize(table, "kept")
    assert kept.schema == table.schema and kept.collect() == table.collect()


def test_what_was_shuffled_is_deleted_once_it_is_written(spark, tmp_path):
    import time

    from tunetally.operators import incremental
    from tunetally.session import CLEANUP, materialize
    from tunetally.sources.keyed import write_keyed

    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    plays = spark.range(500).selectExpr("id % 7 AS user_id", "id % 11 AS item_id", "1 AS play_count")
    before = files()
    materialize(plays.groupBy("user_id").count(), "sums")
    incremental.start(plays, str(tmp_path / "lists"))
    write_keyed(plays, "swept_plays", str(tmp_path / "keyed"), "item_id", 2)
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == "false"
    spark.sql("DROP TABLE swept_plays")
