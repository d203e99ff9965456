"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Bytes that a shuffle partition should have at most; adaptive execution merges smaller
# ones, but only a skewed join splits larger ones.
PARTITION_BYTES = 128 << 20
# Whether what a query has shuffled is deleted when it ends (from Spark 4.1 on; without it, when
# the driver's garbage collection finds it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_partitions(input_bytes: int) -> int:
    """Partitions for shuffles that move about as much as the input has; 200 at least."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app_name: str, master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution on; `conf` entries win over the defaults.

    With `input_bytes`, shuffles get as many partitions as that much data asks for.
    """
    sized = {} if input_bytes is None else {
        "spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes))
    }
    settings = {
        **sized,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Rows that carry arrays make large batches.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _one_process(master: str) -> bool:
    """Whether driver and executors are one process; those of `local-cluster` are not."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, one per application, below `spark.checkpoint.dir`.

    Only a master of one process may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not _one_process(spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        root = _local_folder()
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tunetally-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def close_session(spark: SparkSession) -> None:
    """Delete the application's folder, wherever it is, and end the session.

    Results that have not been written elsewhere can't be read afterwards.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.stop()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """For writes whose result is read back: what they have shuffled goes when they end, so the
    disk holds the shuffles of one step and not those of all steps before it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as a Parquet table in the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recomputation), fixes
    values that depend on the physical layout, such as partition ids, and frees the disk of
    what was shuffled for it.
    """
    path = new_folder(df.sparkSession, label)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
