"""Folders that driver and executors share, and tables kept there between the steps of a job."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FOLDERS = 64  # of a task; rows of further folders are sorted

_LOCAL: dict[str, str] = {}
_OPEN = threading.local()  # streams of one process run in threads of their own


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names; in local mode, where none is named, `fallback` or a folder of the process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    local = master == "local" or master.startswith("local[")
    root = named or ((fallback or local_folder()) if local else None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return root.rstrip("/")


def local_folder() -> str:
    """One fresh folder per process, for local sessions that name no shared one."""
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL["root"]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of `path`."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` below the shared folder and read it back.

    Values that depend on how rows were dealt out (partition numbers, row ids) are fixed
    by it, and lost executors cost no recomputation. The folder belongs to the job; inside
    `scratch` it is removed at the end, elsewhere it stays.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "folders", None):
        _OPEN.folders[-1].append(path)
    # Where the rows go to folders, a task writes to them side by side: sorting by folder would hold all its rows.
    before = spark.conf.get(WRITERS)
    if partition_by:
        spark.conf.set(WRITERS, str(OPEN_FOLDERS))
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(WRITERS, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what `stored` wrote inside, once the block has ended well or badly."""
    _OPEN.folders = [*getattr(_OPEN, "folders", []), []]
    try:
        yield
    finally:
        for path in _OPEN.folders.pop():
            fs, jvm_path = file_system(spark, path)
            fs.delete(jvm_path, True)
