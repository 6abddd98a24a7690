"""Written stages: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a local master uses /tmp/checkpoints and any other raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


@contextmanager
def _own_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go as soon as it has ended; the setting is the session's own again afterwards."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def staged(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    A local session deletes its tables at exit; on a cluster they stay until released, or as long
    as that folder keeps files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{tag}-{uuid.uuid4().hex}"
    with _own_shuffles_go(spark):
        df.write.option("compression", codec).parquet(path)
    if spark.sparkContext.master.startswith("local[") and path.startswith(("/", "file:")):  # one process: nobody reads it later
        atexit.register(shutil.rmtree, path.removeprefix("file:").replace("//", "/"), ignore_errors=True)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    for tables in _open:
        tables.append(out)
    return out


def staged_small(df: DataFrame, tag: str, files: int = 8) -> DataFrame:
    """Like staged(), for tables of a few rows a group: in few files, whose size then tells Spark that they can be broadcast."""
    return staged(df.coalesce(files), tag)


def reread(table: DataFrame) -> DataFrame:
    """Another reader of a staged table, whose columns are told apart from the first one's in a self-join."""
    return table.sparkSession.read.schema(table.schema).parquet(table._stage_path)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "_stage_path", None)
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that are staged inside, in order."""
    tables: list[DataFrame] = []
    _open.append(tables)
    try:
        yield tables
    finally:
        _open.remove(tables)
