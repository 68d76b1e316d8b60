"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary one in local mode only, as in tests: on a cluster
    a machine's own folder would scatter tables over executors' disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", path)
        _hadoop(spark, path)[0].deleteOnExit(_hadoop(spark, path)[1])
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. The JVM drops it when it ends, whether or not the session was stopped first."""
    path = f"{scratch_dir(spark)}/strandline/{label}-{uuid.uuid4().hex}"
    filesystem, where = _hadoop(spark, path)
    filesystem.deleteOnExit(where)
    _made.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    filesystem, where = _hadoop(spark, path)
    filesystem.delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[set[str]]:
    """Drop at its end what was written within it, but for the paths that the body adds to the set it is given."""
    kept: set[str] = set()
    start = len(_made)
    try:
        yield kept
    finally:
        for path in _made[start:]:
            if path not in kept:
                drop_path(spark, path)
        _made[start:] = [p for p in _made[start:] if p in kept]


def materialize(df: DataFrame, label: str, path: str | None = None, exchange: bool = True) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it back.

    Files on shared storage outlive lost executors, unlike cached blocks.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return exchanged(kept, path) if exchange else kept


#: Files of at least so many bytes hold tables that joins exchange.
EXCHANGE_BYTES = 1 << 20


def exchanged(df: DataFrame, path: str) -> DataFrame:
    """The table read from a path, marked so that joins exchange it and never broadcast it, unless its files are small.

    The planner judges by the size of compressed files and does not see that an array
    explodes: a few MB of files can be GB in the driver's and each executor's memory.
    """
    filesystem, where = _hadoop(df.sparkSession, path)
    return df.hint("merge") if filesystem.getContentSummary(where).getLength() >= EXCHANGE_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over all cores, for work by the row that is heavy beside the size of the files."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
