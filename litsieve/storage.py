"""Folders that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Paths that are written inside each open ``scratch``, the innermost last.
_OPEN: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a private one where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="litsieve-"))
    return _OWN[0]


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/litsieve/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files survive lost executors, so a later failure repeats the read and not the work before it.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the yielded function was called with.

    What leaves the block must read kept tables only.
    """
    own: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.table_path)
        return table

    _OPEN.append(own)
    try:
        yield keep
    finally:
        _OPEN.pop()
        if _OPEN:
            _OPEN[-1] += [p for p in own if p in kept]
        for p in own:
            if p not in kept:
                remove_tree(spark, p)


def drop(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote."""
    remove_tree(table.sparkSession, table.table_path)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage now: shuffle files of finished work are deleted with it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, tag: str, limit: int = 10_000) -> DataFrame:
    """A table written out and counted: with a broadcast hint up to ``limit`` rows, without one beyond."""
    from pyspark.sql import functions as F

    m = materialize(df, tag)
    return F.broadcast(m) if m.count() <= limit else m


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

