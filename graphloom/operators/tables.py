"""Cutting lineage: checkpoints, and tables in the shared folder that can be deleted."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints. Where spark.checkpoint.dir isn't set, a session on one machine gets a temporary folder; a cluster
    must name one that all machines share."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)  # the tables that the present pass made
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. The shuffles that made it are deleted at once, not when the driver happens to collect
    its garbage: nothing reads them again."""
    spark = df.sparkSession
    shared_folder(spark)
    usual = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # read where a plan is made
    try:
        out = df.select("*").checkpoint()
    finally:
        spark.conf.set(CLEANUP, usual)
    if (made := MADE.get()) is not None:
        made.append(out)
    return out


@contextmanager
def passing() -> Iterator[Callable[..., None]]:
    """A pass whose tables of :func:`settled` are deleted at its end, but for those named to the function that it gives. Whatever is
    read later must be settled itself and be named."""
    kept, made = [], []
    before = MADE.set(made)
    try:
        yield lambda *tables: kept.extend(t for t in tables if t is not None)
    finally:
        MADE.reset(before)
    dropped(*(t for t in made if not any(t is k for k in kept)))
    if (outer := MADE.get()) is not None:
        outer.extend(t for t in made if any(t is k for k in kept))


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of tables of :func:`settled` that nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            removed(df.sparkSession, [file.get()])


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again, and its path, for :func:`removed`."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


ROWS = 500_000  # rows that a task of a large shuffle gets


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows: as many as the session's, fewer for small tables and more for large ones, so that a
    task's memory doesn't grow with the input."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // ROWS), min(usual, -(-rows // 20_000)))


def sized_shuffles(spark: SparkSession, rows: int) -> None:
    """From now on this session's shuffles have at least a partition for each ``ROWS`` of ``rows`` rows, and partitions are joined
    up to 16 MB only, so that sorts and hash maps of a large graph's tasks don't spill. Higher counts and smaller sizes stay."""
    key, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if -(-rows // ROWS) > int(spark.conf.get(key)):
        spark.conf.set(key, str(-(-rows // ROWS)))
        if spark.conf.get(size, None) in (None, "64MB", "67108864b"):
            spark.conf.set(size, "16MB")


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that :func:`stored` wrote."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
