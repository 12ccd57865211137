"""Session defaults and the two pieces of shared storage the operators need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWNED: ContextVar[tuple[list[str], ...]] = ContextVar("_OWNED", default=())
"""The tables written inside each open ``scratch`` block, the innermost last."""

_FILES: ContextVar[int | None] = ContextVar("_FILES", default=None)
"""The most files of a table that is written inside the innermost ``scratch`` block that says so."""


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName("leakfree")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (tests) may fall
    back to a temporary folder; on a cluster a machine-local folder would not survive the
    loss of an executor, so the absence of the setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def folder_stamp(spark: SparkSession, path: str, depth: int = 1) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, time) of the data files in a folder and ``depth`` levels below; empty if there is no folder.

    Only the file system's listing is read, so the stamp is cheap and works in any store.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return ()
    out: list[tuple[str, int, int]] = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if status.isDirectory():
            if depth:
                out += [(f"{name}/{n}", b, t) for n, b, t in folder_stamp(spark, status.getPath().toString(), depth - 1)]
        elif not name.startswith((".", "_temporary")):
            out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


class Scratch:
    """The tables written inside a ``scratch`` block."""

    def __init__(self, spark: SparkSession, outer: tuple[list[str], ...]) -> None:
        self.spark, self._outer, self._own = spark, outer, []

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """``df`` as a table that outlives the block; an enclosing block owns it, if there is one."""
        token = _OWNED.set(self._outer)
        try:
            return stored(df, name)
        finally:
            _OWNED.reset(token)

    def clear(self) -> None:
        """Delete what was written so far; nothing may read it any more."""
        while self._own:
            delete_path(self.spark, self._own.pop())


@contextmanager
def scratch(spark: SparkSession, files: int | None = None) -> Iterator[Scratch]:
    """A block that owns the tables ``stored`` writes inside it and deletes them when it ends, by an error too.

    A result that is read later must be written out inside the block, or handed over by ``keep``. Blocks nest. Operators whose
    result is lazy cannot know when it has been read, so the block belongs to whoever reads it. Nothing is deleted
    outside of blocks.

    ``files`` bounds the files of each table written inside (inner blocks too) and so the tasks that write it: many rounds over
    small tables else cost a task for every shuffle partition each time.
    """
    block = Scratch(spark, _OWNED.get())
    token = _OWNED.set((*block._outer, block._own))
    most = _FILES.set(files or _FILES.get())
    try:
        yield block
    finally:
        _FILES.reset(most)
        _OWNED.reset(token)
        block.clear()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table through the file system that holds it; a missing one is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_stage(df: DataFrame, name: str, partition: str | None = None) -> str:
    """Write ``df`` as a parquet table in the shared folder; returns its path."""
    path = scratch_path(df.sparkSession, name)
    if _OWNED.get():
        _OWNED.get()[-1].append(path)
    with _shuffles_go(df.sparkSession):
        if partition:
            df.hint("rebalance", partition).write.partitionBy(partition).parquet(path)
        else:
            (df.coalesce(most) if (most := _FILES.get()) else df.select("*")).write.parquet(path)
    return path


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "stage", partition: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts the lineage like a checkpoint and survives the loss of executors; unlike a checkpoint
    the result is columnar, so later steps read only their columns, and its size is known to the
    planner, which then broadcasts it only if it is small.
    """
    path = write_stage(df, name, partition)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def once(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a table, for who reads it several times; what ``stored`` made is one already."""
    return df if "stage_path" in vars(df) else stored(df, name)


def drop_stage(df: DataFrame) -> None:
    """Delete the table of ``df`` if ``stored`` made it; nothing may read it any more."""
    if (path := vars(df).get("stage_path")) is not None:
        delete_path(df.sparkSession, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table an operator writes and reads back."""
    return f"{checkpoint_base(spark).rstrip('/')}/scratch-{name}-{uuid.uuid4().hex}"
