"""What the operators of this package share: storage for intermediate tables, hashing, reading tables.

Intermediate tables are written below the folder that the cluster names in ``spark.checkpoint.dir``; all executors
and the driver can read it, so that a lost executor costs only the tasks it ran. Only a session whose master is
local (as in tests) may go without that setting; it gets a folder of its own.

Each operator opens a ``Workspace``, which owns the tables it stores and deletes them when the operator returns or fails. What a returned
DataFrame still reads is stored with keep=True, and then belongs to the workspace around: that of the caller, or the
session's, whose folder goes when the driver ends. Workspaces nest by thread, so that operators may run side by side
in threads and be chained lazily; a caller bounds the life of results with ``with workspace(spark):``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.workers import findable, spread

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder (a URI) that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="palisade-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


class Workspace:
    """The paths of stored tables; those kept go to the workspace around when this one is left, the others are deleted."""

    def __init__(self, spark: SparkSession, around: Workspace | None) -> None:
        self.spark, self.around = spark, around
        self.paths: list[str] = []
        self.kept: list[str] = []

    def path(self, tag: str, keep: bool = False) -> str:
        new = f"{session_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        (self.kept if keep else self.paths).append(new)
        return new

    def keep(self, path: str) -> None:
        if path in self.paths:
            self.paths.remove(path)
            self.kept.append(path)

    def leave(self, failed: bool) -> None:
        if self.around is not None and not failed:
            self.around.paths += self.kept
        gone = self.paths + self.kept if failed else self.paths
        for path in gone:
            with suppress(Exception):  # what can't be deleted now goes with the session's folder
                drop_stored(self.spark, path)


_current: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
_folders: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """The folder of this session's tables; the file system deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/palisade-{spark.sparkContext.applicationId}"
    if path not in _folders:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
        _folders.add(path)
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    own = Workspace(spark, _current.get())
    token = _current.set(own)
    failed = True
    try:
        yield own
        failed = False
    finally:
        _current.reset(token)
        own.leave(failed)


def scratch(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A path for a new table in the shared folder, owned by the workspace at hand."""
    return (_current.get() or Workspace(spark, None)).path(tag, keep)


#: Spark's setting for deleting a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: list[str | None] = []  # for each table being written, what the setting was before all of them


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within are deleted; the setting is put back when the last such run has ended."""
    with _lock:
        _writers.append(_writers[0] if _writers else spark.conf.get(CLEANUP, None))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            before = _writers.pop()
            if not _writers:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here, and its shuffle files go.

    keep: what reads it outlives the workspace at hand."""
    spark = df.sparkSession
    path = scratch(spark, tag, keep)
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """A table that was stored in the workspace at hand, to outlive it."""
    if own := _current.get():
        own.keep(df._stored_at)
    return df


def release(df: DataFrame) -> None:
    """Delete a stored table before its workspace is left."""
    drop_stored(df.sparkSession, df._stored_at)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, by Hadoop's file system, as it may be in any store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: Column) -> Column:
    """A hash of a text that tells apart rows which have a doc_id in common; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


__all__ = ["Workspace", "drop_stored", "findable", "kept", "release", "scratch", "shared_dir", "stored", "table", "text_key", "workspace"]
