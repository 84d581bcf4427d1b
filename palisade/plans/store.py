"""Tables built once in a session for each state of their source, below the folder that the cluster names in ``spark.checkpoint.dir``.

Driver and executors read that folder; a lost executor costs the tasks it ran. Only a local session may go without the setting. The
session's folder goes when the driver's JVM ends. A source that has changed (paths, lengths, times of its files) is built anew."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_lock = threading.RLock()
_folders: dict[str, str] = {}
_built: dict[tuple, str] = {}


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession) -> str:
    """The folder of this session's tables."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _folders:
            root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if not root:
                if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
                own = tempfile.mkdtemp(prefix="palisade-")
                atexit.register(shutil.rmtree, own, ignore_errors=True)
                root = f"file://{own}"
            path = f"{root.rstrip('/')}/palisade-tables-{app}"
            fs, where = file_system(spark, path)
            fs.mkdirs(where)
            fs.deleteOnExit(where)
            _folders[app] = path
        return _folders[app]


def state(spark: SparkSession, path: str) -> tuple:
    """The files below a path, as they are now."""
    fs, where = file_system(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where)))


def built(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of the table ``name`` made of ``source``; ``write`` writes it to a path if it isn't there yet."""
    with _lock:
        key = (spark.sparkContext.applicationId, name, state(spark, source))
        if key not in _built:
            path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
            write(path)
            _built[key] = path
        return _built[key]


def remove(spark: SparkSession, pattern: str) -> None:
    """Delete the folders that a pattern names."""
    fs, where = file_system(spark, pattern)
    for status in fs.globStatus(where) or []:
        fs.delete(status.getPath(), True)
