"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_writing: dict[str, tuple[int, str | None]] = {}  # for each session: tables being written, and the setting before the first of them
_scopes = threading.local()


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a table is there; without this they stay until the driver collects garbage.

    The setting is the session's, so it is put back only when no thread writes any more.
    """
    key = spark._jsparkSession.sessionUUID()
    with _LOCK:
        n, before = _writing.get(key, (0, None))
        if not n:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writing[key] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = (n - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


@contextmanager
def spent(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` makes inside are deleted at the end, so nothing that is read later may depend on them."""
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = paths = []
    try:
        yield
    finally:
        _scopes.paths = outer
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="scoresieve-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; its path is in ``stored_path``. path: where, instead of a new name."""
    spark = df.sparkSession
    where = path or f"{shared_dir(spark)}/scoresieve/{tag}-{uuid.uuid4().hex}"
    if not path and getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(where)
    with _cleaned(spark):
        df.write.mode("overwrite" if path else "errorifexists").parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.stored_path = where
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``stored``, once nothing reads it any more."""
    if path := getattr(df, "stored_path", None):
        _delete(df.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as df has columns of those names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
