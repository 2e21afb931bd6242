"""Tables between two steps: written to the cluster's shared folder, so that a lost executor loses none of them."""

from __future__ import annotations

import atexit
import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, tuple[SparkSession, str]] = {}
_of_thread = threading.local()


def _open() -> list[list[str]]:
    """The folders of the ``scratch`` blocks that this thread is in."""
    if not hasattr(_of_thread, "blocks"):
        _of_thread.blocks = []
    return _of_thread.blocks


def base_folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the checkpoint folder set on the context; a folder of this machine
    only where the master is local, as in tests. On a cluster without either it is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        chosen = context._jsc.sc().getCheckpointDir()
        named = chosen.get() if chosen.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file:///tmp/scorelake-checkpoints"
    return named.rstrip("/")


def delete(spark: SparkSession, *folders: str) -> None:
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _leave() -> None:
    for spark, root in _roots.values():
        try:
            delete(spark, root)
        except Exception:  # the JVM may be gone by now
            pass


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder's name below the shared folder; deleted at the end of ``scratch``, else when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        if not _roots:
            atexit.register(_leave)
        _roots[app] = (spark, f"{base_folder(spark)}/scorelake-{app}-{os.getpid()}-{uuid.uuid4().hex[:8]}")
    path = f"{_roots[app][1]}/{name}-{uuid.uuid4().hex}"
    if _open():
        _open()[-1].append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet and read them again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str = "result") -> DataFrame:
    """``written``, but outlives the ``scratch`` around it."""
    out = written(df, name)
    if _open():
        path = _open()[-1].pop()
        if len(_open()) > 1:
            _open()[-2].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` inside is deleted at the end; return results that are ``kept``."""
    _open().append([])
    try:
        yield
    finally:
        delete(spark, *_open().pop())
