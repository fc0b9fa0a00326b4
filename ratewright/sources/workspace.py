"""Where intermediate tables go.

One rule for every session: below the folder in ``spark.checkpoint.dir``, and where that is
unset below the warehouse folder of the session, which a cluster's executors share. Results
are lazy, so a path is removed when the session's process ends, not before.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def work_root(spark: SparkSession) -> str:
    """The shared folder below which this session keeps intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the work root, removed when the process ends."""
    path = f"{work_root(spark)}/ratewright-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_work_paths)
    _made.append((spark, path))
    return path


@contextmanager
def checkpoint_folder(spark: SparkSession) -> Iterator[None]:
    """A folder for Spark's checkpoints: the caller's own, or a work path while this is open."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        yield
        return
    none = context._jsc.sc().checkpointDir()
    context.setCheckpointDir(work_path(spark, "checkpoints"))
    try:
        yield
    finally:
        getattr(context._jsc.sc(), "checkpointDir_$eq")(none)


def remove_work_paths() -> None:
    """Delete every path handed out so far whose session still runs."""
    while _made:
        spark, path = _made.pop()
        context = spark.sparkContext
        if context._jsc is None:  # stopped: its file system client is gone
            continue
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
