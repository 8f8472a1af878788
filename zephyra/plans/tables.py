"""Written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from zephyra.session import shared_dir


#: Lets Spark remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _writing = Lock(), {}


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """``CLEANUP`` is on until the last of the writes that run side by side has ended, and then as it was."""
    with _lock:
        n, before = _writing.get(id(spark), (0, None))
        _writing[id(spark)] = n + 1, before if n else spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(id(spark))
            if n > 1:
                _writing[id(spark)] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def write_out(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the executors that made it, later readers prune its columns, and everything
    derived from it sees the same rows in the same partitions. The shuffle files of ``df`` are of no more use then.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
