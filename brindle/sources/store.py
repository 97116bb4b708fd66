"""Cutting lineage by tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a folder
    of our own if all tasks run in the driver; on a cluster it would be another
    one on each machine, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints/brindle").rstrip("/")


_written: dict[str, SparkSession] = {}


def placed(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted in the end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    path = placed(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    sc = _written[path].sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    del _written[path]


@contextmanager
def scratch():
    """What is written within is deleted at the end of the block, by when its
    results must have been written or collected: for long sessions."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _delete(path)


@atexit.register
def release() -> None:
    """Delete the tables written here, once nothing reads them: when the
    program ends, or when called."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
