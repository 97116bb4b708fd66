"""Tables in the shared checkpoint folder: how lineage is cut.

The folder is the one that the cluster names in spark.checkpoint.dir. Where
that is unset, only a session whose tasks all run in the driver gets a folder
of its own (tests); on a cluster it would be another folder for each machine,
so that is refused. Tables are deleted when the session's program ends, by
``discard`` before, or not at all if they were asked to be kept.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file:///tmp/checkpoints/brindle"
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if not keep:
        _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def materialize_by(df: DataFrame, name: str, column: str, parts: int) -> DataFrame:
    """Like ``materialize``, in ``parts`` by the hash of ``column``, so that
    what meets on that column need not be shuffled again. Spark keeps such a
    layout with a table's name only, which is the folder's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _written[path] = spark
    table = "brindle_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    _tables[path] = table
    df.write.bucketBy(parts, column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._brindle_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_brindle_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


@atexit.register
def release() -> None:
    """Delete all tables that were not kept, once nothing reads them."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
