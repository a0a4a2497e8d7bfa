"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver ends.  Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomery-")
    path = f"{base.rstrip('/')}/loomery/{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_folders() -> None:
    for spark, path in _FOLDERS:
        try:
            drop_folder(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once and read back: what follows depends on those files alone."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
