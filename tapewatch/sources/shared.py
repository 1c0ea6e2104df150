"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    Only a local session, whose driver and tasks are one process, gets a base folder of its own where none is set.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tapewatch-")
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/tapewatch-{uuid.uuid4().hex}"


def staged(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` and read it again: it is computed once, and a lost executor costs no lineage.

    ``free``: the exchanges of earlier steps leave the disk before. Spark removes them when the driver's collector has found that
    nothing asks for them, to which a driver with a large heap comes late.
    """
    return _written(df, folder(df.sparkSession), free)


def _written(df: DataFrame, path: str, free: bool) -> DataFrame:
    spark = df.sparkSession
    if free:
        gc.collect()
        spark._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """:func:`staged` with ``free`` for tables that nothing reads after the block: they are removed at its end."""
    at = folder(spark)
    try:
        yield lambda df: _written(df, f"{at}/{uuid.uuid4().hex}", True)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
