"""What the operators share: tables in the cluster's shared folder, and small Column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, or what ``setCheckpointDir`` was given.

    Only a local session, whose driver and tasks are one process, gets a folder of its own where neither is set.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-tapewatch-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapewatch-{uuid.uuid4().hex}/{tag}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tapewatch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_tapewatch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def packed(docs: DataFrame, **more) -> DataFrame:
    """``docs`` with all its columns in one, ``row``, so that no name of theirs meets one of the ``more`` columns."""
    return docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in more.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int):
    """``crc32(id as text) mod n``, the split that held-out rows are chosen by."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
