"""Global ranks without a global sort in one task: values are dealt out by ranges, and each range knows the rows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.sources.shared import staged


def counted_ranks(rows: DataFrame, value: str) -> DataFrame:
    """``value, n, below, total``: each value that isn't null, its rows, and the rows of lesser values and of all.

    Ranges are written once, so that a range keeps its number; the sums of ranges are a row a range.
    """
    same = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    placed = staged(same.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    parts = parts.select("part", before.alias("before"), F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inside", inside).join(F.broadcast(parts), "part").select(value, "n", (F.col("before") + F.col("inside")).alias("below"), "total")
