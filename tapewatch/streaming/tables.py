"""Tables that streams keep: by buckets with a manifest, and the surveillance queue with its audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators import lifecycle
from tapewatch.streaming.trades import versions


class BucketTable:
    """For foreachBatch: a keyed table in ``buckets`` folders, of which a batch writes only those that it touches.

    ``merge(old, new)`` makes the rows of the touched buckets. ``data/version=n/bucket=b`` holds what batch n wrote of a
    bucket, ``manifest/version=n`` which version of each bucket counts after it. A batch reads the manifest before its own
    and replaces its own version, so one that runs again changes nothing; readers see a batch when its manifest is there.
    """

    def __init__(self, folder: str, key: tuple[str, ...], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 256, parts: int = 32):
        self.folder, self.key, self.merge, self.buckets, self.parts = folder, key, merge, buckets, parts

    def manifest(self, spark: SparkSession, below: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows; ``buckets`` entries at most."""
        last = versions(spark, f"{self.folder}/manifest", below)
        return {} if last is None else {r["bucket"]: r["at"] for r in spark.read.parquet(f"{self.folder}/manifest/version={last}").collect()}

    def _rows(self, spark: SparkSession, places: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
        return spark.read.parquet(*paths) if paths else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table as the newest manifest has it; null before the first batch."""
        return self._rows(spark, self.manifest(spark))

    def __call__(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r["bucket"] for r in rows.select(bucket.alias("bucket")).distinct().collect()]
        places = self.manifest(spark, number)
        old = self._rows(spark, {b: v for b, v in places.items() if b in touched})
        merged = self.merge(rows.limit(0) if old is None else old, rows)
        # one shuffle by bucket and part of its keys, so no task gets a whole bucket; small parts are put together again
        part = F.pmod(F.xxhash64(F.lit(1), *self.key), F.lit(self.parts))
        merged.withColumn("bucket", bucket).repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={number}")
        places |= dict.fromkeys(touched, number)
        said = spark.createDataFrame(sorted(places.items()), "bucket int, at int").coalesce(1)
        said.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={number}")


class QueueStream:
    """For foreachBatch: the surveillance queue and its audit, both as versions of one batch number.

    A batch has scans (``engine, market, ts, id, score``); a market's newest one counts. The time of the batch is its newest scan, and
    markets not scanned for ``retire_after`` seconds by then are retired. The queue is made from the version before the batch, the
    audit from the queue, so a batch that runs again writes the same two.
    """

    def __init__(self, folder: str, least: float, retire_after: int = 14 * 86_400, tiers: tuple[str, str] = ("Watch", "Elevated")):
        self.folder, self.least, self.retire_after, self.tiers = folder, least, retire_after, tiers

    def __call__(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        now = rows.agg(F.max("ts")).first()[0]
        last = versions(spark, f"{self.folder}/queue", number)
        schema = "engine string, market long, first_seen long, last_scanned long, tier string, score long, status string"
        old = spark.createDataFrame([], schema) if last is None else spark.read.parquet(f"{self.folder}/queue/version={last}").drop("change")
        if now is None:
            now = old.agg(F.max("last_scanned")).first()[0] or 0
        newest = rows.groupBy("engine", "market").agg(F.max_by("score", F.struct("ts", "id")).alias("score"))
        scanned = newest.withColumn("tier", F.when(F.col("score") >= self.least, self.tiers[1]).otherwise(self.tiers[0]))
        lifecycle.queue_upsert(old, scanned, now, self.retire_after).withColumn("at", F.lit(now).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/queue/version={number}")
        queue = spark.read.parquet(f"{self.folder}/queue/version={number}")
        lifecycle.audit(queue).write.mode("overwrite").parquet(f"{self.folder}/audit/version={number}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/queue/version={versions(spark, f'{self.folder}/queue')}")

    def audit(self, spark: SparkSession) -> DataFrame:
        """Audit rows of all batches."""
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/audit")
