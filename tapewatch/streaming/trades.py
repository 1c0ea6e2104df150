"""Streaming forms: bars, sessions, deduplication, upserts and the stateful watchlist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapewatch.operators.watch import CAP_PRICE, CAP_SCORE, POINTS, conviction

#: The columns of the event files.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events(spark: SparkSession, sf_dir: str, late: str = "10 minutes") -> DataFrame:
    """The event files as a stream of trades ``market, id, ts, p, usd, kind``, with a watermark on ``ts``."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    rows = raw.select(F.col("user_id").alias("market"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (0.05 + 0.9 * F.col("value") / (F.col("value") + 20)).alias("p"), F.col("value").alias("usd"), F.col("event_type").alias("kind"))
    return rows.withWatermark("ts", late)


def bars(stream: DataFrame, every: str = "1 hour") -> DataFrame:
    """``market, start, p, volume, n`` of each closed interval."""
    found = stream.groupBy("market", F.window("ts", every)).agg(F.max_by("p", F.struct("ts", "id")).alias("p"), F.sum("usd").alias("volume"), F.count("*").alias("n"))
    return found.select("market", F.col("window.start").alias("start"), "p", "volume", "n")


def sliding_entries(stream: DataFrame, width: str = "15 minutes", step: str = "1 minute") -> DataFrame:
    """``start, markets, n``: distinct markets traded in sliding windows."""
    found = stream.groupBy(F.window("ts", width, step)).agg(F.approx_count_distinct("market").alias("markets"), F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "markets", "n")


def sessions(stream: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """``market, start, end, n, usd`` of each run of trades without a longer gap."""
    found = stream.groupBy("market", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))
    return found.select("market", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "usd")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def with_catalog(stream: DataFrame, catalog: DataFrame, key: str = "market") -> DataFrame:
    """Stream-static join; unknown markets are left out."""
    return stream.join(catalog, key)


WATCH = "market long, trades long, usd double, score int, status string, at timestamp"
_STATE = "trades long, usd double, score int, last double, resolved double, side string"
LIST_AT, PROMOTE_AT = 25, 65


def _watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A market's trades and resolutions: listed from a score, then promoted or cleared, retired by a timer."""
    trades, usd, score, last, resolved, side = state.get if state.exists else (0, 0.0, 0, 0.0, 0.0, "")

    def row(status):
        return pd.DataFrame([(key[0], trades, usd, score, status, pd.Timestamp(max(last, resolved), unit="s").floor("us"))], columns=["market", "trades", "usd", "score", "status", "at"])

    if state.hasTimedOut:
        state.remove()
        yield row("retired")
        return
    for rows in batches:
        bets, ends = rows[rows["kind"] != "resolution"], rows[rows["kind"] == "resolution"]
        if len(bets):
            trades += len(bets)
            usd += float(bets["usd"].sum())
            score = max(score, int(bets["score"].max()))
            last = max(last, bets["ts"].max().timestamp())
        if len(ends):
            end = ends.sort_values("ts").iloc[-1]
            resolved, side = end["ts"].timestamp(), str(end["outcome"])
    state.update((trades, usd, score, last, resolved, side))
    state.setTimeoutTimestamp(int((resolved + 7 * 86_400 if resolved else last + 30 * 86_400) * 1000))
    status = "listed" if score >= LIST_AT else "open"
    if resolved:
        status = "promoted" if side == "YES" and score >= PROMOTE_AT else "cleared"
    yield row(status)


def watch_points(stream: DataFrame) -> DataFrame:
    """The stream with ``score``: the batch watchlist's points of conviction, size and news, and ``outcome`` (null for trades)."""
    points = conviction(F.col("p"), F.lit(1000)) + F.when(F.col("usd") >= 100, POINTS["outsized"]).otherwise(0) + F.when(F.col("kind") == "error", POINTS["blackout"]).otherwise(0)
    return stream.withColumns({"score": F.greatest(F.lit(0), F.when(F.col("p") >= CAP_PRICE, F.least(F.lit(CAP_SCORE), points)).otherwise(points)).cast("int"), "outcome": F.lit(None).cast("string")})


def with_resolutions(trades: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One input for the watchlist: scored trades and resolutions (``market, ts, outcome``); one that comes before its trades waits in state."""
    ends = resolutions.select("market", F.lit(None).cast("long").alias("id"), "ts", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("usd"), F.lit("resolution").alias("kind"), F.lit(0).alias("score"), "outcome")
    return trades.unionByName(ends)


def watchlist(stream: DataFrame) -> DataFrame:
    """Stateful list by market, updated with each batch: open, listed, promoted (won at a high score), cleared; state leaves 7 days after the
    resolution, or 30 days after the last trade, and says retired."""
    scored = stream if "score" in stream.columns else watch_points(stream)
    return scored.groupBy("market").applyInPandasWithState(_watch, WATCH, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run all that is there through ``each`` in micro-batches and stop; progress is kept in ``folder``."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream puts out for all that is there, as a table with the batch's number in ``batch``."""
    spark = stream.sparkSession

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}x")

    drained(stream, folder, keep, mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def merge_sketch(folder: str, column: str, precision: int = 12) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one sketch a batch under ``folder``; a batch that runs again replaces its own."""

    def each(rows: DataFrame, number: int) -> None:
        rows.agg(F.hll_sketch_agg(column, precision).alias("sketch")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return each


def versions(spark: SparkSession, folder: str, below: int | None = None) -> int | None:
    """The newest written version of a table (under ``below``), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    found = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    return max((n for n in found if below is None or n < below), default=None)


def upsert_table(folder: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the next version of a table from the newest one before it and the batch. No version is read and written at once;
    a batch number that was skipped leaves no gap, and a batch that runs again replaces its own version."""

    def each(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        last = versions(spark, folder, number)
        old = None if last is None else spark.read.parquet(f"{folder}/version={last}")
        merge(old, rows).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return each


def summed_positions(old: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``market, trades, usd, last``: a table of sums with a batch of trades added."""
    new = rows.groupBy("market").agg(F.count("*").alias("trades"), F.sum("usd").alias("usd"), F.max("ts").alias("last"))
    both = new if old is None else old.unionByName(new)
    return both.groupBy("market").agg(F.sum("trades").alias("trades"), F.sum("usd").alias("usd"), F.max("last").alias("last"))


def alert_once(folder: str, least: float) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a market's first trade of ``least`` dollars, once for all batches."""

    def each(rows: DataFrame, number: int) -> None:
        spark, schema = rows.sparkSession, "market long, id long, usd double"
        sent = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/sent") if number and versions(spark, f"{folder}/sent", number) is not None else spark.createDataFrame([], schema)
        first = rows.where(F.col("usd") >= least).groupBy("market").agg(F.min(F.struct("ts", "id", "usd")).alias("f")).select("market", "f.id", "f.usd")
        first.join(sent.select("market"), "market", "left_anti").write.mode("overwrite").parquet(f"{folder}/sent/version={number}")

    return each
