"""Rows of one table against the times of another, by key: how many came before, and which ones.

A key's time is cut into blocks. Rows are put in order inside a block, and blocks by their counts, so a busy key is
spread over its blocks, and no pair of rows is made that isn't in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.sources.shared import staged

DAY = 86_400


def numbered(found: DataFrame, key: str, order: list[str], block: int = 30 * DAY) -> DataFrame:
    """``found`` with ``number``, its place from 1 among the rows of its key by ``ts`` and then ``order``."""
    rows = found.withColumn("_block", F.floor(F.col("ts") / block))
    ahead = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "_block").agg(F.count("*").alias("_n")).select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = rows.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_block").orderBy("ts", *order)))
    joined = own.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("number", F.col("_ahead") + F.col("_in")).drop("_block", "_key", "_b", "_ahead", "_in")


def counted(asked: DataFrame, found: DataFrame, key: str, moments: dict, block: int = 30 * DAY) -> DataFrame:
    """``asked`` with one column for each of ``moments`` (name: a time of the row): how many rows of ``found`` with its key have ts at or before it.

    ``asked`` has a unique ``id``. Each moment travels alone, so a row costs as many rows as it has moments.
    """
    times = found.groupBy(F.col(key).alias("_key"), F.col("ts").alias("_ts")).agg(F.count("*").alias("_n"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in moments.items())))
    points = asked.select(F.col("id").alias("_id"), F.col(key).alias("_key"), each.alias("_m")).select("_id", "_key", F.col("_m.name").alias("_name"), F.col("_m.at").alias("_ts"))
    both = points.withColumn("_n", F.lit(0).cast("long")).unionByName(times.withColumns({"_id": F.lit(None).cast(points.schema["_id"].dataType), "_name": F.lit(None).cast("string")})).withColumn("_block", F.floor(F.col("_ts") / block))
    blocks = both.groupBy("_key", "_block").agg(F.sum("_n").alias("_sum"))
    ahead = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_key", "_block").orderBy("_ts").rangeBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_in", F.sum("_n").over(inside)).where("_name is not null")
    joined = own.join(blocks, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    wide = joined.groupBy("_id").agg(*(F.max(F.when(F.col("_name") == name, F.col("_ahead") + F.col("_in"))).alias(name) for name in moments))
    return asked.join(wide, asked["id"] == wide["_id"], "left").drop("_id")


def newest_within(asked: DataFrame, found: DataFrame, key: str, back: int, ahead: int, keep: int, order: list[str]) -> DataFrame:
    """Pairs of ``asked`` (``id, key, ts``) and the newest ``keep`` rows of ``found`` of its key with ts from ``back`` before to ``ahead`` after.

    Rows of ``found`` have numbers by time; a row asks for the ``keep`` numbers up to the last one in its reach, so
    each makes ``keep`` pairs at most. Columns of ``found`` but for the key come as ``found``.
    """
    rows = numbered(found, key, order)
    rows = rows.select(F.col(key).alias("_key"), F.col("number").alias("_at"), F.struct(*(c for c in found.columns if c != key)).alias("found"))
    reach = counted(asked, found, key, {"_first": F.col("ts") - back - 1, "_last": F.col("ts") + ahead})
    wanted = reach.where(F.col("_last") > F.col("_first")).withColumn("_number", F.explode(F.sequence(F.greatest(F.col("_first"), F.col("_last") - keep) + 1, F.col("_last"))))
    met = wanted.join(rows, wanted[key].eqNullSafe(F.col("_key")) & (F.col("_number") == F.col("_at")))
    return met.select(*(asked[c] for c in asked.columns), "found")


def containing(names: DataFrame, texts: DataFrame, text_cols: list[str], name: str = "entity", size: int = 3) -> DataFrame:
    """``texts`` beside each of ``names`` (of ``size`` letters or more) that one of the ``text_cols`` contains, in any case of letters.

    A text holds a name only if it holds all its pieces of ``size`` letters. Each different text is cut once, each name looks
    among those that hold its rarest piece, and those are compared; nothing else meets. Neither texts nor their pieces are
    broadcast: small as they are in their files, they are many rows.
    """

    def pieces(c):
        starts = F.sequence(F.lit(1), F.length(c) - size + 1)
        return F.array_distinct(F.when(F.length(c) >= size, F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))

    asked = names.select(name).where(F.length(name) >= size).distinct().withColumn("_low", F.lower(name))
    wanted = asked.withColumn("_piece", F.explode(pieces(F.col("_low"))))
    parts = [f"_part{k}" for k in range(len(text_cols))]
    held = staged(texts.select(*(F.col(c).alias(p) for c, p in zip(text_cols, parts))).distinct().withColumn("_id", F.monotonically_increasing_id()))
    low = F.concat_ws("\n", *(F.lower(p) for p in parts))
    shown = staged(held.select("_id", F.explode(pieces(low)).alias("_piece")).join(wanted.select("_piece").distinct(), "_piece", "left_semi"))
    seen = shown.groupBy("_piece").agg(F.count("*").alias("_seen"))
    rarest = wanted.join(seen, "_piece", "left").groupBy(name, "_low").agg(F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("_seen"), "_piece")).alias("_r"))
    found = rarest.where("_r._seen > 0").select(F.col(name).alias("_name"), "_low", F.col("_r._piece").alias("_piece")).join(shown.hint("merge"), "_piece").select("_name", "_low", "_id")
    holds = F.lit(False)
    for p in parts:
        holds = holds | F.coalesce(F.contains(F.lower(p), F.col("_low")), F.lit(False))
    whole = found.join(held.hint("merge"), "_id").where(holds).select("_name", *parts)
    # whole texts come as one column, so that no name of theirs meets one of these
    same = F.lit(True)
    for c, p in zip(text_cols, parts):
        same = same & F.col(f"_text.{c}").eqNullSafe(F.col(p))
    met = texts.select(F.struct(*texts.columns).alias("_text")).join(whole.hint("merge"), same)
    return met.select(F.col("_name").alias(name), *(F.col(f"_text.{c}") for c in texts.columns if c != name))
