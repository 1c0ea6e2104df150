"""Trade-time watchlist: score of a trade in a market that hasn't resolved yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each signal; conviction runs from 35 down to -25 around 0.85.
POINTS = {"outsized": 20, "blackout": 35, "repeat": 30, "fresh": 15, "anticipated": 12, "publicInfo": -20}
LIST_AT, PROMOTE_AT, CAP_PRICE, CAP_SCORE = 25, 65, 0.95, 15


def conviction(price: Column, size: Column, least: float = 1000) -> Column:
    q = F.least(price, F.lit(1.0))
    points = F.when(q < 0.85, F.floor(35 * (0.85 - q) / 0.85 + 0.5)).otherwise(F.floor(-25 * (q - 0.85) / 0.15 + 0.5))
    return F.when((size >= least) & (price > 0), points).otherwise(0).cast("int")


def peer_statistics(trades: DataFrame, share: float = 0.9) -> DataFrame:
    """``cond, n, total, squares, p90, volume``: sizes in each market; p90 is the element at floor(.9(n-1)).

    The quantile comes from ranks of counted sizes, so no task holds a market's sizes as an array.
    """
    from pyspark.sql import Window

    sizes = trades.groupBy("cond", "usd").agg(F.count("*").alias("k"))
    w = Window.partitionBy("cond").orderBy("usd")
    ranked = sizes.withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy("cond"))})
    at = F.floor(share * (F.col("n") - 1)) + 1
    return ranked.groupBy("cond").agg(F.first("n").alias("n"), F.sum(F.col("k") * F.col("usd")).alias("total"), F.sum(F.col("k") * F.col("usd") * F.col("usd")).alias("squares"), F.min(F.when(F.col("upto") >= at, F.col("usd"))).alias("p90"))


def score(trades: DataFrame, peers: DataFrame, flagged: DataFrame, least: float = 1000) -> DataFrame:
    """``cond, wallet, tx, usd, price, size_z, whale_x, vol_share, outsized, conviction, repeat, fresh, score, listed``.

    Peers of a trade are the market's other trades. ``fresh`` marks a wallet's first trade anywhere.
    """
    first = trades.groupBy("wallet").agg(F.min(F.struct("ts", "tx")).alias("first"))
    big = trades.where(F.col("usd") >= least)
    rows = big.join(peers, "cond").join(first, "wallet").join(flagged.select("wallet", F.lit(True).alias("flagged")).distinct(), "wallet", "left")
    n, total, squares = F.col("n") - 1, F.col("total") - F.col("usd"), F.col("squares") - F.col("usd") * F.col("usd")
    mean = total / F.when(n > 0, n)
    sd = F.sqrt(F.greatest(F.lit(0.0), (squares - n * mean * mean) / F.when(n > 1, n - 1)))
    rows = rows.withColumns({"size_z": F.when(sd > 0, (F.col("usd") - mean) / sd).otherwise(0.0), "whale_x": F.when(F.col("p90") > 0, F.col("usd") / F.col("p90")).otherwise(0.0), "vol_share": F.col("usd") / F.col("total")})
    outsized = (F.col("usd") >= 25_000) | ((F.col("vol_share") >= 0.08) & (F.col("usd") >= 5000)) | ((n >= 6) & ((F.col("size_z") >= 3) | (F.col("whale_x") >= 10)) & (F.col("usd") >= 5000))
    rows = rows.withColumns({"outsized": outsized, "conviction": conviction(F.col("price"), F.col("usd")), "repeat": F.coalesce("flagged", F.lit(False)), "fresh": F.col("first.tx") == F.col("tx")})
    sum_ = POINTS["outsized"] * F.col("outsized").cast("int") + F.col("conviction") + POINTS["repeat"] * F.col("repeat").cast("int") + POINTS["fresh"] * F.col("fresh").cast("int")
    capped = F.when(F.col("price") >= CAP_PRICE, F.least(F.lit(CAP_SCORE), sum_)).otherwise(sum_)
    rows = rows.withColumn("score", F.greatest(F.lit(0), capped))
    return rows.select("cond", "wallet", "tx", "usd", "price", "size_z", "whale_x", "vol_share", "outsized", "conviction", "repeat", "fresh", "score", (F.col("score") >= LIST_AT).alias("listed"))


def reconcile(watchlist: DataFrame, catalog: DataFrame, flagged: DataFrame, now: int, keep: int = 7 * 86_400) -> DataFrame:
    """``watchlist`` with ``status``: open, promoted (won, flagged, high score), cleared; retired a week after resolution."""
    joined = watchlist.join(catalog.select("cond", "winner", "resolved_ts"), "cond", "left").join(flagged.select("wallet", F.lit(True).alias("_flagged")).distinct(), "wallet", "left")
    resolved = F.col("resolved_ts") <= now
    won = F.col("outcome") == F.col("winner")
    status = F.when(resolved & (F.lit(now) - F.col("resolved_ts") > keep), "retired").when(resolved & won & F.col("_flagged") & (F.col("score") >= PROMOTE_AT), "promoted").when(resolved, "cleared").otherwise("open")
    return joined.withColumn("status", status).drop("_flagged")
