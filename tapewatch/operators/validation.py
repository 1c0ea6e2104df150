"""Checks of a published set: permutation null test, lift of each detector, shadow distribution, sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.ranks import counted_ranks


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of ``x``, in its place."""
    y = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        x ^= np.right_shift(x, np.uint64(shift), out=y)
        if factor:
            x *= np.uint64(factor)
    return x


def _drawn_wins(batches, draws: int, block: int = 1 << 15):
    """``draw, w``: wins of this part's bets in each draw; a bet wins where the uniform of (bet, draw) lies under its odds.

    A hash of 64 bits has the uniforms of two draws. Odds are rounded to 32 bits up or down by a hash of the bet, so that its
    chance to win is its odds.
    """
    wins, any_bet = np.zeros(draws + draws % 2, np.int64), False
    draw = _mixed(np.arange(1, len(wins) // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        any_bet |= batch.num_rows > 0
        key, p = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
        part = (_mixed(key ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)) * 2.0**-53
        limit = np.where(p > 0, np.floor(np.minimum(p, 1) * 2.0**32 + part), 0)
        sure = limit >= 2.0**32
        wins += int(sure.sum())
        open_bet = (limit > 0) & ~sure
        key, limit = key[open_bet], limit[open_bet].astype(np.uint32)
        for at in range(0, len(key), block):
            k, most = key[at : at + block], limit[at : at + block]
            step = max(1, block // len(k))
            for d in range(0, len(draw), step):
                told = _mixed(k + draw[d : d + step, None]).view(np.uint32)
                for odd in (0, 1):
                    under = told[:, odd::2] < most
                    wins[2 * d + odd : 2 * (d + step) : 2] += [np.count_nonzero(u) for u in under] if len(k) > 512 else np.count_nonzero(under, axis=1)
    if any_bet:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1)), pa.array(wins[:draws])], names=["draw", "w"])


def null_facts(bets: DataFrame) -> DataFrame:
    """One row ``n, observed, expected, sd``: wins, and what the odds let expect."""
    return bets.agg(F.count("*").alias("n"), F.count_if("won").alias("observed"), F.sum("p").alias("expected"), F.sqrt(F.sum(F.col("p") * (1 - F.col("p")))).alias("sd"))


def null_test(bets: DataFrame, draws: int = 10_000, seed: int = 7, parts: int = 256) -> DataFrame:
    """One row ``n, observed, expected, sd, z, p``: wins against a null in which each bet wins at its odds.

    Uniforms are hashes of (seed, draw, bet), the same under any partitioning. Bets are dealt into parts;
    each part counts the wins of all draws, so ``draws`` x ``parts`` rows are shuffled, however many bets there are.
    """
    rows = bets.select(F.xxhash64(F.lit(seed), "bet_id").alias("key"), F.col("p").cast("double").alias("p"), "won")
    facts = null_facts(rows)
    drawn = rows.select("key", "p").repartition(parts, "key").mapInArrow(lambda batches: _drawn_wins(batches, draws), "draw long, w long")
    wins = drawn.groupBy("draw").agg(F.sum("w").alias("w"))
    p = wins.join(F.broadcast(facts)).agg(((F.count_if(F.col("w") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"))
    return facts.join(F.broadcast(p)).withColumn("z", (F.col("observed") - F.col("expected")) / F.col("sd"))


def detector_lift(fired: DataFrame, rates: DataFrame, least: int = 8) -> DataFrame:
    """``detector, n_fired, n_other, rate_fired, rate_other, reliable``: win rates of wallets where it fires and where not.

    Totals over all wallets less those where it fires give the others, so no (wallet, detector) grid is made.
    """
    every = rates.agg(F.count("*").alias("n"), F.sum("rate").alias("total"))
    on = fired.join(rates, "wallet").groupBy("detector").agg(F.count("*").alias("n_fired"), F.sum("rate").alias("sum_fired"))
    rows = on.join(F.broadcast(every)).withColumn("n_other", F.col("n") - F.col("n_fired"))
    return rows.select("detector", "n_fired", "n_other", (F.col("sum_fired") / F.col("n_fired")).alias("rate_fired"), ((F.col("total") - F.col("sum_fired")) / F.nullif("n_other", F.lit(0))).alias("rate_other"), ((F.col("n_fired") >= least) & (F.col("n_other") >= least)).alias("reliable"))


def shadow_distribution(scores: DataFrame) -> DataFrame:
    """One row: ``n, p50, p90, p95, p99, over_500`` of a score ``s`` by nearest rank at floor(n p)."""
    rows = counted_ranks(scores, "s")
    reach = F.col("below") + F.col("n")
    asked = [F.min(F.when(reach > F.floor(F.col("total") * q), F.col("s"))).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)]
    return rows.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), *asked, F.coalesce(F.sum(F.when(F.col("s") > 500, F.col("n")).otherwise(0)), F.lit(0)).alias("over_500"))


def shadow_overlap(shadow: DataFrame, published: DataFrame) -> DataFrame:
    """``tier, n, published, only_shadow``: shadow subjects (``wallet, tier``) of each tier, and how many of them are published."""
    marked = shadow.join(published.select("wallet", F.lit(True).alias("out")).distinct(), "wallet", "left")
    return marked.groupBy("tier").agg(F.count("*").alias("n"), F.count("out").alias("published"), F.count_if(F.col("out").isNull()).alias("only_shadow"))


def distinct_sketch(rows: DataFrame, column: str, by: list[str], precision: int = 12) -> DataFrame:
    """Mergeable sketches of distinct values, one for each group."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def merged_estimate(sketches: DataFrame) -> DataFrame:
    """One row ``n``: distinct values over all sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def profile(rows: DataFrame) -> DataFrame:
    """``column, present, missing``: how many rows have each column."""
    facts = rows.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in rows.columns))
    return facts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("present"), (F.col("_n") - F.col(c)).alias("missing")) for c in rows.columns))))
