"""All that is known of a market in one row: series detectors from one ordering of its points, order flow, holders and book.

Wallet checks that an anonymous venue hasn't give their slots to what its order book and its bars show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import clip, logit
from tapewatch.operators import market, surveillance

#: Points that a series needs, share of the window that is taken as calm, levels beyond which it is an artefact.
LEAST, CALM, EDGES, ARTEFACT = 8, 0.6, (0.03, 0.97), 0.2


def spike(move: Column, k: Column, value: Column, points: Column) -> Column:
    """The value at the largest move from one point to the next, the first of equal ones; the last point's where nothing moved on.

    Takes rows of :func:`market.in_order`; use inside an aggregation by market.
    """
    jump = F.max(F.when(move.isNotNull(), F.struct(F.abs(move).alias("size"), (-k).alias("first"), value.alias("value"))))
    return F.coalesce(jump["value"], F.max_by(value, k))


def spike_time(series: DataFrame, key: str = "market") -> DataFrame:
    """``market, moved_at``: when each market's log odds made their largest jump."""
    rows = market.in_order(market._inside(series), key, logit(F.col("p")))
    return rows.groupBy(key).agg(spike(F.col("z") - F.col("before"), F.col("k"), F.col("t"), F.col("points")).alias("moved_at"))


def _series_facts(series: DataFrame, key: str) -> DataFrame:
    """One ordering and one aggregation for run-up, spike, calm level, impact and the halves of the volume."""
    rows = market.in_order(market._inside(series), key, logit(F.col("p")))
    move, k, points = F.col("z") - F.col("before"), F.col("k"), F.col("points")
    split = F.greatest(F.lit(3), F.floor((points - 1) * CALM).cast("int"))
    early, late = k.between(2, split + 1), k > split + 1
    half = F.floor(points / 2)
    ill = F.when((F.col("volume") > 0) & (move != 0), F.abs(move) / F.col("volume"))
    calm = F.greatest(F.lit(3), F.floor(points * CALM))
    return rows.groupBy(key).agg(
        F.max("points").alias("points"), spike(move, k, F.col("t"), points).alias("moved_at"), F.max_by("t", k).alias("last_at"), F.median(F.when(k <= calm, F.col("p"))).alias("calm"),
        F.avg(F.when(early, move)).alias("mu"), F.stddev_pop(F.when(early, move)).alias("sigma"), F.sum(F.when(late, move)).alias("moved"), F.count_if(late).alias("late"),
        F.sum(F.when(k > half, F.col("volume"))).alias("pre"), F.sum(F.when(k <= half, F.col("volume"))).alias("base"),
        F.regr_slope(move, F.signum(move) * F.col("volume")).alias("slope"), F.median(ill).alias("mid"), F.median(F.when(points - k + 1 <= 3, ill)).alias("recent"),
    )


def _holder_facts(holders: DataFrame, first_seen: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """``hhi, top1, largest, wallets, fresh`` of a market's holders; fresh if one of the three largest was first seen in the fortnight before the move."""
    top = Window.partitionBy(key).orderBy(F.desc("balance"), "wallet")
    sums = holders.groupBy(key).agg(F.sum("balance").alias("all"), F.sum(F.col("balance") * F.col("balance")).alias("squares"), F.max("balance").alias("largest"), F.count("*").alias("wallets"))
    three = holders.withColumn("_r", F.row_number().over(top)).where("_r <= 3").join(first_seen, "wallet", "left").join(moves, key)
    since = F.col("moved_at") / 1_000_000 - F.col("first_seen")
    fresh = three.groupBy(key).agg(F.bool_or(F.coalesce((since <= 14 * 86_400) & (since >= -86_400), F.lit(False))).alias("fresh"))
    return sums.join(fresh, key, "left").select(key, (F.col("squares") / (F.col("all") * F.col("all"))).alias("hhi"), (F.col("largest") / F.col("all")).alias("top1"), "largest", "wallets", F.coalesce("fresh", F.lit(False)).alias("fresh"))


def enriched(markets: DataFrame, series: DataFrame, volumes: DataFrame, holders: DataFrame, first_seen: DataFrame, book: DataFrame, key: str = "market") -> DataFrame:
    """One row for each of ``markets`` (``market, anonymous, resolved, won, prob, quality, category``).

    ``series``: ``market, t, id, p, volume``; a resolved market's is trimmed of its settlement first. ``volumes``: buys and sells by wallet;
    ``holders``: balances; ``first_seen`` of wallets in seconds; ``book``: one row a market.
    note says why a market has no series scores. implied is the calm level before the event where it is resolved, else the
    price; where that is nearly certain, or nothing but the settlement is left, quality is an artefact's. Concentration is the
    holders', or the book's imbalance on an anonymous venue; accumulation the largest buyer's, or the bars' rising volume.
    """
    open_ = series.join(markets.where("not resolved").select(key), key, "left_semi")
    done = market.trim_settlement(series.join(markets.where("resolved").select(key), key, "left_semi"), key)
    whole = series.groupBy(key).agg(F.count("*").alias("given"), F.max("t").alias("ended_at"))
    facts = _series_facts(open_.unionByName(done), key)
    moves = facts.select(key, "moved_at")
    held = _holder_facts(holders, first_seen, moves, key)
    buyer = volumes.where("buy_usd > 0").groupBy(key).agg(F.max("buy_usd").alias("bought"))
    rows = markets.join(whole, key, "left").join(facts, key, "left").join(held, key, "left").join(buyer, key, "left").join(book.select(key, "imbalance", "depth"), key, "left")
    thin, empty = F.coalesce(F.col("given") < LEAST, F.lit(True)), F.coalesce(F.col("points") < LEAST, F.lit(True))
    scored = ~thin & ~empty
    implied = F.when(F.col("resolved") & scored, F.round("calm", 4)).otherwise(F.col("prob"))
    artefact = (~thin & empty) | (F.col("resolved") & scored & ((F.col("calm") < EDGES[0]) | (F.col("calm") > EDGES[1])))
    car = (F.col("moved") - F.col("late") * F.col("mu")) / F.col("sigma") / F.sqrt("late")
    run_up = F.when(scored & (F.col("sigma") > 0) & (F.col("late") >= 1), clip(F.abs(car) / 4, 0, 1))
    ratio = F.when(F.col("mid") > 0, F.coalesce("recent", F.lit(0.0)) / F.col("mid")).otherwise(0.0)
    impact = F.when(scored, clip(F.log2(F.greatest(F.lit(1.0), ratio)) / F.log2(F.lit(12.0)), 0, 1))
    by_holders = F.when(F.col("wallets") >= 3, clip(0.55 * F.col("hhi") + 0.45 * F.col("top1") + F.when(F.col("fresh"), 0.12).otherwise(0.0), 0, 1))
    by_book = F.when(F.col("depth") > 0, clip(F.abs("imbalance"), 0, 1))
    rising = F.when(F.col("points") >= 6, clip(F.log2(F.greatest(F.lit(1.0), F.col("pre") / F.when(F.col("base") > 0, F.col("base")).otherwise(1.0))) / F.log2(F.lit(10.0)), 0, 1))
    gathered = F.when(F.col("bought").isNotNull(), surveillance.accumulation(F.col("bought"), F.lit(None).cast("double"), F.col("won")))
    long = F.when(~F.col("anonymous") & F.col("largest").isNotNull(), surveillance.longshot(F.col("largest"), implied, F.col("won"), F.col("category")))
    slot = lambda anonymous, named: F.when(scored, F.when(F.col("anonymous"), anonymous).otherwise(named))
    return rows.select(
        key, F.when(thin, "insufficient price history").when(empty, "no pre-event window").alias("note"), F.when(scored, F.col("moved_at")).when(~thin, F.col("ended_at")).alias("moved_at"),
        implied.alias("implied"), F.when(artefact, F.least(F.coalesce("quality", F.lit(1.0)), F.lit(ARTEFACT))).otherwise(F.col("quality")).alias("quality"), run_up.alias("run_up"), impact.alias("impact"),
        slot(by_book, by_holders).alias("concentration"), slot(rising, gathered).alias("accumulation"), F.when(scored, long).alias("longshot"),
    )


def report(asked: DataFrame, markets: DataFrame, series: DataFrame, volumes: DataFrame, holders: DataFrame, first_seen: DataFrame, book: DataFrame, key: str = "market") -> DataFrame:
    """The rows of ``enriched`` for the markets ``asked`` (``market``) alone: each input is cut to them before anything is put in order."""
    cut = lambda df: df.join(F.broadcast(asked.select(key).distinct()), key, "left_semi")
    return enriched(cut(markets), cut(series), cut(volumes), cut(holders), first_seen, cut(book), key)
