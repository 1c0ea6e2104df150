"""Time-series detectors of a market: run-up, VPIN, price impact, concentration, wash, ramp, synchronised entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import clip, logit, normal_cdf


DAY = 86_400_000_000  # microseconds of a block of a market's series


def in_order(series: DataFrame, market: str, z: Column, volume: Column | None = None, block: int = DAY) -> DataFrame:
    """``series`` with ``z``, its place ``k`` in its market (by t, id), ``points`` of the market, ``before`` (the z ahead of it) and, with
    ``volume``, ``run`` (volume up to and with it) and ``total``.

    A market is cut into blocks of time: rows are put in order inside a block only, and each block gets what came before
    it, so a busy market is spread over its blocks.
    """
    rows = series.withColumns({"z": z, "_v": F.lit(0.0) if volume is None else volume, "_b": F.floor(F.col("t") / block)})
    parts = rows.groupBy(market, "_b").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.max_by("z", F.struct("t", "id")).alias("_z"))
    w = Window.partitionBy(market).orderBy("_b")
    every = Window.partitionBy(market)
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        market, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_k0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_s0"), F.lag("_z").over(w).alias("_z0"),
        F.sum("_n").over(every).alias("points"), F.sum("_s").over(every).alias("total"),
    )
    inside = Window.partitionBy(market, "_b").orderBy("t", "id")
    rows = rows.withColumns({"_k": F.row_number().over(inside), "_l": F.lag("z").over(inside), "_r": F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    out = rows.join(parts, [market, "_b"]).withColumns({"k": F.col("_k0") + F.col("_k"), "before": F.when(F.col("_k") == 1, F.col("_z0")).otherwise(F.col("_l")), "run": F.col("_s0") + F.col("_r")})
    return out.drop("_v", "_b", "_k0", "_s0", "_z0", "_k", "_l", "_r")


def _inside(series: DataFrame) -> DataFrame:
    return series.where((F.col("p") > 0) & (F.col("p") < 1) & F.col("t").isNotNull())


def run_up(series: DataFrame, market: str = "market", share: float = 0.6, scale: float = 4.0) -> DataFrame:
    """``n, car, car_star, score, pre_move``: cumulative abnormal logit return of the last 40 % against the first 60 %."""
    rows = in_order(_inside(series), market, logit(F.col("p"))).withColumn("r", F.col("z") - F.col("before"))
    split = F.greatest(F.lit(3), F.floor((F.col("points") - 1) * share).cast("int"))
    early, late = F.col("k").between(2, split + 1), F.col("k") > split + 1
    found = rows.where(F.col("points") >= 8).groupBy(market).agg(
        F.avg(F.when(early, F.col("r"))).alias("mu"), F.stddev_pop(F.when(early, F.col("r"))).alias("sigma"), F.sum(F.when(late, F.col("r"))).alias("moved"),
        F.count_if(late).alias("n"), F.max(F.when(F.col("k") == 1, F.col("z"))).alias("z0"), F.max(F.when(F.col("k") == F.col("points"), F.col("z"))).alias("z1"),
        F.max(F.when(F.col("k") == split + 1, F.col("z"))).alias("zs"),
    )
    car = (F.col("moved") - F.col("n") * F.col("mu")) / F.col("sigma")
    whole = F.abs(F.col("z1") - F.col("z0"))
    out = found.where((F.col("n") >= 1) & (F.col("sigma") > 0)).withColumn("car", car).withColumn("car_star", F.col("car") / F.sqrt("n"))
    pre = F.when(whole > 0, clip(F.abs(F.col("z1") - F.col("zs")) / whole, 0, 1)).otherwise(0.0)
    return out.select(market, "n", "car", "car_star", clip(F.abs("car_star") / scale, 0, 1).alias("score"), pre.alias("pre_move"))


def vpin(trades: DataFrame, market: str = "market", buckets: int = 50, last: int = 50) -> DataFrame:
    """``trades, buckets, vpin``: mean imbalance of equal-volume buckets, trades split across their edges.

    A trade's buy share is the normal cdf of its logit change over that change's deviation. Each trade
    meets only the buckets that it overlaps, found from the running volume.
    """
    rows = in_order(_inside(trades).where(F.col("volume") > 0), market, logit(F.col("p")), F.col("volume"))
    rows = rows.withColumns({"dz": F.coalesce(F.col("z") - F.col("before"), F.lit(0.0)), "n": F.col("points")})
    spread = rows.groupBy(market).agg(F.stddev_pop(F.when(F.col("k") > 1, F.col("dz"))).alias("sd"))
    rows = rows.join(spread, market)
    rows = rows.where((F.col("n") >= 12) & (F.col("sd") > 0)).withColumn("size", F.col("total") / buckets).withColumn("from", F.col("run") - F.col("volume"))
    first, end = F.floor(F.col("from") / F.col("size") + 1e-9), F.ceil(F.col("run") / F.col("size") - 1e-9) - 1
    cut = rows.withColumn("share", normal_cdf(F.col("dz") / F.col("sd"))).withColumn("bucket", F.explode(F.sequence(F.least(first, F.lit(buckets - 1)), F.greatest(F.least(first, F.lit(buckets - 1)), F.least(end, F.lit(buckets - 1))))))
    part = F.greatest(F.lit(0.0), F.least(F.col("run"), (F.col("bucket") + 1) * F.col("size")) - F.greatest(F.col("from"), F.col("bucket") * F.col("size")))
    filled = cut.groupBy(market, "bucket").agg(F.abs(F.sum(part * (1 - 2 * F.col("share")))).alias("imbalance"), F.sum(part).alias("volume"), F.first("size").alias("size"), F.first("n").alias("n"))
    full = filled.where(F.col("volume") >= F.col("size") * (1 - 1e-9) - 1e-9)
    kept = full.withColumn("r", F.row_number().over(Window.partitionBy(market).orderBy(F.desc("bucket")))).where(F.col("r") <= last)
    return kept.groupBy(market).agg(F.first("n").alias("trades"), F.count("*").alias("buckets"), F.avg(F.col("imbalance") / F.col("size")).alias("vpin")).where(F.col("buckets") >= 3)


def price_impact(bars: DataFrame, market: str = "market") -> DataFrame:
    """``bars, slope, ratio, score``: slope of logit returns on signed flow, and the last bars' illiquidity over the median."""
    rows = in_order(_inside(bars).where(F.col("volume") >= 0), market, logit(F.col("p")))
    rows = rows.withColumns({"dp": F.col("z") - F.col("before"), "back": F.col("points") - F.col("k") + 1}).where(F.col("dp").isNotNull())
    rows = rows.withColumns({"flow": F.signum("dp") * F.col("volume"), "ill": F.when((F.col("volume") > 0) & (F.col("dp") != 0), F.abs("dp") / F.col("volume"))})
    found = rows.groupBy(market).agg(F.count("*").alias("bars"), F.regr_slope("dp", "flow").alias("slope"), F.median("ill").alias("mid"), F.median(F.when(F.col("back") <= 3, F.col("ill"))).alias("recent"))
    ratio = F.when(F.col("mid") > 0, F.coalesce("recent", F.lit(0.0)) / F.col("mid")).otherwise(0.0)
    out = found.where(F.col("bars") >= 5).withColumn("ratio", ratio)
    return out.select(market, "bars", "slope", "ratio", clip(F.log2(F.greatest(F.lit(1.0), "ratio")) / F.log2(F.lit(12.0)), 0, 1).alias("score"))


def wallet_volumes(trades: DataFrame) -> DataFrame:
    """``cond, wallet, buy_usd, sell_usd, first_ts, last_ts, n`` per wallet and market."""
    buy = F.col("side") != "SELL"
    return trades.groupBy("cond", "wallet").agg(
        F.coalesce(F.sum(F.when(buy, F.col("usd"))), F.lit(0.0)).alias("buy_usd"), F.coalesce(F.sum(F.when(~buy, F.col("usd"))), F.lit(0.0)).alias("sell_usd"),
        F.min(F.when(buy, F.col("ts"))).alias("first_ts"), F.max(F.when(buy, F.col("ts"))).alias("last_ts"), F.count_if(buy).alias("n"),
    )


def concentration(volumes: DataFrame) -> DataFrame:
    """``cond, wallets, hhi, top, score``: concentration of buying among wallets. Shares come from one join with market totals."""
    total = volumes.groupBy("cond").agg(F.sum("buy_usd").alias("total"), F.sum(F.col("buy_usd") * F.col("buy_usd")).alias("squares"), F.max("buy_usd").alias("largest"), F.count_if(F.col("buy_usd") > 0).alias("wallets"))
    hhi, top = F.col("squares") / (F.col("total") * F.col("total")), F.col("largest") / F.col("total")
    return total.where("total > 0").select("cond", "wallets", hhi.alias("hhi"), top.alias("top"), clip(0.55 * hhi + 0.45 * top, 0, 1).alias("score"))


def wash(volumes: DataFrame) -> DataFrame:
    """``cond, self_share, score``: twice the lesser of a wallet's buys and sells over all volume."""
    found = volumes.groupBy("cond").agg(F.sum(F.least("buy_usd", "sell_usd")).alias("own"), F.sum(F.col("buy_usd") + F.col("sell_usd")).alias("total"))
    share = 2 * F.col("own") / F.col("total")
    return found.where("total > 0").select("cond", share.alias("self_share"), clip(0.7 * share, 0, 1).alias("score"))


def ramp(bars: DataFrame, market: str = "market") -> DataFrame:
    """``close_share, move, times, score``: volume and price move of the last fifth of the bars against the rest."""
    rows = in_order(bars, market, logit(F.col("p"), 0.02, 0.98)).withColumn("n", F.col("points")).where("n >= 6")
    cut, z = F.floor(F.col("n") * 0.8), F.col("z")
    found = rows.groupBy(market).agg(F.sum("volume").alias("total"), F.sum(F.when(F.col("k") > cut, F.col("volume")).otherwise(0.0)).alias("close"), F.max("n").alias("n"), F.max(F.when(F.col("k") == cut + 1, z)).alias("z0"), F.max(F.when(F.col("k") == F.col("n"), z)).alias("z1"))
    close_mean, base_mean = F.col("close") / (F.col("n") - cut), (F.col("total") - F.col("close")) / cut
    out = found.where("total > 0").withColumns({"close_share": F.col("close") / F.col("total"), "move": F.abs(F.col("z1") - F.col("z0")), "times": F.when(base_mean > 0, close_mean / base_mean).otherwise(1.0)})
    score = 0.5 * clip(F.col("close_share") / 0.5, 0, 1) + 0.3 * clip(F.col("move"), 0, 1) + 0.2 * clip(F.log2(F.greatest(F.lit(1.0), "times")) / 3, 0, 1)
    return out.select(market, "close_share", "move", "times", score.alias("score"))


def synchronised_entry(volumes: DataFrame, window: int = 900, least_share: float = 0.03, least: int = 3) -> DataFrame:
    """``cond, size, share, anchor``: the largest share of wallets whose first buys lie within ``window`` seconds of one of them.

    Time is cut into blocks of ``window``; a wallet stands in its own block and in the one before, where it can only be reached by
    others, so a market is put in order two windows at a time.
    """
    total = volumes.groupBy("cond").agg(F.sum("buy_usd").alias("total"))
    sized = volumes.where(F.col("first_ts").isNotNull()).join(total, "cond").withColumn("part", F.col("buy_usd") / F.col("total")).where(F.col("part") >= least_share)
    block = F.floor(F.col("first_ts") / window)
    both = sized.select("cond", "first_ts", "part", F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block - 1).alias("b"), F.lit(False).alias("own")))).alias("x"))
    w = Window.partitionBy("cond", "x.b").orderBy("first_ts").rangeBetween(0, window)
    found = both.select("cond", "first_ts", "x.own", F.count("*").over(w).alias("size"), F.sum("part").over(w).alias("share")).where(F.col("own") & (F.col("size") >= least))
    best = found.groupBy("cond").agg(F.max(F.struct(F.round("share", 9).alias("share"), (-F.col("first_ts")).alias("at"), "size")).alias("b"))
    return best.select("cond", F.col("b.size").alias("size"), F.col("b.share").alias("share"), (-F.col("b.at")).alias("anchor"))


def bars(trades: DataFrame, seconds: int = 300, market: str = "cond") -> DataFrame:
    """``start, p, volume, n``: last price, money and trades of each interval."""
    start = F.floor(F.col("ts") / seconds) * seconds
    return trades.groupBy(market, start.alias("start")).agg(F.max_by("price", F.struct("ts", "tx")).alias("p"), F.sum(F.col("size") * F.col("price")).alias("volume"), F.count("*").alias("n"))


def liquidity(volume: Column, spread: Column, depth: Column, count: Column) -> Column:
    """Quality of a market's price, 0 to 1; a null spread counts half, other nulls nothing."""
    v = clip((F.log10(F.greatest(volume, F.lit(1.0))) - 3) / 3, 0, 1)
    s = F.coalesce(clip(1 - spread / 0.1, 0, 1), F.lit(0.5))
    d = clip((F.log10(F.greatest(depth, F.lit(1.0))) - 2) / 3, 0, 1)
    t = clip(F.log10(F.greatest(count, F.lit(1))) / 3, 0, 1)
    return 0.4 * F.coalesce(v, F.lit(0.0)) + 0.3 * s + 0.2 * F.coalesce(d, F.lit(0.0)) + 0.1 * F.coalesce(t, F.lit(0.0))


#: Weights of the two detector sets.
INSIDER = {"runUp": 0.30, "accumulation": 0.25, "concentration": 0.25, "longshot": 0.20}
MANIPULATION = {"wash": 0.30, "ramp": 0.25, "vpin": 0.20, "impact": 0.25}


def fuse(scores: DataFrame, market: str, weights: dict[str, float], quality: Column | None = None, explained: Column | None = None, damping: float = 0.6) -> DataFrame:
    """``score, raw, ran, agreeing, tier`` from a long table ``market, detector, sub``.

    Weights are shared out over the detectors that ran; the score is damped by news (``explained``) and by
    the part of the detectors that ran.
    """
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    known = scores.where(F.col("detector").isin(*weights) & F.col("sub").isNotNull()).withColumn("w", w[F.col("detector")])
    q, e = (F.lit(1.0) if quality is None else quality), (F.lit(0.0) if explained is None else explained)
    found = known.groupBy(market).agg((F.sum(F.col("w") * F.col("sub")) / F.sum("w")).alias("raw"), F.count("*").alias("ran"), F.count_if(F.col("sub") >= 0.45).alias("agreeing"), F.max(q).alias("q"), F.max(e).alias("e"))
    final = clip(F.col("raw") * clip(1 - damping * F.col("e"), 0, 1.5), 0, 1) * F.col("ran") / len(weights)
    out = found.withColumn("score", F.floor(100 * final + 0.5).cast("int"))
    full = F.col("ran") == len(weights)
    tier = F.when(F.col("q") <= 0.25, "Watch").when(full & (F.col("agreeing") >= 2) & (F.col("score") >= 70), "High-signal").when((F.col("score") >= 50) & (F.col("agreeing") >= 1), "Elevated").when(F.col("score") >= 30, "Watch").otherwise("Clear")
    return out.select(market, "score", "raw", "ran", "agreeing", tier.alias("tier"))


def trim_settlement(series: DataFrame, market: str = "market", eps: float = 0.01) -> DataFrame:
    """``series`` without the run of points at its end that lie within ``eps`` of a final 0 or 1. Ends are aggregated and joined back."""
    same = lambda c: F.col(market) == F.col(c)
    ends = series.groupBy(F.col(market).alias("_m")).agg(F.max_by("p", F.struct("t", "id")).alias("_end"))
    rows = series.join(ends, same("_m"))
    last = rows.where(F.abs(F.col("p") - F.round("_end")) > eps).groupBy(F.col(market).alias("_l")).agg(F.max("t").alias("_last"))
    settled = F.col("_end").isin(0.0, 1.0) | (F.least(F.col("_end"), 1 - F.col("_end")) <= eps)
    return rows.join(last, same("_l"), "left").where(~settled | (F.col("t") <= F.col("_last"))).select(*series.columns)


def price_as_of(series: DataFrame, moments: DataFrame, market: str = "market", at: str = "at", block: int = DAY) -> DataFrame:
    """``moments`` with ``price_at``: the last price up to the moment, or the first one where none is earlier.

    Moments and points are one stream in time order, cut into blocks that are each given the last price before them and the
    first one after, so no pair is made and no market is put in order as a whole.
    """
    points = series.select(F.col(market).alias("_m"), F.col("t").alias("_t"), F.lit(0).alias("_k"), F.col("p").alias("_p"))
    asked = moments.select(F.col(market).alias("_m"), F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("double").alias("_p"), F.struct(*moments.columns).alias("_row"))
    both = points.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked).withColumn("_b", F.floor(F.col("_t") / block))
    priced = F.when(F.col("_k") == 0, F.struct("_t"))
    parts = both.groupBy("_m", "_b").agg(F.max_by("_p", priced).alias("_z"), F.min_by("_p", priced).alias("_a"))
    over = Window.partitionBy("_m").orderBy("_b")
    parts = parts.select(F.col("_m").alias("_m2"), F.col("_b").alias("_b2"), F.last("_z", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.first("_a", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    w = Window.partitionBy("_m", "_b").orderBy("_t", "_k")
    own = both.withColumns({"_before": F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("_k = 1")
    met = own.join(parts, F.col("_m").eqNullSafe(F.col("_m2")) & F.col("_b").eqNullSafe(F.col("_b2")))
    return met.select("_row.*", F.coalesce("_before", "_carried", "_after", "_next").alias("price_at"))
