"""The watchlist of bets in open markets: seven signals, a versioned score, what becomes of a row, and the board.

A bet is one (market, wallet). Its signals are stored with it, so the score can be taken again under other
rules without looking at trades, news or filings again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions import text
from tapewatch.sources.shared import staged

HOUR, DAY = 3600, 86_400
STORED = ("cond", "wallet", "outcome", "price", "usd", "ts", "size_z", "whale_x", "vol_share", "peers", "flagged", "fresh", "blackout", "anticipated", "public_info")


@dataclass(frozen=True)
class Rules:
    """Points, bars and floors of the score. Another set has another ``version``."""

    version: int = 3
    outsized: int = 20
    blackout: int = 35
    repeat: int = 30
    fresh: int = 15
    anticipated: int = 12
    public_info: int = -20
    best: int = 35
    worst: int = -25
    neutral: float = 0.85
    list_at: int = 25
    promote_at: int = 65
    cap_price: float = 0.95
    cap_score: int = 15
    big_usd: float = 25_000
    least_usd: float = 5_000
    bet_usd: float = 1_000
    share: float = 0.08
    least_peers: int = 6
    least_z: float = 3
    least_whale: float = 10
    fresh_days: int = 14
    keep_resolved: int = 7 * DAY
    keep: int = 30 * DAY


RULES = Rules()


def conviction(price: Column, usd: Column, rules: Rules = RULES) -> tuple[Column, Column]:
    """Points and tier of an entry price: a cheap long shot says most, a near certain entry speaks against."""
    q = F.least(price, F.lit(1.0))
    low = F.floor(rules.best * (rules.neutral - q) / rules.neutral + 0.5)
    high = F.floor(rules.worst * (q - rules.neutral) / (1 - rules.neutral) + 0.5)
    tier = F.when(q <= 0.15, "deepLongshot").when(q <= 0.35, "longshot").when(q <= 0.60, "underdog").when(q < rules.neutral, "slightEdge").when(q >= 0.92, "nearCertain").otherwise("nearConsensus")
    counts = (usd >= rules.bet_usd) & (price > 0)
    return F.when(counts, F.when(q < rules.neutral, low).otherwise(high)).otherwise(0).cast("int"), F.when(counts, tier)


def outsized(rules: Rules = RULES) -> Column:
    """A large bet: by its dollars, by its share of a day's volume (a per cent figure in ``vol_share``), or among its peers."""
    floor = F.col("usd") >= rules.least_usd
    among = (F.col("peers") >= rules.least_peers) & ((F.col("size_z") >= rules.least_z) | (F.col("whale_x") >= rules.least_whale))
    return F.coalesce((F.col("usd") >= rules.big_usd) | (floor & (F.col("vol_share") / 100 >= rules.share)) | (floor & among), F.lit(False))


def rescored(rows: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``rows`` with ``score``, ``signals`` (what fired) and ``version`` from the stored figures; a signal that is null didn't fire."""
    points, tier = conviction(F.col("price"), F.col("usd"), rules)
    on = lambda c: F.coalesce(c, F.lit(False))
    parts = (("outsized", outsized(rules), rules.outsized), ("repeat", on(F.col("flagged")), rules.repeat), ("fresh", on(F.col("fresh")), rules.fresh), ("blackout", on(F.col("blackout")), rules.blackout), ("anticipated", on(F.col("anticipated")), rules.anticipated), ("publicInfo", on(F.col("public_info")), rules.public_info))
    total = points
    for _, fires, worth in parts:
        total = total + F.when(fires, worth).otherwise(0)
    total = F.greatest(total, F.lit(0))
    capped = F.when(F.least(F.col("price"), F.lit(1.0)) >= rules.cap_price, F.least(total, F.lit(rules.cap_score))).otherwise(total)
    first, *rest = [F.when(fires, F.lit(name)) for name, fires, _ in parts]
    fired = F.concat_ws(",", first, tier, *rest)
    return rows.withColumns({"score": capped.cast("int"), "signals": fired, "version": F.lit(rules.version)})


def counted_sizes(trades: DataFrame) -> DataFrame:
    """``cond, usd, k, below, n, total, squares``: how many trades of a market have a size, and how many a smaller one.

    Sizes are put in order inside bands of equal sixteenths of a power of e, and bands by their counts, so a busy market
    isn't ordered in one task.
    """
    sizes = trades.where("usd > 0").groupBy("cond", "usd").agg(F.count("*").alias("k")).withColumn("_band", F.floor(F.log("usd") * 16))
    each = F.col("k") * F.col("usd")
    bands = sizes.groupBy("cond", "_band").agg(F.sum("k").alias("_k"), F.sum(each).alias("_t"), F.sum(each * F.col("usd")).alias("_s"))
    every, ahead = Window.partitionBy("cond"), Window.partitionBy("cond").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("cond", "_band", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_k").over(every).alias("n"), F.sum("_t").over(every).alias("total"), F.sum("_s").over(every).alias("squares"))
    inside = Window.partitionBy("cond", "_band").orderBy("usd").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_in", F.coalesce(F.sum("k").over(inside), F.lit(0))).join(bands, ["cond", "_band"])
    return rows.select("cond", "usd", "k", (F.col("_ahead") + F.col("_in")).alias("below"), "n", "total", "squares")


def peers(trades: DataFrame, at: float = 0.9, block: int = 1024, held: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """``cond, usd, peers, mean, sd, p90`` of each size of a market's trades: figures of its trades of any other size.

    sd is the sample's; p90 is the element at floor(.9(n-1)). That element is found by its number: sizes cover ranges of
    numbers, and a range is dealt to the blocks of numbers that it touches. The elements are a few rows a market; where
    ``held`` writes them, their size is known before sizes are moved to them.
    """
    sizes = staged(counted_sizes(trades), free=True)
    n = F.col("n") - F.col("k")
    total, squares = F.col("total") - F.col("k") * F.col("usd"), F.col("squares") - F.col("k") * F.col("usd") * F.col("usd")
    mean = F.when(n > 0, total / n)
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - n * mean * mean) / (n - 1))))
    number = F.floor(at * (n - 1)).cast("long")
    # without this size, what stands after it moves up by its count
    asked = sizes.select("cond", "usd", n.alias("peers"), mean.alias("mean"), sd.alias("sd"), (number + F.when(number < F.col("below"), 0).otherwise(F.col("k"))).alias("_number"))
    # a market asks for a few numbers, however many sizes it has: each number is looked for once
    numbers = asked.where("peers > 0").select("cond", "_number").distinct().withColumn("_block", F.floor(F.col("_number") / block))
    ranges = sizes.select(F.col("cond").alias("_cond"), F.col("usd").alias("p90"), "below", (F.col("below") + F.col("k")).alias("_end"))
    ranges = ranges.withColumn("_at", F.explode(F.sequence(F.floor(F.col("below") / block), F.floor((F.col("_end") - 1) / block))))
    hit = (F.col("cond") == F.col("_cond")) & (F.col("_block") == F.col("_at")) & (F.col("_number") >= F.col("below")) & (F.col("_number") < F.col("_end"))
    found = held(numbers.join(ranges, hit).select("cond", "_number", "p90"))
    return asked.join(found, ["cond", "_number"], "left").select("cond", "usd", "peers", "mean", "sd", "p90")


def day_volume(trades: DataFrame) -> DataFrame:
    """``cond, hour, volume``: dollars of a market in each hour that it traded and the 23 hours before. Only hours are put in order."""
    hours = trades.groupBy("cond", F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.sum("usd").alias("_usd"))
    return hours.select("cond", "hour", F.sum("_usd").over(Window.partitionBy("cond").orderBy("hour").rangeBetween(-23, 0)).alias("volume"))


def around(asked: DataFrame, found: DataFrame, key: str, block: int = 30 * DAY) -> DataFrame:
    """``asked`` (``key, ts`` and more) with ``before``, the last time in ``found`` at or before ts, and ``after``, the first one later.

    A key's time is cut into blocks; rows are put in order inside a block, and each block gets the last time before it and
    the first one after it, so neither a busy key nor its pairs come together.
    """
    cut = lambda c: F.floor(c / block)
    times = found.select(F.col(key).alias("_key"), F.col("ts").alias("_ts")).distinct()
    rows = asked.select(F.col(key).alias("_key"), F.col("ts").alias("_ts"), F.struct(*asked.columns).alias("_row"))
    both = rows.withColumn("_seen", F.lit(None).cast("long")).unionByName(times.withColumns({"_row": F.lit(None).cast(rows.schema["_row"].dataType), "_seen": F.col("_ts").cast("long")})).withColumn("_block", cut(F.col("_ts")))
    edges = both.groupBy("_key", "_block").agg(F.min("_seen").alias("_min"), F.max("_seen").alias("_max"))
    w = Window.partitionBy("_key").orderBy("_block")
    v = Window.partitionBy("_key").orderBy(F.desc("_block"))
    edges = edges.select("_key", "_block", F.max("_max").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"), F.min("_min").over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    inside = Window.partitionBy("_key", "_block").orderBy("_ts")
    # rangeBetween: a time equal to the asked one counts as before. What comes later is summed up backwards, since Spark goes
    # through all that follows again for each row of a frame without an end
    back = Window.partitionBy("_key", "_block").orderBy(F.desc("_ts"))
    own = both.withColumns({"_last": F.max("_seen").over(inside.rangeBetween(Window.unboundedPreceding, 0)), "_first": F.min("_seen").over(back.rangeBetween(Window.unboundedPreceding, -1))})
    joined = own.where("_row is not null").join(edges.withColumnsRenamed({"_key": "_k", "_block": "_b"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
    return joined.select("_row.*", F.coalesce("_last", "_carried").alias("before"), F.coalesce("_first", "_next").alias("after"))


def moments(bets: DataFrame, trades: DataFrame, catalog: DataFrame, news: DataFrame, filings: DataFrame) -> DataFrame:
    """``cond, ts, volume, blackout, anticipated, public_info``: what bets of a market at one time have in common.

    Times are far fewer than bets where there are many, so what is looked up by time is looked up once a time, and bets are moved once for all of it.
    """
    named = catalog.select("cond", F.get(text.entities(F.col("question")), F.lit(0)).alias("entity"))
    times = bets.select("cond", "ts", F.floor(F.col("ts") / HOUR).alias("hour")).distinct().join(day_volume(trades), ["cond", "hour"])
    times = staged(times.join(named, "cond", "left").select("cond", "ts", "volume", "entity"), free=True)
    asked = staged(times.where("entity is not null").select("entity", "ts").distinct())
    told = staged(around(asked, news, "entity").withColumnsRenamed({"before": "_news", "after": "_more"}))
    ts = F.col("ts")
    public = F.coalesce(F.col("_news") >= ts - DAY, F.lit(False)) | F.coalesce(F.col("before") >= ts - 30 * DAY, F.lit(False))
    known = around(told, filings, "entity").select("entity", "ts", public.alias("_public"), F.coalesce(F.col("after") <= ts + 120 * DAY, F.lit(False)).alias("_later"))
    on = lambda c: F.coalesce(c, F.lit(False))
    return times.join(known, ["entity", "ts"], "left").select("cond", "ts", "volume", on(~F.col("_public")).alias("blackout"), on(~F.col("_public") & F.col("_later")).alias("anticipated"), on(F.col("_public")).alias("public_info"))


def candidates(trades: DataFrame, catalog: DataFrame, flagged: DataFrame, news: DataFrame, filings: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Bets with the columns ``STORED``: buys of ``bet_usd`` or more, each market and wallet's first by time.

    ``news`` and ``filings`` are ``entity, ts``; a market's entity is the first one named in its question. Public
    information is news of the day before the bet or a filing of the 30 days before it; none is a blackout; a filing
    of the 120 days after it was anticipated. Markets that name nothing have none of the three.
    """
    buys = trades.where("side <> 'SELL' and usd > 0")
    bets = buys.where(F.col("usd") >= rules.bet_usd)
    first = bets.groupBy("cond", "wallet").agg(F.min(F.struct("ts", "tx", "outcome", "price", "usd")).alias("b")).select("cond", "wallet", "b.ts", "b.outcome", "b.price", "b.usd")
    owners = trades.groupBy("wallet").agg(F.min("ts").alias("_since")).join(flagged.select("wallet", F.lit(True).alias("_flagged")).distinct(), "wallet", "left")
    rows = first.join(moments(bets, trades, catalog, news, filings), ["cond", "ts"]).withColumn("vol_share", F.round(100 * F.col("usd") / F.col("volume"), 2)).drop("volume")
    size_z = F.round(F.when(F.col("sd") > 0, (F.col("usd") - F.col("mean")) / F.col("sd")).otherwise(0.0), 1) + 0.0
    whale_x = F.round(F.when(F.col("p90") > 0, F.col("usd") / F.col("p90")).otherwise(0.0), 1)
    rows = rows.join(peers(buys, held=lambda found: staged(found, free=True)).select("cond", "usd", "peers", "mean", "sd", "p90"), ["cond", "usd"]).withColumns({"size_z": size_z, "whale_x": whale_x}).drop("mean", "sd", "p90").join(owners, "wallet")
    return rows.withColumns({"flagged": F.coalesce("_flagged", F.lit(False)), "fresh": F.col("ts") - F.col("_since") <= rules.fresh_days * DAY}).select(*STORED)


def listed(rows: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Candidates that reach the bar, as rows of the list."""
    return rescored(rows, rules).where(F.col("score") >= rules.list_at).withColumns({"status": F.lit("watching"), "won": F.lit(None).cast("boolean"), "resolved_ts": F.lit(None).cast("long")})


def reconciled(rows: DataFrame, catalog: DataFrame, flagged: DataFrame, now: int, rules: Rules = RULES) -> DataFrame:
    """Every row of the list at ``now``, scored under ``rules``, with ``gone``: why it leaves (purge, prune, retire), null if it stays.

    In this order: a watched row whose market is out of scope goes; flags of watched rows are taken anew and all rows
    are scored; a promoted row under the bar for it is cleared; a watched row whose market has resolved is promoted if it won, its
    wallet is flagged and its score is strong, else cleared; rows under the bar of the list go, but for promoted
    ones; rows go a week after they were resolved, or thirty days after the bet.
    """
    # a question is looked through once a market, not once a row; a market that isn't in the catalogue is of no kind
    kind = text.category(F.array().cast("array<string>"), F.coalesce("question", F.lit("")))
    known = catalog.select("cond", kind.alias("_kind"), F.when(F.col("resolved_ts") <= now, F.col("winner")).alias("_winner"))
    joined = rows.join(known, "cond", "left").join(flagged.select("wallet", F.lit(True).alias("_flag")).distinct(), "wallet", "left")
    watching = F.col("status") == "watching"
    purge = watching & F.col("_kind").isNull()
    joined = joined.withColumns({"_purge": purge, "flagged": F.when(watching, F.coalesce("_flag", F.lit(False))).otherwise(F.col("flagged"))})
    scored = rescored(joined, rules)
    strong, ends = F.col("score") >= rules.promote_at, watching & F.col("_winner").isNotNull()
    won = F.upper("_winner") == F.upper("outcome")
    status = F.when(ends, F.when(won & F.col("flagged") & strong, "promoted").otherwise("cleared")).when((F.col("status") == "promoted") & ~strong, "cleared").otherwise(F.col("status"))
    scored = scored.withColumns({"won": F.when(ends, won).otherwise(F.col("won")), "resolved_ts": F.when(ends, F.lit(now)).otherwise(F.col("resolved_ts")), "status": status})
    old = F.coalesce(now - F.col("resolved_ts") > rules.keep_resolved, F.lit(False)) | (now - F.col("ts") > rules.keep)
    gone = F.when(F.col("_purge"), "purge").when((F.col("status") != "promoted") & (F.col("score") < rules.list_at), "prune").when(old, "retire")
    return scored.withColumn("gone", gone).drop("_winner", "_flag", "_purge", "_kind")


def board(rows: DataFrame, most: int = 150) -> DataFrame:
    """The first ``most`` rows by place: promoted, watching, cleared; newest first, ties by market and wallet."""
    rank = F.when(F.col("status") == "promoted", 1).when(F.col("status") == "watching", 2).otherwise(3)
    top = rows.withColumn("_rank", rank).orderBy("_rank", F.desc("ts"), "cond", "wallet").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_rank", F.desc("ts"), "cond", "wallet"))).drop("_rank")
