"""Market surveillance beside the time-series detectors: order books, news around a move, screens, labels and engine scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions import text
from tapewatch.functions.stats import clip, logit
from tapewatch.operators.market import INSIDER, MANIPULATION, in_order

#: Win rates at long odds and risk multipliers by category; the last is for all others.
BASELINE = {"political": 0.25, "elections": 0.25, "world": 0.52, "business": 0.20, "economy": 0.18, "finance": 0.18, "culture": 0.30, "health": 0.20, "tech & science": 0.20, "": 0.14}
MULTIPLIER = {"world": 1.25, "politics": 1.2, "elections": 1.2, "economy": 1.1, "finance": 1.1, "business": 1.1, "health": 1.05, "tech & science": 1.0, "culture": 0.95, "": 1.0}
CREDIBLE = {"official": 1.0, "news": 0.7, "social": 0.4}


def looked_up(key: Column, values: dict[str, float]) -> Column:
    """The value of a lower-cased key, or that of the empty key."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(key)), F.lit(values[""]))


def order_book(levels: DataFrame, market: str = "market") -> DataFrame:
    """``best_bid, best_ask, spread, depth, imbalance`` from ``side`` (bid, ask), ``price, size`` rows; empty books are left out."""
    bid, money = F.col("side") == "bid", F.col("price") * F.col("size")
    found = levels.groupBy(market).agg(
        F.coalesce(F.max(F.when(bid, F.col("price"))), F.lit(0.0)).alias("best_bid"), F.coalesce(F.min(F.when(~bid, F.col("price"))), F.lit(1.0)).alias("best_ask"),
        F.coalesce(F.sum(F.when(bid, money)), F.lit(0.0)).alias("bids"), F.coalesce(F.sum(F.when(~bid, money)), F.lit(0.0)).alias("asks"),
    )
    depth = F.col("bids") + F.col("asks")
    return found.select(market, "best_bid", "best_ask", F.greatest(F.lit(0.0), F.col("best_ask") - F.col("best_bid")).alias("spread"), depth.alias("depth"), F.when(depth > 0, (F.col("bids") - F.col("asks")) / depth).otherwise(0.0).alias("imbalance"))


def two_sided_book(levels: DataFrame, market: str = "market") -> DataFrame:
    """The same of a venue that lists bids for YES and NO, in dollars or cents: a bid for NO is an ask for YES."""
    price = F.when(F.col("price") > 1, F.col("price") / 100).otherwise(F.col("price"))
    yes = levels.withColumn("price", price)
    found = yes.groupBy(market).agg(
        F.coalesce(F.max(F.when(F.col("side") == "yes", F.col("price"))), F.lit(0.0)).alias("yes"), F.coalesce(F.max(F.when(F.col("side") == "no", F.col("price"))), F.lit(0.0)).alias("no"),
        F.sum(F.when(F.col("side") == "yes", F.col("price") * F.col("size")).otherwise(0.0)).alias("bids"), F.sum(F.when(F.col("side") == "no", F.col("price") * F.col("size")).otherwise(0.0)).alias("asks"),
    ).withColumn("depth", F.col("bids") + F.col("asks")).where("depth > 0")
    return found.select(market, F.col("yes").alias("best_bid"), (1 - F.col("no")).alias("best_ask"), F.greatest(F.lit(0.0), 1 - F.col("yes") - F.col("no")).alias("spread"), "depth", ((F.col("bids") - F.col("asks")) / F.col("depth")).alias("imbalance"))


def venue_markets(listed: DataFrame) -> DataFrame:
    """``listed`` with ``prob`` of a venue that quotes dollars or cents: the last price, else the middle of bid and ask; certain ones are left out."""
    dollars = lambda c: F.when(F.col(c) > 1, F.col(c) / 100).otherwise(F.col(c))
    last = F.when(F.col("last") > 0, dollars("last"))
    return listed.withColumn("prob", F.coalesce(last, (dollars("bid") + dollars("ask")) / 2)).where(F.col("prob").between(0.02, 0.98))


def _words(t: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(t), "[^a-z0-9_]+"), lambda w: F.length(w) >= 4))


def news_catalyst(moves: DataFrame, news: DataFrame, before: int = 48 * 3600, grace: int = 36 * 3600, after: int = 21 * 86_400, block: int = 7 * 86_400) -> DataFrame:
    """``market, ts, source, pre_event, hours``: the report that made a move public, or followed it.

    ``moves``: ``market, query, move_ts``; ``news``: ``title, source, ts``. A report is relevant if its title has two words
    of the query (one of short queries). The earliest from ``before`` to ``grace`` around the move comes first; else the earliest one
    up to ``after`` past it, which the move ran ahead of. Moves and reports meet by word and block of time, so no pair of others is made.
    """
    asked = moves.withColumn("words", _words(F.col("query"))).withColumn("need", F.when(F.size("words") >= 3, 2).otherwise(1))
    asked = asked.withColumn("word", F.explode("words")).withColumn("block", F.explode(F.sequence(F.floor((F.col("move_ts") - before) / block), F.floor((F.col("move_ts") + after) / block))))
    told = news.select("title", "source", "ts", F.explode(_words(F.col("title"))).alias("word")).withColumn("block", F.floor(F.col("ts") / block))
    hits = asked.join(told, ["word", "block"]).groupBy("market", "title", "source", "ts", "move_ts", "need").agg(F.count_distinct("word").alias("hits")).where(F.col("hits") >= F.col("need"))
    late = F.col("ts") - F.col("move_ts")
    near, ahead = late.between(-before, grace), (late > grace) & (F.floor(late / 3600 + 0.5) <= after // 3600)
    best = hits.groupBy("market").agg(F.min(F.when(near, F.struct("ts", "source", "move_ts"))).alias("a"), F.min(F.when(ahead, F.struct("ts", "source", "move_ts"))).alias("b"))
    one = best.withColumn("c", F.coalesce("a", "b")).where("c is not null")
    hours = F.when(F.col("a").isNotNull(), F.greatest(F.lit(0.0), (F.col("c.move_ts") - F.col("c.ts")) / 3600)).otherwise(F.floor((F.col("c.ts") - F.col("c.move_ts")) / 3600 + 0.5))
    return one.select("market", "c.ts", "c.source", F.col("a").isNull().alias("pre_event"), hours.cast("double").alias("hours"))


def explained(source: Column, hours: Column, pre_event: Column, same_direction: Column | None = None) -> Column:
    """How well a public report explains a move, 0 to 1: its credibility, fading over 48 hours; 0 where the move came first."""
    kind = text.credibility(source)
    weight = F.lit(0.0)
    for name, value in CREDIBLE.items():
        weight = F.when(kind == name, value).otherwise(weight)
    direction = F.lit(1.0) if same_direction is None else F.when(same_direction, 1.0).otherwise(0.4)
    return F.when(source.isNull() | pre_event, 0.0).otherwise(clip(weight * clip(1 - F.abs(hours) / 48, 0, 1) * direction, 0, 1))


def longshot(stake: Column, implied: Column, won: Column, category: Column) -> Column:
    """Score of a large position at long odds; 0 for any other."""
    base = looked_up(category, BASELINE)
    win = clip(0.45 + 0.4 * clip(1 - implied, 0, 1) + 0.15 * clip((base - implied) / F.greatest(F.lit(0.05), base), 0, 1), 0, 1)
    open_ = clip((0.35 - implied) / 0.35 * 0.4, 0, 0.5)
    return F.when((stake >= 2500) & (implied <= 0.35), F.when(won.isNull(), open_).when(won, win).otherwise(0.1)).otherwise(0.0)


def accumulation(net: Column, sold_share: Column, won: Column) -> Column:
    """Score of a one-directional position built before the outcome and held."""
    size = clip(F.log10(F.greatest(F.lit(1.0), F.abs(net))) / 5, 0, 1)
    held = F.when(sold_share.isNull(), 0.5).when(sold_share <= 0.03, 1.0).otherwise(clip(1 - sold_share / 0.2, 0, 1))
    return clip(0.45 * size + 0.30 * held + 0.25 * F.when(won.isNull(), 0.5).when(won, 1.0).otherwise(0.0), 0, 1)


def volume_run_up(bars: DataFrame, market: str = "market") -> DataFrame:
    """``base, pre, ratio, score``: mean volume of the second half of the bars over that of the first."""
    rows = in_order(bars, market, F.lit(0.0))
    half = F.floor(F.col("points") / 2)
    found = rows.groupBy(market).agg(F.avg(F.when(F.col("k") <= half, F.col("volume"))).alias("base"), F.avg(F.when(F.col("k") > half, F.col("volume"))).alias("pre")).where("base > 0")
    ratio = F.col("pre") / F.col("base")
    return found.select(market, "base", "pre", ratio.alias("ratio"), clip(F.log2(F.greatest(F.lit(1.0), ratio)) / F.log2(F.lit(10.0)), 0, 1).alias("score"))


def proxy_run_up(prob: Column, change: Column) -> Column:
    """Run-up score from a day's change alone; null where the price is certain."""
    move = F.abs(logit(prob) - logit(clip(prob - change, 0.001, 0.999)))
    return F.when((prob > 0) & (prob < 1), clip(move / 0.55 / 4, 0, 1))


def top_concentration(volumes: DataFrame, moves: DataFrame, fresh_hours: int = 48) -> DataFrame:
    """``cond, hhi, top, fresh, score``: concentration of buying, more where the largest buyer came hours before the move (``cond, move_ts``)."""
    buys = volumes.where("buy_usd > 0")
    found = buys.groupBy("cond").agg(F.sum("buy_usd").alias("total"), F.sum(F.col("buy_usd") * F.col("buy_usd")).alias("squares"), F.max(F.struct("buy_usd", F.col("first_ts"))).alias("t"), F.count("*").alias("wallets")).where("wallets >= 3")
    rows = found.join(moves, "cond", "left")
    came = F.col("move_ts") - F.col("t.first_ts")
    fresh = F.coalesce((came <= fresh_hours * 3600) & (came >= -3600), F.lit(False))
    hhi, top = F.col("squares") / (F.col("total") * F.col("total")), F.col("t.buy_usd") / F.col("total")
    return rows.select("cond", hhi.alias("hhi"), top.alias("top"), fresh.alias("fresh"), clip(0.55 * hhi + 0.45 * top + F.when(fresh, 0.15).otherwise(0.0), 0, 1).alias("score"))


def label(quality: Column, explained_: Column, raw: Column, pre_event: Column) -> Column:
    e = F.coalesce(explained_, F.lit(0.0))
    return F.when(quality <= 0.25, "Low-liquidity artifact").when((e >= 0.5) & ~F.coalesce(pre_event, F.lit(False)), "Explained").when((raw >= 0.5) & (e < 0.3), "Unexplained").otherwise("Partially explained")


#: Checks that need wallets, which an anonymous venue hasn't.
NEED_WALLETS = ("longshot", "wash")


def engine_scores(scores: DataFrame, markets: DataFrame, engine: str) -> DataFrame:
    """``market, raw, ran, total, score, agreeing, tier, label`` of an engine's detectors (``market, detector, sub``).

    ``markets``: ``market, anonymous, quality, explained, pre_event, multiplier``. Checks that need wallets don't count
    on an anonymous venue. Weights are shared out over the detectors that ran.
    """
    weights = INSIDER if engine == "insider" else MANIPULATION
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    known = scores.where(F.col("detector").isin(*weights) & F.col("sub").isNotNull()).withColumn("w", w[F.col("detector")]).join(markets, "market")
    known = known.where(~(F.col("anonymous") & F.col("detector").isin(*NEED_WALLETS)))
    found = known.groupBy("market").agg(
        (F.sum(F.col("w") * F.col("sub")) / F.sum("w")).alias("raw"), F.count("*").alias("ran"), F.count_if(F.col("sub") >= 0.45).alias("agreeing"),
        *(F.first(c).alias(c) for c in ("anonymous", "quality", "explained", "pre_event", "multiplier")),
    )
    needs = sum(k in NEED_WALLETS for k in weights)
    total = F.when(F.col("anonymous"), len(weights) - needs).otherwise(len(weights))
    factor = clip((1 - 0.6 * F.col("explained")) * F.col("multiplier"), 0, 1.5) if engine == "insider" else F.lit(1.0)
    score = F.floor(100 * clip(F.col("raw") * factor, 0, 1) * F.col("ran") / total + 0.5 + 1e-9).cast("int")
    out = found.withColumn("total", total).withColumn("score", score)
    tier = F.when(F.col("quality") <= 0.25, "Watch").when((F.col("ran") == F.col("total")) & (F.col("agreeing") >= 2) & (F.col("score") >= 70), "High-signal").when((F.col("score") >= 50) & (F.col("agreeing") >= 1), "Elevated").when(F.col("score") >= 30, "Watch").otherwise("Clear")
    return out.select("market", "raw", "ran", "total", "score", "agreeing", tier.alias("tier"), label(F.col("quality"), F.col("explained"), F.col("raw"), F.col("pre_event")).alias("label"))


def downsample(series: DataFrame, most: int = 120, market: str = "market") -> DataFrame:
    """Every k-th point of a market, k such that about ``most`` are left."""
    rows = in_order(series, market, F.lit(0.0))
    return rows.where((F.col("k") - 1) % F.greatest(F.lit(1), F.floor(F.col("points") / most)) == 0).select(*series.columns)


def deep_set(scored: DataFrame, resolved: int = 8, per_venue: int = 7, most: int = 22) -> DataFrame:
    """Markets that are looked at closely: the top resolved ones, and the top of each venue by index; each once, at most ``most``."""
    by = [F.desc("score"), F.col("market")]
    # two branches with limits of their own: each task keeps no more rows than the limit before they meet
    done = scored.where("resolved").orderBy(*by).limit(resolved)
    rank = F.row_number().over(Window.partitionBy("venue").orderBy(*by))
    open_ = scored.where("not resolved").withColumn("_v", rank).where(F.col("_v") <= per_venue).drop("_v")
    return done.unionByName(open_).orderBy(F.desc("resolved"), *by).limit(most)


def augmented(resolved: DataFrame, open_: DataFrame, least: int) -> DataFrame:
    """Resolved markets, with open ones beside them where fewer than ``least`` are resolved; each id once."""
    n = resolved.agg(F.count("*").alias("n"))
    more = open_.join(F.broadcast(n), F.col("n") < least).drop("n").join(resolved.select("market"), "market", "left_anti")
    return resolved.unionByName(more).dropDuplicates(["market"])


def coverage(scored: DataFrame) -> DataFrame:
    """``venue, tier, n, alerts``: markets of each venue and tier; alerts are the High-signal and Elevated ones."""
    return scored.groupBy("venue", "tier").agg(F.count("*").alias("n"), F.count_if(F.col("tier").isin("High-signal", "Elevated")).alias("alerts"))
