"""Trades to net positions per (market, wallet), and each market's cross-section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import clip


@dataclass(frozen=True)
class MarketRules:
    late_window: int = 48 * 3600
    least_buyers: int = 3
    least_volume: float = 10_000
    least_stake: float = 500
    shock_bucket: int = 3600
    shock_move: float = 0.15
    shock_trades: int = 8
    shock_buckets: int = 3
    wallet_parts: int = 16


def _leg(outcome: str, rules: MarketRules) -> list[Column]:
    own = F.col("outcome") == outcome
    buy, sell = own & (F.col("side") != "SELL"), own & (F.col("side") == "SELL")
    late = buy & (F.col("last_ts") - F.col("ts")).between(0, rules.late_window)
    money = F.col("size") * F.col("price")
    o = outcome.lower()

    def total(when: Column, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, x)), F.lit(0.0))

    return [
        total(buy, F.col("size")).alias(f"{o}_bought"), total(sell, F.col("size")).alias(f"{o}_sold"),
        total(buy, money).alias(f"{o}_cost"), total(sell, money).alias(f"{o}_proceeds"), total(late, money).alias(f"{o}_late"),
        # apart from tx: a least struct is found by sorting, which those who need the time alone don't pay for
        F.min(F.when(buy, F.col("ts"))).alias(f"{o}_ts"), F.min(F.when(buy, F.struct("ts", "tx"))).alias(f"{o}_first"),
    ]


def net_positions(trades: DataFrame, catalog: DataFrame, rules: MarketRules = MarketRules()) -> DataFrame:
    """One row per (market, wallet): both legs, the dominant one by cost (ties: NO), net money in and out.

    One aggregation yields both legs, so no self-join is needed; only the markets' last trades and
    winners, one row a market, are joined to trades. They are joined by market and part of its wallets, so that a
    few busy markets are spread over ``wallet_parts`` times as many tasks; one exchange of trades serves all steps.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(rules.wallet_parts - 1))).alias("_part")
    last = trades.groupBy("cond").agg(F.max("ts").alias("last_ts")).select("*", parts)
    known = trades.where(F.col("outcome").isin("YES", "NO") & (F.col("size") != 0) & F.col("wallet").isNotNull())
    known = known.withColumn("_part", F.pmod(F.xxhash64("wallet"), F.lit(rules.wallet_parts)).cast("int"))
    legs = known.join(last, ["cond", "_part"]).groupBy("cond", "_part", "wallet").agg(*_leg("YES", rules), *_leg("NO", rules))
    legs = legs.where((F.col("yes_bought") > 0) | (F.col("no_bought") > 0)).join(catalog.select("*", parts), ["cond", "_part"])
    yes = (F.col("yes_bought") > 0) & ((F.col("no_bought") <= 0) | (F.col("yes_cost") > F.col("no_cost")))

    def own(name: str) -> Column:
        return F.when(F.col("is_yes"), F.col(f"yes_{name}")).otherwise(F.col(f"no_{name}"))

    def other(name: str) -> Column:
        return F.when(F.col("is_yes"), F.col(f"no_{name}")).otherwise(F.col(f"yes_{name}"))

    wide = legs.withColumn("is_yes", yes)
    winning = F.when(F.col("winner") == "YES", F.col("yes_bought") - F.col("yes_sold")).when(F.col("winner") == "NO", F.col("no_bought") - F.col("no_sold"))
    cost, proceeds = F.col("yes_cost") + F.col("no_cost"), F.col("yes_proceeds") + F.col("no_proceeds")
    given = [c for c in ("corr_key", "question") if c in catalog.columns]
    return wide.select(
        "cond", "wallet", "event_group", "category", "resolved_ts", *given, F.when(F.col("is_yes"), "YES").otherwise("NO").alias("outcome"),
        clip(own("cost") / own("bought"), 1e-4, 0.9999).alias("entry"), own("cost").alias("gross"),
        F.greatest(F.lit(0.0), cost - proceeds).alias("stake"),
        (proceeds + F.greatest(F.lit(0.0), F.coalesce(winning, F.lit(0.0))) - cost).alias("pnl"),
        (F.when(F.col("is_yes"), F.lit("YES")).otherwise(F.lit("NO")) == F.col("winner")).alias("won"),
        (own("sold") < 0.03 * own("bought")).alias("held"),
        F.when(own("cost") > 0, clip(own("late") / own("cost"), 0, 1)).otherwise(0.0).alias("late"),
        clip(1 - (own("sold") + other("bought")) / own("bought"), 0, 1).alias("directional"),
        own("ts").alias("ts"), own("first")["tx"].alias("tx"),
    )


def peers(positions: DataFrame) -> DataFrame:
    """What the positions of each market have in common, a row a market."""
    return positions.groupBy("cond").agg(
        F.avg("stake").alias("mean_stake"), F.stddev_samp("stake").alias("sd_stake"), F.avg("pnl").alias("mean_profit"),
        F.stddev_samp("pnl").alias("sd_profit"), F.count("*").alias("buyers"), F.sum("gross").alias("market_volume"),
    )


def beside_peers(positions: DataFrame, facts: DataFrame, rules: MarketRules = MarketRules()) -> DataFrame:
    """``positions`` with the columns of their market's ``facts`` (those of :func:`peers`, maybe more), ``z_bet`` and ``z_profit``."""
    able = (F.col("buyers") >= rules.least_buyers) & (F.col("market_volume") >= rules.least_volume) & (F.col("stake") >= rules.least_stake)

    def z(x: str, mean: str, sd: str) -> Column:
        return F.when(able & (F.col(sd) > 0), (F.col(x) - F.col(mean)) / F.col(sd))

    joined = positions.join(facts, "cond")
    return joined.withColumns({"z_bet": z("stake", "mean_stake", "sd_stake"), "z_profit": z("pnl", "mean_profit", "sd_profit")})


def market_cross_section(positions: DataFrame, rules: MarketRules = MarketRules()) -> DataFrame:
    """Positions with their market's peers: ``z_bet``, ``z_profit`` (null where there is no spread or the market
    or stake is too small), ``buyers``, ``market_volume``. Peers are summed up per market, then joined."""
    return beside_peers(positions, peers(positions), rules)


def price_shock(trades: DataFrame, rules: MarketRules = MarketRules()) -> DataFrame:
    """``cond, shock_ts, move``: start of the hour with the largest step of the hourly mean price, if large enough."""
    hour = F.floor(F.col("ts") / rules.shock_bucket) * rules.shock_bucket
    bins = trades.where((F.col("ts") > 0) & (F.col("price") > 0) & (F.col("price") < 1)).groupBy("cond", hour.alias("hour")).agg(F.avg("price").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy("cond").orderBy("hour")
    steps = bins.withColumn("step", F.abs(F.col("p") - F.lag("p").over(w)))
    found = steps.groupBy("cond").agg(F.sum("n").alias("n"), F.count("*").alias("buckets"), F.max("step").alias("move"), F.max_by(F.col("hour"), F.struct("step", -F.col("hour"))).alias("shock_ts"))
    return found.where((F.col("n") >= rules.shock_trades) & (F.col("buckets") >= rules.shock_buckets) & (F.col("move") >= rules.shock_move)).select("cond", "shock_ts", "move")


def surprise_markets(positions: DataFrame, least: float = 0.70, least_stake: float = 1000, top: int = 400) -> DataFrame:
    """Markets whose winners paid little: stake-weighted entry of winners with 1-entry >= ``least``; the top by weight."""
    winners = positions.where(F.col("won") & (F.col("stake") > 0)).groupBy("cond").agg((F.sum(F.col("stake") * F.col("entry")) / F.sum("stake")).alias("implied"), F.sum("stake").alias("total_stake"), F.max("stake").alias("top_stake"), F.count("*").alias("winners"))
    kept = winners.withColumn("surprise", 1 - F.col("implied")).where((F.col("surprise") >= least) & (F.col("total_stake") >= least_stake))
    return kept.orderBy((F.col("surprise") * F.log10(F.greatest(F.lit(10.0), "top_stake"))).desc(), "cond").limit(top)
