"""From fused records to published subjects: gate, suspicion, final tier; interval joins with news and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators import asof
from tapewatch.sources.shared import staged

#: Share of improbability, breadth, timing, magnitude and structure in the score.
SHARES = (0.40, 0.28, 0.08, 0.12, 0.12)


#: What the tiers of fused records are called when published, and floors in dollars.
TIERS = {"extreme": "extreme", "high": "elevated", "notable": "watch"}
MATERIAL, LEAST_PROFIT, TIER_PROFIT, EXTREME_PROFIT = 2500, 2500, 10_000, 25_000
STRUCTURAL = ("conceal", "cluster")
AGREEING = ("won", "longshot", "held", "fresh", "baseline", "profitCross", "conceal", "cluster", "conviction", "timing", "repeat", "concentration", "sizing")


def _tier_name(tier: Column) -> Column:
    said = F.lit(None).cast("string")
    for fused, name in TIERS.items():
        said = F.when(tier == fused, name).otherwise(said)
    return said


def _joined(fused: DataFrame, records: DataFrame | None) -> DataFrame:
    """Fused rows with their records' columns, which they have by themselves where no records are given."""
    return fused.drop("tail") if records is None else fused.join(records.drop("tail"), "wallet")


def record_context(fused: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Fused wallets with the numbers that a published record shows: ``shown_n, shown_k, implied, rate, denominator, profit, improbable, shown_tier``.

    profit is that of the long shots. Red tiers need serious money: less than ``EXTREME_PROFIT`` makes an
    extreme record elevated, less than ``TIER_PROFIT`` makes it watch.
    """
    rows = _joined(fused, records)
    own = F.col("p_value").isNotNull()
    odds = F.when(F.col("top.cheap_stake") > 0, F.col("top.cheap_weighted") / F.col("top.cheap_stake"))
    n = F.when(own, F.col("ls_groups")).otherwise(F.col("ls_bets"))
    improbable = F.coalesce(F.col("p_value") <= 0.01, F.lit(False))
    one_in = F.when(improbable, F.floor(1 / F.greatest(F.col("p_value"), F.lit(1e-15)) + 0.5)).when(odds > 0, F.floor(1 / odds + 0.5)).otherwise(0)
    tier, profit = _tier_name(F.col("tier")), F.coalesce("ls_pnl", F.lit(0.0))
    tier = F.when((tier == "extreme") & (profit > 0) & (profit < EXTREME_PROFIT), "elevated").otherwise(tier)
    tier = F.when(tier.isin("extreme", "elevated") & (profit > 0) & (profit < TIER_PROFIT), "watch").otherwise(tier)
    return rows.withColumns({
        "shown_n": n, "shown_k": F.col("ls_won"), "implied": F.floor(100 * F.coalesce(F.when(own, F.col("ls_p")), odds, F.col("ls_mean"), F.lit(0.0)) + 0.5),
        "rate": F.when(n > 0, F.floor(100 * F.col("ls_won") / n + 0.5)).otherwise(0), "denominator": one_in, "profit": profit, "improbable": improbable, "shown_tier": tier,
        "conviction_fires": F.array_contains("fired", "conviction"),
    })


def first_problem(rows: DataFrame, cluster: Column | None = None, least_profit: float = LEAST_PROFIT) -> Column:
    """The first rule that a subject breaks, null if its numbers hold together: what keeps bad numbers from being published.

    Clusters pool their members' money, so account rules don't hold for them.
    """
    c = F.col
    single = ~(F.lit(False) if cluster is None else cluster)
    published, own = c("denominator"), F.floor(1 / F.greatest(c("p_value"), F.lit(1e-15)) + 0.5)
    return (
        F.when(c("shown_tier").isNull(), "no tier").when(~(c("shown_n") >= 1), "n<1").when(~c("shown_k").between(0, c("shown_n")), "k out of range")
        .when(~c("implied").between(1, 99), "avgImplied out of range").when(~c("rate").between(0, 100), "winRate out of range").when(~(published >= 1), "improbDenom invalid")
        .when(c("profit").isNull() | F.isnan("profit"), "profit not finite").when(c("profit") <= 0, "net unprofitable").when(single & (c("account_pnl") <= 0), "account net-negative")
        .when(single & (c("profit") < least_profit), "below net-profit floor").when(c("bets") < 1, "no bets").when(c("bad_entries") > 0, "bad entryPrice").when(c("bad_stakes") > 0, "bad stake")
        .when(c("no_results") > 0, "won not boolean").when(c("improbable") & ((own / published < 0.5) | (own / published > 2)), "improbDenom mismatch")
        .when(~c("improbable") & ~(c("conviction_fires") & (c("top.cheap_stake") > 0)), "convOnly without a valid conviction bet")
    )


def record_pass(context: DataFrame) -> DataFrame:
    """``context`` with ``considered`` (flagged, improbable or one conviction bet, material) and ``reject_reason``."""
    floor = F.when(F.col("tier").isin("extreme", "high"), MATERIAL / 2).otherwise(MATERIAL)
    considered = F.col("shown_tier").isNotNull() & (F.col("improbable") | F.col("conviction_fires")) & (F.greatest("ls_staked", F.coalesce("top.cheap_stake", F.lit(0.0))) >= floor)
    return context.withColumns({"considered": F.coalesce(considered, F.lit(False)), "reject_reason": first_problem(context)})


def favourite_pass(fused: DataFrame, records: DataFrame | None, bets: DataFrame, most_odds: float = 0.90, z: float = 2, net: float = 5000, account: float = 1000) -> DataFrame:
    """``wallet, tier, profit, measure`` of wallets that out-earned their peers on a favourite: the bet with the best z_profit won, was
    outsized, and the wallet hides or is linked to others."""
    best = bets.where(F.col("z_profit") >= z).groupBy("wallet").agg(F.max(F.struct("z_profit", (-F.col("cond")).alias("c"), "won", "entry", "z_bet", "stake", "pnl")).alias("b"))
    rows = _joined(fused, records).join(best, "wallet")
    has = lambda k: F.array_contains("fired", k)
    structural = sum((has(k).cast("int") for k in STRUCTURAL), F.lit(0))
    kept = rows.where(
        F.col("b.won") & F.col("b.entry").between(1e-12, most_odds) & ((F.col("b.z_bet") >= 2) | has("sizing")) & (F.greatest(F.col("b.stake"), F.abs("b.pnl")) >= MATERIAL)
        & (F.col("pnl") >= net) & (structural >= 1) & (F.col("account_pnl") >= account)
    )
    tier = F.when((F.col("b.z_profit") >= 4) & (structural >= 2), "extreme").when((F.col("b.z_profit") >= 3) | (structural >= 2), "high").otherwise("notable")
    tier = F.when(F.col("b.pnl") >= TIER_PROFIT, tier).otherwise("notable")
    return kept.select("wallet", _tier_name(tier).alias("tier"), F.col("pnl").alias("profit"), F.col("b.z_profit").alias("measure"))


def cross_pass(fused: DataFrame, records: DataFrame | None, detectors: DataFrame) -> DataFrame:
    """``wallet, tier, profit, measure`` of near-perfect records at any odds: crossCat fires and two other detectors agree."""
    agree = detectors.where(F.col("detector").isin(*AGREEING) & F.col("fires") & (F.col("score") >= 0.45)).groupBy("wallet").agg(F.count("*").alias("agree"))
    rows = _joined(fused, records).join(agree, "wallet").where(F.array_contains("fired", "crossCat") & (F.col("agree") >= 2) & (F.col("pnl") > 0) & (F.col("pnl") >= LEAST_PROFIT))
    kept = rows.where((F.greatest("staked", "max_event") >= MATERIAL) & (F.col("account_pnl").isNull() | (F.col("account_pnl") > 0)))
    return kept.select("wallet", F.when(F.col("p_cross") <= 1e-4, "elevated").otherwise("watch").alias("tier"), F.col("pnl").alias("profit"), F.col("p_cross").alias("measure"))


def episode_pass(episodes: DataFrame, records: DataFrame, least: float = 1000) -> DataFrame:
    """``wallet, tier, profit, measure`` of single outsized episodes of a high tier whose money the account kept."""
    rows = episodes.where("tier in ('high', 'extreme')").withColumnRenamed("pnl", "profit").join(records.select("wallet", "account_pnl"), "wallet")
    kept = rows.where((F.col("account_pnl") >= least) & (F.col("profit") >= least) & (F.col("profit") <= F.greatest(F.lit(50_000.0), 5 * F.col("account_pnl"))))
    return kept.select("wallet", _tier_name(F.col("tier")).alias("tier"), "profit", F.col("s").alias("measure"))


def union_of_passes(passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row a wallet from ``wallet, tier, profit, measure`` of each pass; the first pass that has it wins."""
    rows = None
    for rank, (name, found) in enumerate(passes):
        own = found.select("wallet", F.lit(rank).alias("rank"), F.lit(name).alias("pass"), "tier", "profit", F.col("measure").cast("double").alias("measure"))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy("wallet").agg(F.min(F.struct("rank", "pass", "tier", "profit", "measure")).alias("b"))
    return best.select("wallet", "b.pass", "b.tier", "b.profit", "b.measure")


def info_signals(fused: DataFrame, found: DataFrame) -> DataFrame:
    """Fused rows in which a news blackout that fires joins the fired detectors; ``found``: detector rows of ``newsBlackout``."""
    on = found.where((F.col("detector") == "newsBlackout") & F.col("fires")).select("wallet", F.lit(True).alias("quiet")).distinct()
    rows = fused.join(on, "wallet", "left")
    more = F.coalesce(F.col("quiet") & ~F.array_contains("fired", "newsBlackout"), F.lit(False))
    return rows.withColumns({"fired": F.when(more, F.array_append("fired", F.lit("newsBlackout"))).otherwise(F.col("fired")), "n_fired": F.col("n_fired") + more.cast("int")}).drop("quiet")


def feed_order(subjects: DataFrame, by: str = "detected", kind: str | None = None, tier: str | None = None, category: str | None = None, most: int | None = None) -> DataFrame:
    """Subjects of a type, tier and category in one of the feed's orders; ``wallet`` settles ties."""
    orders = {
        "detected": [F.desc_nulls_last("first_flagged"), F.asc_nulls_last("activity_days"), F.desc("denominator")], "suspicion": [F.desc("suspicion"), F.desc("denominator")], "improbability": [F.desc("denominator")],
        "profit": [F.desc_nulls_last("profit")], "winrate": [F.desc_nulls_last("rate")], "volume": [F.desc_nulls_last("staked")], "recent": [F.asc_nulls_first("activity_days")],
    }
    rows = subjects
    for column, value in (("type", kind), ("tier", tier), ("category", category)):
        rows = rows if value is None else rows.where(F.lower(column) == value.lower())
    rows = rows.orderBy(*orders[by], "wallet")
    return rows if most is None else rows.limit(most)


def ledger(bets: DataFrame, most: int = 200) -> DataFrame:
    """``wallet, place, cond, odds, stake, profit, won``: each wallet's bets by stake, at most ``most``; a report, so the bound is the feature.

    profit is the settled one, or else what the odds give.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), "entry"))
    profit = F.coalesce("pnl", F.when(F.col("won"), F.col("stake") * (1 / p - 1)).otherwise(-F.col("stake")))
    rows = bets.withColumn("place", F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("stake"), "cond")))
    return rows.where(F.col("place") <= most).select("wallet", "place", "cond", F.floor(100 * F.col("entry") + 0.5).alias("odds"), "stake", profit.alias("profit"), "won")


#: What a scorecard says of each detector: method, and how its measure reads.
CARDS = {
    "won": ("luck probability", "p = %.4f"), "crossCat": ("improbability over all odds", "z = %.2f"), "longshot": ("average odds", "%.2f"), "held": ("exit check", "%.2f held"), "baseline": ("win rate against break-even", "%.2f"),
    "profitCross": ("profit against peers", "z = %.2f"), "conceal": ("concealment check", "%.0f tactics"), "fresh": ("account-age check", "%.0f days old"), "cluster": ("shared-funding link", "link %.2f"), "conviction": ("single high-conviction bet", "$%.0f"),
    "timing": ("informed-entry timing", "%.1f h before"), "repeat": ("repeated surprising wins", "%.0f events"), "concentration": ("directional concentration", "%.2f one-way"), "sizing": ("bet-size anomaly", "%.1f x median"),
    "newsBlackout": ("news before the bet", "%.0f articles"), "fedRegister": ("documents after the bet", "%.0f documents"),
}


def scorecard(detectors: DataFrame) -> DataFrame:
    """``wallet, detector, method, metric``: a card for each detector that fires."""
    said = None
    for key, (method, shape) in CARDS.items():
        card = F.struct(F.lit(method).alias("method"), F.format_string(shape, F.col("measure") + 1e-7).alias("metric"))
        said = F.when(F.col("detector") == key, card) if said is None else said.when(F.col("detector") == key, card)
    return detectors.where("fires").withColumn("card", said).select("wallet", "detector", "card.method", "card.metric")


def suspicion(gated: DataFrame) -> DataFrame:
    """``suspicion`` (0 to 100) and ``final_tier`` of each row."""
    has = lambda *keys: F.arrays_overlap("fired", F.array(*map(F.lit, keys))).cast("int")
    p = F.greatest(F.coalesce("p_value", "p_cross"), F.lit(1e-15))
    improbable = F.coalesce(F.least(F.lit(1.0), -F.log10(p) / 12), F.lit(0.0))
    breadth, size = F.least(F.lit(1.0), F.col("n_fired") / 9), F.least(F.lit(1.0), F.log10(F.greatest(F.abs("profit"), F.lit(1.0))) / 6)
    structure = F.greatest(has("conceal", "cluster"), has("conviction") * has("concentration"))
    a, b, c, d, e = SHARES
    total = a * improbable + b * breadth + c * has("timing", "crossCat", "newsBlackout") + d * size + e * structure
    out = gated.withColumn("suspicion", F.floor(total * 1000 + 0.5 + 1e-7) / 10)
    return out.withColumn("final_tier", F.when((F.col("suspicion") >= 45) & (F.col("profit") >= 10_000), "elevated").otherwise("watch"))


def rejects(gated: DataFrame, keep: int = 500) -> DataFrame:
    """The report of rejected wallets: reason and tier, at most ``keep`` rows by wallet."""
    return gated.where("considered and reject_reason is not null").select("wallet", "tier", "reject_reason").orderBy("wallet").limit(keep)


def news_blackout(bets: DataFrame, news: DataFrame, hours: int = 24, outsized: float = 1000) -> DataFrame:
    """``bet_id, n, blackout, score``: news of a bet's entity in the hours before it; few or none is a signal.

    News are counted up to both ends of the hours, so no pair of a bet and a report is made.
    """
    rows = bets.withColumn("id", F.col("bet_id"))
    rows = asof.counted(rows, news, "entity", {"_before": F.col("ts") - hours * 3600 - 1, "_upto": F.col("ts")}, block=86_400)
    rows = rows.withColumn("n", F.col("_upto") - F.col("_before"))
    score = F.when((F.col("n") == 0) & (F.col("stake") >= outsized), 0.6).when(F.col("n") == 0, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.25), 0.2 - 0.02 * F.col("n"))))
    return rows.select("bet_id", "n", (F.col("n") == 0).alias("blackout"), score.alias("score"))


def regulatory_matches(bets: DataFrame, docs: DataFrame, keep: int = 5, back: int = 14 * 86_400, ahead: int = 120 * 86_400) -> DataFrame:
    """``bet_id, ahead, docs``: the newest documents on a bet's entity around it, and how many came on or after it."""
    newest = asof.newest_within(bets.withColumn("id", F.col("bet_id")), docs, "entity", back, ahead, keep, ["doc"])
    return newest.groupBy("bet_id").agg(F.count_if(F.col("found.ts") >= F.col("ts")).cast("int").alias("ahead"), F.count("*").cast("int").alias("docs"))


def document_matches(bets: DataFrame, docs: DataFrame, keep: int = 5, back: int = 14 * 86_400, ahead: int = 120 * 86_400) -> DataFrame:
    """The same of documents (``id, title, abstract, ts``) whose title or abstract contains the entity, of three letters or more."""
    named = staged(asof.containing(bets.select("entity"), docs, ["title", "abstract"]).select("entity", "ts", F.col("id").alias("doc")))
    return regulatory_matches(bets, named, keep, back, ahead)


def funding_network(transfers: DataFrame, subjects: DataFrame, funders: int = 3, recipients: int = 30) -> DataFrame:
    """``subject, funder, recipient, value, first_ts``: a subject's largest funders and whom else they funded most.

    Both steps rank sums by group, and only funders of a subject are followed.
    """
    sums = transfers.groupBy("from", "to").agg(F.sum("value").alias("value"), F.min("ts").alias("first_ts"))
    of = sums.join(subjects.select(F.col("wallet").alias("to")).distinct(), "to").withColumn("r", F.row_number().over(Window.partitionBy("to").orderBy(F.desc("value"), "from"))).where(F.col("r") <= funders)
    hubs = of.select("from").distinct()
    given = sums.join(hubs, "from").withColumn("r", F.row_number().over(Window.partitionBy("from").orderBy(F.desc("value"), "to"))).where(F.col("r") <= recipients)
    return of.select(F.col("to").alias("subject"), F.col("from").alias("funder")).join(given.select(F.col("from").alias("funder"), F.col("to").alias("recipient"), "value", "first_ts"), "funder").where("subject <> recipient").select("subject", "funder", "recipient", "value", "first_ts")
