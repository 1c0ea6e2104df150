"""Wallet records and detectors: one row a wallet with every measure, then projections over it.

Bets of a wallet are summed up per event and then per wallet; both steps group by the wallet first,
so one exchange serves both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import binomial_tail, clip, exact_mean, exact_sum, upper_tail
from tapewatch.operators.ranks import counted_ranks


@dataclass(frozen=True)
class WalletRules:
    """Thresholds; every transform takes one, so a caller can change any of them."""

    longshot: float = 0.35
    least_bets: int = 5
    p_notable: float = 1e-2
    p_high: float = 1e-4
    p_extreme: float = 1e-6
    agree_score: float = 0.45
    least_agree: int = 2
    conviction_odds: float = 0.15
    conviction_usd: float = 7500
    timing_odds: float = 0.20
    timing_hours: float = 72
    repeat_odds: float = 0.5
    concentration_bets: int = 3
    concentration_purity: float = 0.95
    concentration_usd: float = 10_000
    sizing_bets: int = 4
    sizing_times: float = 8
    sizing_usd: float = 3000
    decoy_small: float = 200
    decoy_real: float = 10_000
    decoy_share: float = 0.3
    split_share: float = 0.5
    fast_cash_out_hours: float = 24
    least_tactics: int = 2
    fresh_days: float = 14
    cluster_link: float = 0.80
    outsized_usd: float = 1000
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))


#: Weight of each detector in a fused record.
WEIGHTS = {
    "won": 26, "crossCat": 22, "timing": 18, "cluster": 18, "newsBlackout": 12, "concentration": 12, "conceal": 12, "repeat": 10, "conviction": 6, "fedRegister": 6,
    "fresh": 5, "sizing": 5, "profitCross": 5, "longshot": 4, "held": 4, "baseline": 4,
}
#: What accounts say of a wallet beside its bets; null where nothing is known.
ACCOUNT = {
    "username": "string", "account_pnl": "double", "age_days": "double", "prior_tx": "bigint", "split_ratio": "double", "cash_out_hours": "double", "mean_link": "double",
    "news_count": "bigint", "docs_ahead": "bigint", "has_profile": "boolean",
}


def records(bets: DataFrame, rules: WalletRules = WalletRules(), accounts: DataFrame | None = None) -> DataFrame:
    """One row per wallet from its settled bets (``cross-section`` rows joined with ``shock_ts``) and its account.

    Wins that count as independent are grouped by ``corr_key`` (by event where there is none); stakes by event.
    A wallet has a bet a market at most, so one exchange by wallet serves all groupings.
    """
    ls = F.col("entry") <= rules.longshot
    p = clip(F.col("entry"), 1e-6, 1 - 1e-6)
    cheap_win = ls & F.col("won") & (F.col("entry") <= rules.conviction_odds) & F.col("held")
    anchor = F.coalesce("shock_ts", "resolved_ts")
    timed = ls & F.col("won") & (F.col("entry") <= rules.timing_odds) & (anchor > F.col("ts"))
    hours = F.when(timed, (anchor - F.col("ts")) / 3600)
    surprising = F.col("won") & (F.col("entry") <= rules.repeat_odds)
    staked = F.when(F.col("stake") > 0, F.col("stake"))

    def count(x: Column) -> Column:
        return F.count_if(x)

    def total(when: Column, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, x)), F.lit(0.0))

    own = bets.repartition("wallet")
    key = "corr_key" if "corr_key" in bets.columns else "event_group"
    groups = own.groupBy("wallet", key).agg(
        count(ls).alias("ls_n"), count(ls & F.col("won")).alias("ls_wins"), F.avg(F.when(ls, p)).alias("ls_p"), F.count("*").alias("n"), count(F.col("won")).alias("wins"),
        exact_mean(p).alias("p"), count(surprising).alias("surprises"),
    ).groupBy("wallet").agg(
        count(F.col("ls_n") > 0).alias("ls_groups"), count((F.col("ls_n") > 0) & (2 * F.col("ls_wins") >= F.col("ls_n"))).alias("ls_won"), F.avg("ls_p").alias("ls_p"),
        F.count("*").alias("groups"), count(2 * F.col("wins") >= F.col("n")).alias("won_groups"), exact_sum(F.col("p")).alias("expected"), F.sum(F.col("p") * (1 - F.col("p"))).alias("variance"),
        count(F.col("surprises") > 0).alias("surprising_events"),
    )
    events = own.groupBy("wallet", "event_group").agg(
        total(F.col("stake") > 0, F.col("stake")).alias("stake"), total((F.col("stake") > 0) & (F.col("outcome") == "YES"), F.col("stake")).alias("yes"),
        count(cheap_win).alias("cheap"), total(cheap_win, F.col("stake")).alias("cheap_stake"), total(cheap_win, F.col("stake") * clip(F.col("entry"), 1e-4, 1 - 1e-4)).alias("cheap_weighted"),
    )
    top = F.max_by(F.struct("cheap_stake", "cheap_weighted"), F.when(F.col("cheap") > 0, F.struct("cheap_stake", -F.col("event_group"))))
    events = events.groupBy("wallet").agg(top.alias("top"), F.sum("stake").alias("staked"), F.sum("yes").alias("yes"), F.max("stake").alias("max_event"))
    # the stake in the middle by its number: Spark's own median keeps a map of values for each wallet and sorts the maps
    stakes = Window.partitionBy("wallet")
    ranked = own.withColumn("_staked", staked).withColumns({"_number": F.row_number().over(stakes.orderBy(F.desc_nulls_last("_staked"))), "_of": F.count("_staked").over(stakes)})
    facts = ranked.groupBy("wallet").agg(
        F.count("*").alias("bets"), count(F.col("won")).alias("wins"), F.sum("pnl").alias("pnl"), F.try_divide(F.sum("entry"), F.count("*")).alias("mean_odds"), count(ls).alias("ls_bets"),
        F.avg(F.when(ls, F.col("entry"))).alias("ls_mean"), F.try_divide(count(ls & F.col("held")), count(ls)).alias("ls_held"), F.sum(F.when(ls, F.col("pnl"))).alias("ls_pnl"), total(ls & (F.col("stake") > 0), F.col("stake")).alias("ls_staked"),
        F.max("z_profit").alias("z_profit"), count(hours <= rules.timing_hours).alias("late_wins"), F.min(hours).alias("least_hours"), F.max("stake").alias("max_stake"),
        count((F.col("stake") > 0) & (F.col("stake") < rules.decoy_small)).alias("decoys"), count(F.col("stake") >= rules.decoy_real).alias("reals"),
        count(F.col("entry").isNull() | (F.col("entry") <= 1e-4) | (F.col("entry") >= 0.9999)).alias("bad_entries"), count(F.col("stake").isNull() | (F.col("stake") < 0)).alias("bad_stakes"), count(F.col("won").isNull()).alias("no_results"),
        F.count("_staked").alias("staked_bets"), F.max(F.when(F.col("_number") == F.ceil(F.col("_of") / 2), F.col("_staked"))).alias("median_stake"),
    )
    rows = facts.join(groups, "wallet").join(events, "wallet")
    known = None if accounts is None else accounts.withColumn("has_profile", F.lit(True)).select("wallet", *ACCOUNT)
    rows = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in ACCOUNT.items())) if known is None else rows.join(known, "wallet", "left")
    return rows.withColumn("tail", F.when(F.col("ls_groups") >= rules.least_bets, binomial_tail(F.col("ls_groups"), F.col("ls_won"), F.col("ls_p"))))


def dominant_category(bets: DataFrame) -> DataFrame:
    """``wallet, category, n``: the category of most of a wallet's bets; ties by name."""
    n = bets.groupBy("wallet", F.coalesce("category", F.lit("World")).alias("category")).agg(F.count("*").alias("n"))
    return n.groupBy("wallet").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("b")).select("wallet", "b.category", (-F.col("b.m")).alias("n"))


def cheap_screen(bets: DataFrame, longshot: float = 0.35, z: float = 2, stake: float = 2500) -> DataFrame:
    """Bets worth storing: a long shot that won, a bet far above its peers, or a large one at long odds."""
    low = F.col("entry") <= longshot
    return bets.where((F.col("won") & low) | (F.col("z_bet") > z) | ((F.col("stake") >= stake) & low))


def _scored(fires: Column, high: Column, low: Column) -> Column:
    return F.when(fires, clip(high, 0, 1)).otherwise(low)


#: Fixed values in the formulas below: slopes, bounds and starting points of each detector's score.
def detector_columns(r: WalletRules = WalletRules()) -> dict[str, tuple[Column, Column, Column, Column]]:
    """(has data, fires, score, measure) of each detector over a record."""
    c = F.col
    tail = c("tail")
    won = clip((F.log10(F.greatest(tail, F.lit(1e-15))) + 2) / -4, 0, 1)
    z = F.try_divide(c("won_groups") - c("expected"), F.sqrt("variance"))
    cc_data = (c("bets") >= r.least_bets) & (c("groups") >= r.least_bets) & (c("variance") > 0) & (F.try_divide(c("expected"), c("groups")) > 0.35)
    cc = clip((z - 2) / 4, 0, 1) * F.when(z >= 3, 1.0).otherwise(0.6)
    long_base = clip((0.20 - c("ls_mean")) / 0.20, 0, 1)
    long_fires = F.round("ls_mean", 9) <= 0.20  # so that the order of summing decides nothing
    held_fires = c("ls_held") >= 0.9
    rate = F.try_divide(c("ls_won"), c("ls_groups"))
    stake, odds = c("top")["cheap_stake"], clip(F.try_divide(c("top")["cheap_weighted"], c("top")["cheap_stake"]), 1e-4, 1 - 1e-4)
    conv_fires = (stake >= r.conviction_usd) & (odds <= r.conviction_odds)
    time_fires = (c("late_wins") >= 1) & (c("least_hours") <= r.timing_hours)
    purity = F.try_divide(F.greatest(c("yes"), c("staked") - c("yes")), c("staked"))
    conc_fires = (purity >= r.concentration_purity) & (c("staked") >= r.concentration_usd)
    ratio = F.when(c("median_stake") > 0, F.try_divide(c("max_event"), c("median_stake"))).otherwise(0.0)
    size_fires = (ratio >= r.sizing_times) & (c("max_event") >= r.sizing_usd)
    decoy = F.when(c("reals") > 0, F.try_divide(c("decoys"), c("reals")))
    nameless = F.coalesce(c("has_profile") & c("username").isNull() & (c("wins") >= 3), F.lit(False))
    signs = (c("split_ratio") >= r.split_share, decoy >= r.decoy_share, c("cash_out_hours") <= r.fast_cash_out_hours, nameless)
    tactics = sum((F.coalesce(x, F.lit(False)).cast("int") for x in signs), F.lit(0))
    hidden = tactics >= r.least_tactics
    young = (c("age_days") <= r.fresh_days) & (c("prior_tx") == 0)
    linked = c("mean_link") >= r.cluster_link
    quiet, outsized = c("news_count") <= 0, c("max_stake") >= r.outsized_usd
    ahead = c("docs_ahead") >= 1
    profit = clip(c("z_profit") / 8, 0, 1)
    return {
        "won": (c("ls_groups") >= r.least_bets, tail <= r.p_notable, won, tail),
        "crossCat": (cc_data, z >= 3, _scored(z >= 3, 0.45 + 0.55 * cc, clip(0.4 * cc, 0, 0.4)), z),
        "longshot": (c("ls_bets") > 0, long_fires, _scored(long_fires, 0.45 + 0.55 * long_base, clip(0.3 * long_base, 0, 0.4)), c("ls_mean")),
        "held": (c("ls_bets") > 0, held_fires, _scored(held_fires, 0.4 + (c("ls_held") - 0.9) / 0.1 * 0.6, clip(0.4 * c("ls_held"), 0, 0.4)), c("ls_held")),
        "baseline": (c("ls_groups") >= r.least_bets, F.round(rate - c("ls_mean"), 9) > 0.05, clip((F.try_divide(rate, c("ls_mean")) - 1) / 4, 0, 1), rate - c("ls_mean")),
        "profitCross": (c("z_profit").isNotNull(), c("z_profit") >= 2, _scored(c("z_profit") >= 2, 0.45 + 0.55 * profit, clip(0.4 * profit, 0, 0.4)), c("z_profit")),
        "conceal": (c("split_ratio").isNotNull() | decoy.isNotNull() | c("cash_out_hours").isNotNull() | nameless, hidden, _scored(hidden, 0.4 + 0.2 * tactics, clip(0.15 * tactics, 0, 0.39)), tactics.cast("double")),
        "fresh": (c("age_days").isNotNull() & c("prior_tx").isNotNull(), young, F.when(young, clip(1 - c("age_days") / r.fresh_days, 0.5, 1)).otherwise(clip(0.3 * (1 - clip(c("age_days") / 90, 0, 1)), 0, 0.4)), c("age_days")),
        "cluster": (c("mean_link").isNotNull(), linked, clip((c("mean_link") - 0.5) / 0.5, 0, 1), c("mean_link")),
        "newsBlackout": (c("news_count").isNotNull(), quiet & outsized, F.when(quiet & outsized, 0.6).when(quiet, 0.3).otherwise(clip(0.2 - 0.02 * c("news_count"), 0, 0.25)), c("news_count").cast("double")),
        "fedRegister": (c("docs_ahead").isNotNull(), ahead, F.when(ahead, clip(0.4 + 0.06 * F.least(F.lit(3), c("docs_ahead")), 0, 0.6)).otherwise(0.0), c("docs_ahead").cast("double")),
        "conviction": (stake.isNotNull(), conv_fires, _scored(conv_fires, 0.45 + 0.18 * F.log10(F.greatest(F.lit(1.0), stake / r.conviction_usd)) + (r.conviction_odds - odds), clip(stake / r.conviction_usd * 0.3, 0, 0.39)), stake),
        "timing": (c("least_hours").isNotNull(), time_fires, _scored(time_fires, 0.42 + 0.08 * F.least(F.lit(4), c("late_wins")) + (r.timing_hours - c("least_hours")) / r.timing_hours * 0.3, clip(c("late_wins") * 0.18, 0, 0.39)), c("least_hours")),
        "repeat": (c("surprising_events") >= 1, c("surprising_events") >= 2, _scored(c("surprising_events") >= 2, 0.42 + 0.16 * F.least(F.lit(4), c("surprising_events") - 1), F.lit(0.2)), c("surprising_events").cast("double")),
        "concentration": ((c("staked_bets") >= r.concentration_bets) & (c("staked") > 0), conc_fires, _scored(conc_fires, 0.46 + (purity - r.concentration_purity) / (1 - r.concentration_purity) * 0.3 + (F.try_divide(c("max_event"), c("staked")) - 0.5) * 0.2, clip((purity - 0.5) * 0.6, 0, 0.39)), purity),
        "sizing": (c("staked_bets") >= r.sizing_bets, size_fires, _scored(size_fires, 0.46 + 0.14 * F.log10(F.greatest(F.lit(1.0), ratio / r.sizing_times)) + F.least(F.lit(0.2), c("max_event") / r.sizing_usd * 0.02), clip(ratio / r.sizing_times * 0.3, 0, 0.39)), ratio),
    }


def detectors(records_: DataFrame, rules: WalletRules = WalletRules(), which: tuple[str, ...] | None = None) -> DataFrame:
    """``wallet, detector, fires, score, measure``: a row for each detector (of ``which``, or of all) that has data."""
    each = [F.struct(F.lit(k).alias("detector"), F.coalesce(has, F.lit(False)).alias("has"), F.coalesce(fires, F.lit(False)).alias("fires"), score.cast("double").alias("score"), measure.cast("double").alias("measure")) for k, (has, fires, score, measure) in detector_columns(rules).items() if which is None or k in which]
    return records_.select("wallet", F.inline(F.filter(F.array(*each), lambda d: d["has"]))).drop("has")


#: Columns of a fused record.
FUSED = ("wallet", "tier", "agreeing", "n_fired", "fired", "p_value", "p_cross", "contribution")


def fuse(records_: DataFrame, rules: WalletRules = WalletRules(), without: tuple[str, ...] = ("newsBlackout", "fedRegister"), keep: bool = False) -> DataFrame:
    """``wallet, tier, agreeing, n_fired, fired, p_value, p_cross, contribution``: which detectors fire and what they say together.

    contribution maps a fired detector to its share of the fired weights. A projection: no exchange. News and
    documents are looked up for flagged wallets only, so they are ``without`` the first verdict. ``keep``: with the record's own columns.
    """
    columns = {k: v for k, v in detector_columns(rules).items() if k not in without}
    wide = records_
    for k, (has, fires, score, measure) in columns.items():
        ok = F.coalesce(has, F.lit(False))
        wide = wide.withColumns({f"f_{k}": ok & F.coalesce(fires, F.lit(False)), f"s_{k}": score, f"m_{k}": F.when(ok, measure)})
    names = [k for k in rules.weights if k in columns]
    fired = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"f_{k}").alias("on"), F.col(f"s_{k}").cast("double").alias("score"), F.lit(rules.weights[k]).alias("w")) for k in names)), lambda d: d["on"])
    wide = wide.withColumn("_fired", fired)
    weight = F.aggregate("_fired", F.lit(0), lambda s, d: s + d["w"])
    p, cross = F.col("m_won"), F.when(F.col("f_crossCat"), F.greatest(upper_tail(F.greatest(F.col("m_crossCat"), F.lit(0.0))), F.lit(1e-15)))
    wide = wide.withColumns({"agreeing": F.size(F.filter("_fired", lambda d: d["score"] >= rules.agree_score)), "n_fired": F.size("_fired"), "p_value": p, "p_cross": cross, "_w": weight})
    agree = F.col("agreeing") >= rules.least_agree
    tier = (
        F.when(agree & (F.col("p_value") <= rules.p_extreme), "extreme").when(agree & (F.col("p_value") <= rules.p_high), "high")
        .when(agree & (F.col("p_cross") <= rules.p_high), "high").when(agree & F.col("f_conviction"), "high")
        .when((F.col("n_fired") > 0) & (F.col("p_value").isNull() | (F.col("p_value") <= rules.p_notable) | (F.col("p_cross") <= rules.p_notable)), "notable")
        .otherwise("unflagged")
    )
    share = F.map_from_entries(F.transform("_fired", lambda d: F.struct(d["key"], F.floor(100 * d["w"] / F.col("_w") + 0.5).cast("int"))))
    own = [c for c in records_.columns if keep and c != "wallet"]
    return wide.select("wallet", tier.alias("tier"), "agreeing", "n_fired", F.transform("_fired", lambda d: d["key"]).alias("fired"), "p_value", "p_cross", share.alias("contribution"), *own)


def episodes(bets: DataFrame, least_profit: float = 250, most_odds: float = 0.90) -> DataFrame:
    """The best retained episode of each wallet by S = 30 z_profit + 25 z_bet + 20 z_within + 15 late + 10 directional."""
    stake = F.when(F.col("stake") > 0, F.col("stake"))
    w = Window.partitionBy("wallet")
    own = bets.withColumns({"_mean": F.avg(stake).over(w), "_sd": F.stddev_samp(stake).over(w)})
    within = F.when(F.col("_sd") > 0, F.try_divide(F.col("stake") - F.col("_mean"), F.col("_sd"))).otherwise(0.0)
    scored = own.withColumn("z_within", within).where(F.col("z_bet").isNotNull() & (F.col("pnl") >= least_profit) & (F.col("entry") <= most_odds))
    s = 30 * F.coalesce("z_profit", F.lit(0.0)) + 25 * F.col("z_bet") + 20 * F.col("z_within") + 15 * F.col("late") + 10 * F.col("directional")
    kept = scored.withColumn("s", s).where(((F.col("z_bet") > 2) | (F.col("z_within") > 2)) & F.col("won") & (F.col("z_profit") > 0))
    best = kept.groupBy("wallet").agg(F.max(F.struct("s", -F.col("cond"), "pnl", "entry", "stake")).alias("b"), F.count("*").alias("retained"))
    tier = F.when(F.col("b.s") >= 1110, "extreme").when(F.col("b.s") >= 810, "high").when(F.col("b.s") >= 530, "notable")
    return best.select("wallet", F.col("b.s").alias("s"), (-F.col("b.col2")).alias("cond"), F.col("b.pnl").alias("pnl"), F.col("b.entry").alias("entry"), F.col("b.stake").alias("stake"), "retained", tier.alias("tier"))


def false_discovery_cut(p_values: DataFrame, q: float = 0.05, least: int = 500, ceiling: float = 0.01) -> DataFrame:
    """One row ``m, cut``: the largest p with p <= rank/m q (Benjamini-Hochberg), at most ``ceiling``; 1 if m < least.

    Equal p-values share the last of their ranks. Null p-values are left out.
    """
    ranked = counted_ranks(p_values, "p")
    able = (F.col("p") <= q) & (F.col("p") <= (F.col("below") + F.col("n")) / F.col("total") * q)
    found = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"), F.max(F.when(able, F.col("p"))).alias("best"))
    return found.select("m", F.when(F.col("m") < least, 1.0).otherwise(F.least(F.lit(ceiling), F.coalesce("best", F.lit(0.0)))).alias("cut"))


def percentile(population: DataFrame, value: str, top: float = 99.999) -> DataFrame:
    """``population`` with ``percentile``: 100 x the share of rows below, at most ``top``; null values have none."""
    ranked = counted_ranks(population.select(F.col(value).alias("_v")), "_v")
    ranked = ranked.select("_v", F.least(F.lit(top), 100 * F.col("below") / F.col("total")).alias("percentile"))
    return population.join(ranked, F.col(value) == F.col("_v"), "left").drop("_v")


def rank_percentile(subjects: DataFrame, value: str) -> DataFrame:
    """``subjects`` with ``percentile``: 100 (n-1-i)/(n-1) for the i-th from the top; equal values share the best place; 99.9 if alone."""
    ranked = counted_ranks(subjects.select(F.col(value).alias("_v")), "_v")
    place = F.when(F.col("total") > 1, 100 * (F.col("below") + F.col("n") - 1) / (F.col("total") - 1)).otherwise(99.9)
    return subjects.join(ranked.select("_v", place.alias("percentile")), F.col(value) == F.col("_v"), "left").drop("_v")
