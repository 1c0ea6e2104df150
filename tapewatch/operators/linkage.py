"""Links between wallets: pairs in a funder's bucket, their components, conduct of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import clip

#: Weights of shared funder, shared events, synchronised entry, creation in time.
LINK = (0.40, 0.25, 0.20, 0.15)


def funder_pairs(wallets: DataFrame, entries: DataFrame, least: int = 2, most: int = 500, sync: int = 900, near: int = 2 * 86_400) -> DataFrame:
    """``a, b, funder, shared, co_spend, sync, near, link, type`` of each pair in a bucket of ``least`` to ``most`` wallets.

    ``wallets``: ``wallet, funder, first_seen_ts``; ``entries``: ``wallet, event_group, ts``, of which a wallet's first counts. Larger
    buckets are exchanges and the like, which say nothing: that is the rule, not a limit of the engine. Entries meet by
    (funder, event), so a popular event makes no pairs of its own and no wallet's history is held as a whole.
    """
    sizes = wallets.where(F.col("funder").isNotNull()).groupBy("funder").agg(F.count("*").alias("size"))
    rows = wallets.join(sizes.where(F.col("size").between(least, most)).select("funder"), "funder").select("funder", "wallet", "first_seen_ts")
    firsts = entries.groupBy("wallet", "event_group").agg(F.min("ts").alias("ts"))
    counts = firsts.groupBy("wallet").agg(F.count("*").alias("events"))
    sized = rows.join(counts, "wallet", "left")
    side = lambda df, x, on: df.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in on))
    pairs = side(sized, "a", ["funder"]).join(side(sized, "b", ["funder"]), "funder").where("wallet_a < wallet_b")
    entered = rows.select("funder", "wallet").join(firsts, "wallet")
    met = side(entered, "a", ["funder", "event_group"]).join(side(entered, "b", ["funder", "event_group"]), ["funder", "event_group"]).where("wallet_a < wallet_b")
    met = met.groupBy("funder", "wallet_a", "wallet_b").agg(F.count("*").cast("int").alias("shared"), F.count_if(F.abs(F.col("ts_a") - F.col("ts_b")) <= sync).alias("together"))
    pairs = pairs.join(met, ["funder", "wallet_a", "wallet_b"], "left").fillna(0, ["shared", "together", "events_a", "events_b"])
    union = F.col("events_a") + F.col("events_b") - F.col("shared")
    apart = F.abs(F.col("first_seen_ts_a") - F.col("first_seen_ts_b"))
    pairs = pairs.withColumns({"co_spend": F.when(union > 0, F.col("shared") / union).otherwise(0.0), "sync": F.when(F.col("shared") > 0, F.col("together") / F.col("shared")).otherwise(0.0), "near": F.when(apart <= near, 1 - apart / near).otherwise(0.0)})
    link = clip(LINK[0] + LINK[1] * F.col("co_spend") + LINK[2] * F.col("sync") + LINK[3] * F.coalesce("near", F.lit(0.0)), 0, 1)
    kind = F.when(LINK[0] >= F.greatest(LINK[2] * F.col("sync"), LINK[3] * F.col("near")), "fund").when(LINK[2] * F.col("sync") >= LINK[3] * F.col("near"), "sync").otherwise("create")
    return pairs.select(F.col("wallet_a").alias("a"), F.col("wallet_b").alias("b"), "funder", "shared", "co_spend", "sync", F.coalesce("near", F.lit(0.0)).alias("near"), link.alias("link"), kind.alias("type"))


def corroborated_rings(pairs: DataFrame, betting: DataFrame, co_spend: float = 0.05, sync: float = 0.3, near: float = 0.5) -> DataFrame:
    """``funder, members, edges, mean_link, best`` of rings whose betting members (``funder, wallet``) do more than share a funder.

    Three of them are enough; two need a pair that bets the same events, enters together or was created together.
    """
    sizes = betting.groupBy("funder").agg(F.count_distinct("wallet").alias("members"))
    found = pairs.groupBy("funder").agg(F.count("*").alias("edges"), F.avg("link").alias("mean_link"), F.max("link").alias("best"), F.max("co_spend").alias("c"), F.max("sync").alias("s"), F.max("near").alias("n"))
    rows = sizes.where("members >= 2").join(found, "funder")
    return rows.where((F.col("members") >= 3) | (F.col("c") >= co_spend) | (F.col("s") >= sync) | (F.col("n") >= near)).select("funder", "members", "edges", "mean_link", "best")


def flagged_rings(members: DataFrame, tiers: DataFrame, keep: int = 30) -> DataFrame:
    """``funder, size, flagged, worst`` of rings (``funder, wallet``) that touch a flagged wallet (``wallet, tier``), most flagged first; a report of ``keep``."""
    order = F.when(F.col("tier") == "extreme", 0).when(F.col("tier") == "elevated", 1).otherwise(2)
    found = members.join(tiers, "wallet", "left").groupBy("funder").agg(F.count("*").alias("size"), F.count("tier").alias("flagged"), F.min_by("tier", F.when(F.col("tier").isNotNull(), order)).alias("worst"))
    return found.where("flagged >= 1").orderBy(F.desc("flagged"), F.desc("size"), "funder").limit(keep)


def top_edges(pairs: DataFrame, sizes: DataFrame, more: int = 4) -> DataFrame:
    """The strongest edges of each ring, as many as it has members and ``more``."""
    rows = pairs.join(sizes.select("funder", "members"), "funder").withColumn("r", F.row_number().over(Window.partitionBy("funder").orderBy(F.desc(F.round("link", 9)), "a", "b")))
    return rows.where(F.col("r") <= F.col("members") + more).select("funder", "a", "b", "link")


def cluster_aggregate(members: DataFrame, bets: DataFrame, wallets: DataFrame) -> DataFrame:
    """``funder, members, bets, stake, pnl, first_ts, created_ts, untouched``: a ring as one trader; untouched if no member sent anything before.

    ``bets``: ``wallet, stake, pnl, ts``; ``wallets``: ``wallet, first_seen_ts, prior_tx``.
    """
    own = members.select("funder", "wallet").distinct()
    traded = own.join(bets.select("wallet", "stake", "pnl", "ts"), "wallet").groupBy("funder").agg(F.count("*").alias("bets"), F.sum("stake").alias("stake"), F.sum("pnl").alias("pnl"), F.min("ts").alias("first_ts"))
    made = own.join(wallets.select("wallet", "first_seen_ts", "prior_tx"), "wallet").groupBy("funder").agg(F.count("*").alias("members"), F.min("first_seen_ts").alias("created_ts"), F.every(F.coalesce(F.col("prior_tx") == 0, F.lit(False))).alias("untouched"))
    return made.join(traded, "funder").select("funder", "members", "bets", "stake", "pnl", "first_ts", "created_ts", "untouched")


def components(edges: DataFrame, folder: str, rounds: int = 40) -> DataFrame:
    """``node, component`` over edges ``a, b``: least labels are passed along edges until none changes.

    Each round is written under ``folder`` (a place that all executors see) and read again, so a lost
    executor costs one round at most. Labels also jump to their label's label, so chains halve each round.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = kept(both, "links")
    labels = kept(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels0")
    for k in range(1, rounds):
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        top = step.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        new = kept(step.join(top, step["component"] == top["at"], "left").select("node", F.least("component", F.coalesce("jump", "component")).alias("component"), "old"), f"labels{k}")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def clusters(edges: DataFrame, members: DataFrame, least: float = 0.80) -> DataFrame:
    """``component, members, edges, mean_link`` of components whose mean link is ``least`` or more."""
    inside = edges.join(members, edges["a"] == members["node"]).groupBy("component").agg(F.count("*").alias("edges"), F.avg("link").alias("mean_link"))
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    return inside.where(F.col("mean_link") >= least).join(sizes, "component").select("component", "members", "edges", "mean_link")


def split_ratio(members: DataFrame, entries: DataFrame) -> DataFrame:
    """``component, split_ratio``: part of a component's events that two members or more entered."""
    per = entries.join(members, entries["wallet"] == members["node"]).groupBy("component", "event_group").agg(F.count_distinct("wallet").alias("n"))
    return per.groupBy("component").agg((F.count_if(F.col("n") >= 2) / F.count("*")).alias("split_ratio"))


def first_funding(transfers: DataFrame, labels: DataFrame) -> DataFrame:
    """``wallet, funder, funding_ts, label``: first inbound transfer and, if known, the exchange it came from."""
    first = transfers.groupBy(F.col("to").alias("wallet")).agg(F.min_by("from", F.struct("ts", "from")).alias("funder"), F.min("ts").alias("funding_ts"))
    return first.join(labels, first["funder"] == labels["address"], "left").select("wallet", "funder", "funding_ts", "label")


def prior_transactions(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """``wallet, prior_tx``: transfers that a wallet sent before its first bet (all of them if that is unknown)."""
    sent = transfers.join(wallets.select("wallet", "first_bet_ts"), transfers["from"] == wallets["wallet"])
    return sent.groupBy("wallet").agg(F.count_if(F.col("first_bet_ts").isNull() | (F.col("ts") < F.col("first_bet_ts"))).alias("prior_tx"))


def cash_out(transfers: DataFrame, resolved: DataFrame) -> DataFrame:
    """``wallet, hours``: from a wallet's last resolution to its first transfer out after it."""
    out = transfers.join(resolved, transfers["from"] == resolved["wallet"]).where(F.col("ts") >= F.col("resolved_ts"))
    return out.groupBy("wallet").agg(((F.min("ts") - F.min("resolved_ts")) / 3600).alias("hours"))
