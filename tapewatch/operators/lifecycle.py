"""State that is carried from run to run: upserts, cumulative ledgers, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_wins(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Union by key in which a current row replaces the previous one; rows that repeat a key keep one."""
    both = previous.withColumn("_new", F.lit(0)).unionByName(current.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in key]
    best = both.groupBy(*key).agg(F.max(F.struct("_new", *rest)).alias("_b"))
    return best.select(*key, *(F.col("_b")[c].alias(c) for c in rest))


def reconcile_bets(trades: DataFrame, feed: DataFrame, key: tuple[str, ...] = ("wallet", "cond")) -> DataFrame:
    """Full outer join of bets from trades and from a position feed: the feed's profit wins, its result where it has one."""
    t, f = trades.alias("t"), feed.alias("f")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    joined = t.join(f, on, "full_outer")
    first = lambda c, a, b: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    source = F.when(F.col(f"f.{key[0]}").isNull(), "trades").when(F.col(f"t.{key[0]}").isNull(), "feed").otherwise("both")
    return joined.select(*(first(k, "t", "f") for k in key), first("stake", "t", "f"), first("pnl", "f", "t"), first("won", "f", "t"), first("tx", "f", "t"), source.alias("source"))


def queue_upsert(previous: DataFrame, scanned: DataFrame, now: int, retire_after: int = 14 * 86_400) -> DataFrame:
    """Watch queue by (engine, market): ``first_seen, last_scanned, tier, score, status, change``.

    change: appear, tier, same, or retire for markets not scanned for ``retire_after`` seconds.
    """
    p, s = previous.alias("p"), scanned.alias("s")
    seen = F.col("s.market").isNotNull()
    last = F.when(seen, F.lit(now)).otherwise(F.col("p.last_scanned"))
    old = ~seen & (F.lit(now) - F.col("p.last_scanned") > retire_after)
    change = F.when(F.col("p.market").isNull(), "appear").when(seen & ~F.col("p.tier").eqNullSafe(F.col("s.tier")), "tier").when(old & (F.col("p.status") != "retired"), "retire").otherwise("same")
    return p.join(s, (F.col("p.engine") == F.col("s.engine")) & (F.col("p.market") == F.col("s.market")), "full_outer").select(
        F.coalesce("p.engine", "s.engine").alias("engine"), F.coalesce("p.market", "s.market").alias("market"),
        F.coalesce("p.first_seen", F.lit(now)).alias("first_seen"), last.alias("last_scanned"), F.coalesce("s.tier", "p.tier").alias("tier"),
        F.coalesce("s.score", "p.score").alias("score"), F.when(seen, "active").when(old, "retired").otherwise(F.col("p.status")).alias("status"), change.alias("change"),
    )


def audit(queue: DataFrame) -> DataFrame:
    """One audit row for each queue row that changed."""
    return queue.where(F.col("change") != "same").select(F.col("last_scanned").alias("ts"), "engine", "market", F.col("change").alias("type"), "tier")


def new_alerts(queue: DataFrame, sent: DataFrame, tiers: tuple[str, ...] = ("High-signal", "Elevated")) -> DataFrame:
    """Rows of a flagged tier that no alert was sent for."""
    return queue.where(F.col("tier").isin(*tiers)).join(sent.select("engine", "market"), ["engine", "market"], "left_anti")


def set_key(addresses: Column) -> Column:
    """The identity of a set of addresses: lower case, each once, in order; null for an empty set."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(addresses, F.lower), lambda a: a.isNotNull() & (a != ""))))
    return F.when(F.size(clean) > 0, F.array_join(clean, ","))


def keyed_subjects(subjects: DataFrame) -> DataFrame:
    """``subjects`` (``addresses, profit, run, rejected``) with ``key`` and clean ``addresses``: the same set is the same subject in any order or case.
    A set that gained or lost a member is another subject; subjects without an address are left out."""
    key = set_key(F.col("addresses"))
    return subjects.withColumn("key", key).where("key is not null").withColumn("addresses", F.split("key", ","))


def cumulative_ledger(subjects: DataFrame) -> DataFrame:
    """``address, profit``: pooled profit of each run's subjects (``key, addresses, profit, run, rejected``), the newest
    run of a subject winning and rejected ones left out; a cluster's profit is shared by its members."""
    best = subjects.groupBy("key").agg(F.max(F.struct("run", "profit", "addresses", "rejected")).alias("b")).select("b.*").where("not rejected")
    return best.select(F.explode("addresses").alias("address"), (F.col("profit") / F.size("addresses")).alias("profit")).groupBy("address").agg(F.sum("profit").alias("profit"))


def retained(wallets: DataFrame, keep: int) -> DataFrame:
    """Wallets that stay in the pool: protected ones, then the ``keep`` of most signal.

    signal = max(largest stake, largest event stake) + 750 wins + 50 bets.
    """
    signal = F.greatest("max_stake", "max_event") + 750 * F.col("wins") + 50 * F.col("bets")
    scored = wallets.withColumn("signal", signal)
    top = scored.where(~F.col("protected")).orderBy(F.desc("signal"), "wallet").limit(keep)
    return scored.where("protected").unionByName(top)


def newest(rows: DataFrame, by: str, key: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows, ties by key."""
    return rows.orderBy(F.desc(by), key).limit(keep)


def rolling_history(previous: DataFrame, fresh: DataFrame, keep: int = 250) -> DataFrame:
    """Newest first, each id once, at most ``keep`` rows."""
    return fresh.unionByName(previous.join(fresh.select("id"), "id", "left_anti")).orderBy(F.desc("ts"), "id").limit(keep)


def top_per_group(rows: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """The first ``keep`` rows of each group; ``order`` must settle ties."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def staleness(queue: DataFrame, now: int, window: int = 6 * 3600) -> DataFrame:
    """One row: ``oldest`` age in seconds, rows scanned within the window, rows by status."""
    age = F.lit(now) - F.col("last_scanned")
    return queue.agg(F.max(age).alias("oldest"), F.count_if(age <= window).alias("fresh"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "retired").alias("retired"))


def lookup_merge(feed: DataFrame, trades: DataFrame, key: tuple[str, ...] = ("cond", "outcome")) -> DataFrame:
    """One row a key: the feed's bet where it has one, with gaps (and the transaction) filled from the trades' bet."""
    rest = [c for c in feed.columns if c not in key]
    f, t = feed.alias("f"), trades.alias("t")
    joined = f.join(t, [F.col(f"f.{k}") == F.col(f"t.{k}") for k in key], "full_outer")
    return joined.select(*(F.coalesce(F.col(f"f.{c}"), F.col(f"t.{c}")).alias(c) for c in (*key, *rest)))


def backfilled(bets: DataFrame, trades: DataFrame) -> DataFrame:
    """``bets`` with ``tx`` where it is missing: that of the wallet's own earliest buy of the same market and outcome, else of the same market."""
    own = trades.where("side = 'BUY' and tx is not null").groupBy("wallet", "cond", "outcome").agg(F.min(F.struct("ts", "tx")).alias("_own"))
    first = own.groupBy("wallet", "cond").agg(F.min("_own").alias("_near"))
    joined = bets.join(own, ["wallet", "cond", "outcome"], "left").join(first, ["wallet", "cond"], "left")
    return joined.withColumn("tx", F.coalesce("tx", "_own.tx", "_near.tx")).drop("_own", "_near")


def accumulated(stored: DataFrame, fresh: DataFrame, key: tuple[str, ...] = ("wallet", "cond", "outcome")) -> DataFrame:
    """Bets by key from the store and a new batch (``stake, z, pnl, from_feed, ts``): the larger stake's row, a z from either, a feed's profit
    before any other, the earliest time."""
    return merged_bets(stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))), key)


def merged_bets(both: DataFrame, key: tuple[str, ...] = ("wallet", "cond", "outcome")) -> DataFrame:
    """The same of rows of both, told apart by ``_new``: 0 in the store, 1 in the batch."""
    larger = F.struct("stake", "_new")
    profit = F.coalesce(F.max_by("pnl", F.when(F.col("from_feed"), larger)), F.max_by("pnl", larger))
    return both.groupBy(*key).agg(F.max("stake").alias("stake"), F.coalesce(F.max_by("z", F.when(F.col("z").isNotNull(), larger))).alias("z"), profit.alias("pnl"), F.bool_or("from_feed").alias("from_feed"), F.min("ts").alias("ts"))


def capped_queue(queue: DataFrame, keep: int = 5000) -> DataFrame:
    """The queue's cap: the stalest retired rows go first, then the stalest active ones."""
    return queue.orderBy(F.when(F.col("status") == "retired", 1).otherwise(0), F.desc("last_scanned"), "engine", "market").limit(keep)


def first_flagged(history: DataFrame, current: DataFrame, now: int, fresh: int = 86_400) -> DataFrame:
    """``wallet, first_flagged, newly, archived``: when each wallet was first flagged; archived if it isn't flagged now."""
    both = history.select("wallet", "first_flagged", F.lit(False).alias("now")).unionByName(current.select("wallet", F.lit(now).cast("long").alias("first_flagged"), F.lit(True).alias("now")))
    found = both.groupBy("wallet").agg(F.min("first_flagged").alias("first_flagged"), F.bool_or("now").alias("seen"))
    return found.select("wallet", "first_flagged", (F.lit(now) - F.col("first_flagged") <= fresh).alias("newly"), (~F.col("seen")).alias("archived"))


def lean(bets: DataFrame) -> DataFrame:
    """What the store keeps of a bet."""
    return bets.select("wallet", "cond", "outcome", "entry", "stake", "pnl", "won", "held", "ts", "tx")


def hydrated(bets: DataFrame, catalog: DataFrame, empty: str = "(market)") -> DataFrame:
    """``bets`` with ``question``: their own, else the catalogue's, else a placeholder."""
    known = catalog.select("cond", F.col("question").alias("_asked"))
    return bets.join(known, "cond", "left").withColumn("question", F.coalesce(F.nullif("question", F.lit(empty)), "_asked", F.lit(empty))).drop("_asked")


def holders(balances: DataFrame) -> DataFrame:
    """``market, wallet, balance``: balances summed over a market's tokens."""
    return balances.groupBy("market", "wallet").agg(F.sum("amount").alias("balance")).where("balance > 0")


def attribution(rows: DataFrame) -> DataFrame:
    """``role, n, notional``: how a wallet's raw rows name it: as proxy, maker or taker."""
    role = F.when(F.col("proxy") == F.col("wallet"), "proxy").when(F.col("maker") == F.col("wallet"), "maker").when(F.col("taker") == F.col("wallet"), "taker").otherwise("other")
    return rows.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.sum("notional").alias("notional"))
