"""The watchlist as a stream: bets, resolutions and timers in a state of each market's share of wallets.

A market's wallets are dealt into ``PARTS`` groups, and each of its resolutions goes to all of them, so a busy market is
no single task. State holds the raw signals of each bet; scores and statuses are columns of what comes out, so they
follow the rules and the flags of the day without any state being rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewatch.operators.watchlist import DAY, HOUR, RULES, STORED, Rules, outsized, rescored

PARTS, SLOTS = 16, 64
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BET = "outcome string, price double, usd double, ts long, size_z double, whale_x double, vol_share double, peers long, flagged boolean, fresh boolean, blackout boolean, anticipated boolean, public_info boolean"
_TYPES = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
#: bets as a slot of the state holds them
_ROWS = pa.schema([("wallet", pa.string()), *((name, _TYPES[kind]) for name, kind in map(str.split, _BET.split(", ")))])
#: pandas' own numbers and flags have no nulls
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}
OUT = f"cond long, wallet string, {_BET}, event string, won boolean, resolved_ts long, at timestamp"


class Lifecycle(StatefulProcessor):
    """Bets of one market and part: listed once, resolved once, gone by a timer.

    A resolution that comes before its bets is kept; of two for one market the first stays. A bet's time ends with the
    day in which it is ``keep`` old, or its market was resolved ``keep_resolved`` ago. One timer rings for the earliest
    such day of all bets, takes all that are over by the watermark, and is set again for the rest.

    Bets lie in ``SLOTS`` slots by their wallet, each a batch of Arrow: a call to the state costs far more than a
    row, so a slot's bets come and go in one. ``most`` rows or a slot more are held at a time on the way out.
    """

    def __init__(self, rules: Rules = RULES, most: int = 10_000):
        self.rules, self.most = rules, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bets = handle.getMapState("slots", "slot int", "rows binary")
        self.end = handle.getValueState("end", "winner string, ts long")
        self.next = handle.getValueState("next", "at long")

    def _slot(self, slot: int) -> pa.Table | None:
        held = self.bets.getValue((slot,))
        return None if held is None else pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(held[0])), _ROWS)])

    def _put(self, slot: int, bets: pa.Table) -> None:
        self.bets.updateValue((slot,), (bets.combine_chunks().to_batches()[0].serialize().to_pybytes(),))

    def _slots(self) -> list[int]:
        return sorted(k[0] for k in self.bets.keys()) if self.bets.exists() else []

    def _added(self, asked: pd.DataFrame) -> pa.Table:
        """Puts bets into their slots; those that weren't there."""
        asked = asked.sort_values(["ts", "wallet"]).drop_duplicates("wallet").sort_values("slot", kind="stable")
        slots, bets, known = asked["slot"].to_numpy("int64"), pa.Table.from_pandas(asked, schema=_ROWS, preserve_index=False), self.bets.exists()
        found = [_ROWS.empty_table()]
        for slot in map(int, np.unique(slots)):
            at, to = np.searchsorted(slots, [slot, slot + 1])
            new, old = bets.slice(at, to - at), self._slot(slot) if known else None
            if old is not None:
                new = new.filter(pc.invert(pc.is_in(new["wallet"], value_set=old["wallet"])))
            if len(new):
                self._put(slot, new if old is None else pa.concat_tables([old, new]))
                found.append(new)
        return pa.concat_tables(found)

    def _rows(self, cond: int, bets: pa.Table, event: str, at: int) -> pd.DataFrame:
        end = self.end.get() if event != "listed" and self.end.exists() else None
        out = bets.to_pandas(types_mapper=_NULLABLE.get)
        out.insert(0, "cond", cond)
        won = pd.NA if end is None else out["outcome"].str.upper() == end[0].upper()
        out = out.assign(event=event, won=won, resolved_ts=pd.NA if end is None else end[1], at=pd.Timestamp(at, unit="s"))
        return out.astype({"resolved_ts": "Int64", "won": "boolean"})

    def _gathered(self, tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        """Few large tables of many small ones."""
        held, n = [], 0
        for bets in tables:
            held, n = [*held, bets], n + len(bets)
            if n >= self.most:
                yield pa.concat_tables(held)
                held, n = [], 0
        if n:
            yield pa.concat_tables(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        cond, oldest = int(key[0]), []
        ends = every[every["winner"].notna()].sort_values("at")
        new = self._added(every[every["winner"].isna()])
        if len(new):
            oldest.append(pc.min(new["ts"]).as_py())
            yield self._rows(cond, new, "listed", pc.max(new["ts"]).as_py())
        first = len(ends) and not self.end.exists()
        if first:
            end = ends.iloc[0]
            self.end.update((str(end["winner"]), int(end["at"].timestamp())))
        # a resolution meets all bets that are there; bets after it are resolved at once
        resolved = self._gathered(map(self._slot, self._slots())) if first else [new] if len(new) and self.end.exists() else []
        for bets in resolved:
            oldest.append(pc.min(bets["ts"]).as_py())
            yield self._rows(cond, bets, "resolved", self.end.get()[1])
        self._wake(oldest)

    @staticmethod
    def _day(at):
        return -(-at // DAY) * DAY

    def _closed(self) -> int | None:
        """The day that a resolved market's time ends with."""
        return self._day(self.end.get()[1] + self.rules.keep_resolved) if self.end.exists() else None

    def _wake(self, oldest: list[int]) -> None:
        """Sets the timer for the first of the bets of these times whose time ends, unless it rings earlier anyway."""
        if not oldest:
            return
        day, closed = self._day(min(oldest) + self.rules.keep), self._closed()
        day = day if closed is None else min(day, closed)
        pending = self.next.get()[0] if self.next.exists() else None
        if pending is None or day < pending:
            if pending is not None:
                self.handle.deleteTimer(pending * 1000)
            self.handle.registerTimer(day * 1000)
            self.next.update((day,))

    def _taken(self, now: int, left: list[int]) -> Iterator[pa.Table]:
        """Takes what is over out of each slot; ``left`` gets the earliest time of what stays."""
        closed = self._closed()
        for slot in self._slots():
            bets = self._slot(slot)
            over = self._day(bets["ts"].to_numpy() + self.rules.keep) <= now
            if over.all() or (closed is not None and closed <= now):
                self.bets.removeKey((slot,))
                yield bets
                continue
            rest = bets.filter(pa.array(~over))
            left.append(pc.min(rest["ts"]).as_py())
            if over.any():
                self._put(slot, rest)
                yield bets.filter(pa.array(over))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs() // 1000, []
        self.next.clear()
        for over in self._gathered(self._taken(now, left)):
            yield self._rows(int(key[0]), over, "retired", now)
        self._wake(left)

    def close(self) -> None:
        pass


def lifecycle(bets: DataFrame, resolutions: DataFrame, rules: Rules = RULES, parts: int = PARTS) -> DataFrame:
    """What happens to bets: one row for each listing, resolution and retirement (``event``), with the bet's stored signals.

    ``bets`` is a stream of ``STORED`` with the event time ``at``, ``resolutions`` one of ``cond, winner, at``; both carry watermarks.
    Only bets that reach the bar under ``rules`` are listed. The session must use the RocksDB state store (``STORE``).
    """
    part, slot = F.pmod(F.xxhash64("wallet"), F.lit(parts)), F.pmod(F.xxhash64(F.lit(1), "wallet"), F.lit(SLOTS)).cast("int")
    asked = rescored(bets, rules).where(F.col("score") >= rules.list_at).select(*STORED, "at", part.alias("part"), F.lit(None).cast("string").alias("winner"), slot.alias("slot"))
    empty = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in (*STORED, "slot") if c != "cond"]
    ends = resolutions.select("cond", *empty, "at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "winner")
    both = asked.unionByName(ends)
    return both.groupBy("cond", "part").transformWithStateInPandas(Lifecycle(rules), OUT, "Append", "EventTime")


def judged(events: DataFrame, flagged: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``events`` of ``lifecycle`` with ``score``, ``signals`` and ``status`` under the flags and rules of now; ``flagged`` is a table of ``wallet``.

    A bet that won is promoted if its wallet is flagged and its score strong, else cleared; one that a new
    score brings under the bar is pruned.
    """
    known = flagged.select("wallet", F.lit(True).alias("_flag")).distinct()
    rows = events.join(known, "wallet", "left").withColumn("flagged", F.coalesce("_flag", F.lit(False))).drop("_flag")
    scored = rescored(rows, rules)
    strong = F.coalesce(F.col("won"), F.lit(False)) & F.col("flagged") & (F.col("score") >= rules.promote_at)
    status = F.when(F.col("won").isNull(), "watching").when(strong, "promoted").otherwise("cleared")
    return scored.withColumns({"status": status, "pruned": (status != "promoted") & (F.col("score") < rules.list_at)})


class PeerTables:
    """For foreachBatch: figures of each market's sizes, carried from batch to batch, and the bets scored by them.

    ``markets`` holds counts, sums, squares and a KLL sketch of the sizes of all buys so far; ``hours`` the dollars of the last
    hours. Each batch writes the next version of both, which it makes of the version before and its own trades; a batch that
    runs again replaces its own. A bet's peers are the market's buys up to the end of its batch.
    """

    def __init__(self, folder: str, versions: Callable[[SparkSession, str, int | None], int | None], rules: Rules = RULES, rank: float = 0.9, size: int = 400):
        self.folder, self.versions, self.rules, self.rank, self.size = folder, versions, rules, rank, size

    def _last(self, spark: SparkSession, name: str, number: int) -> DataFrame | None:
        last = self.versions(spark, f"{self.folder}/{name}", number)
        return None if last is None else spark.read.parquet(f"{self.folder}/{name}/version={last}")

    def __call__(self, trades: DataFrame, number: int) -> None:
        spark, usd = trades.sparkSession, F.col("usd")
        buys = trades.where("side <> 'SELL' and usd > 0")
        new = buys.groupBy("cond").agg(F.count("*").alias("n"), F.sum("usd").alias("total"), F.sum(usd * usd).alias("squares"), F.kll_sketch_agg_double("usd", self.size).alias("sketch"))
        old = self._last(spark, "markets", number)
        both = new if old is None else old.unionByName(new)
        at = f"{self.folder}/markets/version={number}"
        both.groupBy("cond").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.kll_merge_agg_double("sketch", self.size).alias("sketch")).write.mode("overwrite").parquet(at)
        hours = trades.groupBy("cond", F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.sum("usd").alias("usd"))
        before = self._last(spark, "hours", number)
        sums = (hours if before is None else before.unionByName(hours)).groupBy("cond", "hour").agg(F.sum("usd").alias("usd"))
        # a day, and a day for late trades, before the newest hour is carried on
        newest = sums.agg(F.max("hour").alias("_newest"))
        kept = sums.join(F.broadcast(newest), F.col("hour") > F.col("_newest") - 2 * (DAY // HOUR)).drop("_newest")
        kept.write.mode("overwrite").parquet(f"{self.folder}/hours/version={number}")
        self._scored(buys, spark.read.parquet(at), sums).write.mode("overwrite").parquet(f"{self.folder}/scored/version={number}")

    def _scored(self, buys: DataFrame, markets: DataFrame, hours: DataFrame) -> DataFrame:
        rules, usd = self.rules, F.col("usd")
        bets = buys.where(usd >= rules.bet_usd).select("cond", "wallet", "outcome", "price", "usd", "ts", F.floor(F.col("ts") / HOUR).alias("hour"))
        asked = bets.select("cond", "hour").distinct().withColumn("_h", F.explode(F.sequence(F.col("hour") - 23, F.col("hour"))))
        volume = asked.join(hours.select("cond", F.col("hour").alias("_h"), F.col("usd").alias("_usd")), ["cond", "_h"]).groupBy("cond", "hour").agg(F.sum("_usd").alias("volume"))
        n = F.col("n") - 1
        mean = F.when(n > 0, (F.col("total") - usd) / n)
        sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - usd * usd - n * mean * mean) / (n - 1))))
        p90 = F.kll_sketch_get_quantile_double("sketch", F.lit(self.rank))
        rows = bets.join(markets.withColumn("p90", p90), "cond").join(volume, ["cond", "hour"])
        out = rows.select("cond", "wallet", "outcome", "price", "usd", "ts", n.alias("peers"), (F.round(F.coalesce(F.when(sd > 0, (usd - mean) / sd), F.lit(0.0)), 1) + 0.0).alias("size_z"), F.round(usd / F.col("p90"), 1).alias("whale_x"), F.round(100 * usd / F.col("volume"), 2).alias("vol_share"), "p90", "volume")
        return out.withColumn("outsized", outsized(rules))
