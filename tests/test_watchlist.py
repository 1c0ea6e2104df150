"""The watchlist: scores, peers, lifecycle and the streams, against plain versions and worked cases."""

import math
import os
import random
import re
import statistics
import time
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import watchlist
from tapewatch.sources import shared
from tapewatch.streaming import trades as streams
from tapewatch.streaming import watchlist as live

FIELDS = "cond long, wallet string, outcome string, price double, usd double, ts long, size_z double, whale_x double, vol_share double, peers long, flagged boolean, fresh boolean, blackout boolean, anticipated boolean, public_info boolean"
DAY = 86_400


def row(cond=1, wallet="w", outcome="YES", price=0.5, usd=2000.0, ts=0, z=0.0, whale=0.0, share=0.0, peers=0, flagged=False, fresh=False, blackout=False, anticipated=False, public=False):
    return (cond, wallet, outcome, price, usd, ts, z, whale, share, peers, flagged, fresh, blackout, anticipated, public)


def test_scores_of_worked_cases(spark):
    cases = [
        (row(price=0.05, usd=30_000.0), 20 + 33, "outsized,deepLongshot"),
        (row(price=0.5, usd=900.0), 0, ""),
        (row(price=0.85), 0, "nearConsensus"),
        (row(price=1.0, usd=40_000.0, blackout=True, flagged=True), 15, "outsized,nearCertain,repeat,blackout"),
        (row(price=0.97, blackout=True), 15, "nearCertain,blackout"),
        (row(price=0.5, share=8.0, usd=4999.0), 14, "underdog"),
        (row(price=0.5, share=8.0, usd=5000.0), 34, "outsized,underdog"),
        (row(price=0.5, z=3.0, peers=6, usd=5000.0), 34, "outsized,underdog"),
        (row(price=0.5, z=3.0, peers=5, usd=5000.0), 14, "underdog"),
        (row(price=0.9, public=True), 0, "nearConsensus,publicInfo"),
        (row(price=0.2, fresh=True, anticipated=True, blackout=True), 27 + 15 + 12 + 35, "longshot,fresh,blackout,anticipated"),
        (tuple(None if i in (10, 11, 12) else v for i, v in enumerate(row(price=0.7))), 6, "slightEdge"),
    ]
    found = watchlist.rescored(spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, " + FIELDS)).orderBy("i").collect()
    assert [(r["score"], r["signals"]) for r in found] == [c[1:] for c in cases]


def test_peers_equal_a_plain_version(spark):
    r = random.Random(4)
    trades = [(r.choice([1, 1, 1, 2, 3]), float(r.choice([1, 5, 5, 7, 1000, 250_000, round(math.exp(r.uniform(0, 12)), 2)]))) for _ in range(700)] + [(9, 5.0), (8, 5.0), (8, 5.0), (7, 1.0), (7, 3.0)]
    for block in (1024, 3):
        found = {(x["cond"], x["usd"]): x for x in watchlist.peers(spark.createDataFrame(trades, "cond long, usd double"), block=block).collect()}
        assert len(found) == len(set(trades))
        for cond, usd in set(trades):
            rest = sorted(u for c, u in trades if c == cond and u != usd)
            x = found[cond, usd]
            assert x["peers"] == len(rest) and x["p90"] == (rest[math.floor(0.9 * (len(rest) - 1))] if rest else None)
            if rest:
                assert x["mean"] == pytest.approx(statistics.fmean(rest))
            if len(rest) > 1:
                assert x["sd"] == pytest.approx(statistics.stdev(rest), abs=1e-3)


@pytest.mark.parametrize("block", [10, 1000])
def test_times_around_equal_a_plain_version(spark, block):
    r = random.Random(block)
    asked = [(r.choice(["a", "b", None]), r.randint(0, 300), i) for i in range(200)]
    found = [(r.choice(["a", "b", None, "c"]), r.randint(0, 300)) for _ in range(40)] * 2
    got = watchlist.around(spark.createDataFrame(asked, "entity string, ts long, id int"), spark.createDataFrame(found, "entity string, ts long"), "entity", block)
    for x in got.collect():
        mine = [t for k, t in found if k == x["entity"]]
        assert x["before"] == max((t for t in mine if t <= x["ts"]), default=None) and x["after"] == min((t for t in mine if t > x["ts"]), default=None)
    assert got.count() == 200


def test_what_becomes_of_rows(spark):
    now = 100 * DAY
    strong = dict(price=0.1, usd=30_000.0, flagged=True, ts=now - DAY)
    rows = [
        (row(1, "flagged", **strong), "watching", None), (row(1, "other", **strong), "watching", None), (row(1, "flagged2", "NO", **strong), "watching", None),
        (row(2, "flagged", **strong), "watching", None), (row(3, "flagged", **strong), "watching", None), (row(4, "flagged", price=0.5, ts=now - DAY), "watching", None),
        (row(2, "a", price=0.5, ts=now - DAY), "promoted", now - DAY), (row(2, "b", **strong), "promoted", now - 8 * DAY), (row(2, "c", **{**strong, "ts": now - 31 * DAY}), "watching", None),
    ]
    table = spark.createDataFrame([(*a, b, None, c) for a, b, c in rows], FIELDS + ", status string, won boolean, resolved_ts long")
    catalog = spark.createDataFrame([(1, "yes", now - 5, "Will Iran strike Iraq?"), (2, "YES", now + 5, "Will Iran strike Iraq?"), (3, "YES", now + 5, "Who wins the NBA game?"), (4, "YES", now + 5, "Will Iran strike Iraq?")], "cond long, winner string, resolved_ts long, question string")
    flagged = spark.createDataFrame([("flagged",), ("flagged2",), ("flagged",)], "wallet string")
    got = {(x["cond"], x["wallet"]): (x["status"], x["won"], x["gone"]) for x in watchlist.reconciled(table, catalog, flagged, now).collect()}
    assert got == {
        (1, "flagged"): ("promoted", True, None), (1, "other"): ("cleared", True, None), (1, "flagged2"): ("cleared", False, None), (2, "flagged"): ("watching", None, None), (3, "flagged"): ("watching", None, "purge"),
        (4, "flagged"): ("watching", None, None), (2, "a"): ("cleared", None, "prune"), (2, "b"): ("promoted", None, "retire"), (2, "c"): ("watching", None, "retire"),
    }
    places = [(x["wallet"], x["place"]) for x in watchlist.board(table.where("cond < 3"), 4).orderBy("place").collect()]
    assert places == [("a", 1), ("b", 2), ("flagged", 3), ("flagged2", 4)]


def in_turn(spark, folder, name, batches, schema):
    """Files that a stream takes one after another."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        for f in os.listdir(f"{folder}/{name}"):
            path = f"{folder}/{name}/{f}"
            if f.startswith("part") and os.path.getmtime(path) > 1e6 + 1e5:
                os.utime(path, (1e6 + k, 1e6 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def test_streamed_bets_over_three_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    strong = dict(price=0.1, usd=30_000.0)
    bets = [
        [row(1, "w1", ts=DAY, **strong), row(1, "w2", ts=DAY, price=0.2, usd=1500.0, fresh=True), row(1, "w3", ts=DAY, price=0.8), row(2, "w1", ts=2 * DAY, **strong)],
        [row(1, "w1", "NO", ts=3 * DAY, **strong), row(9, "w5", "NO", ts=3 * DAY, **strong), row(1, "w6", ts=4 * DAY, **strong)],
        [row(5, "w9", ts=60 * DAY, **strong)],
    ]
    ends = [[(9, "no", 2 * DAY)], [(1, "YES", 5 * DAY), (1, "NO", 6 * DAY)], [(7, "NO", 60 * DAY)]]
    at = F.timestamp_seconds("ts").alias("at")
    one = in_turn(spark, tmp_path, "bets", bets, FIELDS).select("*", at).withWatermark("at", "1 day")
    two = in_turn(spark, tmp_path, "ends", ends, "cond long, winner string, ts long").select("cond", "winner", at).withWatermark("at", "1 day")
    events = streams.collected(live.lifecycle(one, two, parts=3), str(tmp_path)).cache()
    got = sorted((x["cond"], x["wallet"], x["event"], x["won"], x["resolved_ts"]) for x in events.collect())
    assert got == sorted([
        (1, "w1", "listed", None, None), (1, "w2", "listed", None, None), (2, "w1", "listed", None, None), (9, "w5", "listed", None, None), (1, "w6", "listed", None, None), (5, "w9", "listed", None, None),
        (9, "w5", "resolved", True, 2 * DAY), (1, "w1", "resolved", True, 5 * DAY), (1, "w2", "resolved", True, 5 * DAY), (1, "w6", "resolved", True, 5 * DAY),
        (9, "w5", "retired", True, 2 * DAY), (1, "w1", "retired", True, 5 * DAY), (1, "w2", "retired", True, 5 * DAY), (1, "w6", "retired", True, 5 * DAY), (2, "w1", "retired", None, None),
    ])
    flagged = spark.createDataFrame([("w1",), ("w2",)], "wallet string")
    ended = {(x["cond"], x["wallet"]): (x["status"], x["score"]) for x in live.judged(events.where("event = 'resolved'"), flagged).collect()}
    assert ended == {(1, "w1"): ("promoted", 81), (1, "w2"): ("promoted", 72), (1, "w6"): ("cleared", 51), (9, "w5"): ("cleared", 51)}


def test_carried_peers_are_near_the_exact_ones(spark, tmp_path):
    r = random.Random(1)
    schema = "cond long, wallet string, side string, outcome string, price double, usd double, ts long"
    batches = [[(r.choice([1, 2]), f"w{r.randint(0, 50)}", r.choice(["BUY", "BUY", "SELL"]), "YES", 0.5, round(math.exp(r.gauss(7, 1.5)), 2), DAY * k + r.randint(0, DAY)) for _ in range(3000)] for k in range(3)]
    stream = in_turn(spark, tmp_path, "trades", batches, schema)
    tables = live.PeerTables(str(tmp_path / "peers"), streams.versions)
    streams.drained(stream, str(tmp_path), tables)
    seen: list = []
    for k, batch in enumerate(batches):
        seen += batch
        got = spark.read.parquet(str(tmp_path / f"peers/scored/version={k}"))
        assert got.count() == sum(x[2] != "SELL" and x[5] >= 1000 for x in batch)
        for cond in (1, 2):
            sizes = sorted(x[5] for x in seen if x[0] == cond and x[2] != "SELL")
            one = got.where(f"cond = {cond}").first()
            rank = sum(s <= one["p90"] for s in sizes) / len(sizes)
            assert abs(rank - 0.9) <= 0.01 and one["peers"] == len(sizes) - 1
            hour = one["ts"] // 3600
            assert one["volume"] == pytest.approx(sum(x[5] for x in seen if x[0] == cond and hour - 23 <= x[6] // 3600 <= hour))
    # a batch that runs again replaces its own version
    tables(spark.createDataFrame(batches[2], schema), 2)
    assert spark.read.parquet(str(tmp_path / "peers/markets/version=2")).agg(F.sum("n")).first()[0] == sum(x[2] != "SELL" for x in seen)


def test_frames_end_where_the_row_is(spark):
    """F2, F3, F12 to F14: Spark goes through all that follows once for every row of a frame without an end."""
    rows = spark.createDataFrame([("a", 5), ("a", 9)], "entity string, ts long")
    found = watchlist.around(rows, spark.createDataFrame([("a", 5), ("a", 7)], "entity string, ts long"), "entity")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(5, 5, 7), (9, 7, None)]


def test_numbers_asked_of_a_market_are_looked_for_once(spark):
    """F2, F3, F12 to F14: only a market's few different numbers meet its ranges of sizes."""
    trades = spark.createDataFrame([(1, float(u)) for u in range(1, 3001)], "cond long, usd double")
    found = watchlist.peers(trades)
    assert found.select("p90").distinct().count() == 2 and found.count() == 3000
    assert re.search(r"Aggregate \[cond#\d+L?, _number#", found._jdf.queryExecution().optimizedPlan().toString())


class Held:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.maps, self.values, self.timers, self.calls = {}, {}, set(), 0

    def getMapState(self, name, *_):
        return HeldMap(self, self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):
        return HeldValue(self, name)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class HeldMap:
    def __init__(self, held, rows):
        self.held, self.rows = held, rows

    def exists(self):
        return bool(self.rows)

    def containsKey(self, key):
        self.held.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.held.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.held.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.held.calls += 1
        self.rows.pop(key)

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        for pair in list(self.rows.items()):
            self.held.calls += 1
            yield pair

    def clear(self):
        self.rows.clear()


class HeldValue:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held.values

    def get(self):
        return self.held.values[self.name]

    def update(self, value):
        self.held.values[self.name] = value

    def clear(self):
        self.held.values.pop(self.name, None)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at * 1000


def test_many_bets_take_few_calls_to_the_state():
    """a call for each bet took most of the stream's time; the events equal those of a plain version."""
    held, r = Held(), random.Random(2)
    listed = live.Lifecycle()
    listed.init(held)
    names = FIELDS.replace(",", "").split()[::2]

    def given(bets, end=None):
        frame = pd.DataFrame([(*row(1, w, ts=ts, price=0.1), w, ts) for w, ts in bets], columns=[*names, "w", "t"]).drop(columns=["w", "t"])
        frame["slot"] = [zlib.crc32(w.encode()) % live.SLOTS for w in frame["wallet"]]
        frame = frame.assign(winner=None, at=pd.to_datetime(frame["ts"], unit="s"))
        if end is not None:
            frame = pd.concat([frame, pd.DataFrame({"cond": [1], "winner": ["yes"], "at": [pd.Timestamp(end, unit="s")]})], ignore_index=True)
        return list(listed.handleInputRows((1, 0), iter([frame]), None))

    def seen(frames):
        return sorted((w, e, None if pd.isna(won) else bool(won), None if pd.isna(at) else int(at)) for f in frames for w, e, won, at in zip(f["wallet"], f["event"], f["won"], f["resolved_ts"]))

    first = [(f"w{r.randint(0, 4000)}", r.randint(0, 40) * DAY + 5) for _ in range(5000)]
    second = [(f"w{r.randint(3000, 7000)}", r.randint(41, 50) * DAY) for _ in range(2000)]
    kept = {}
    for ts, w in sorted((ts, w) for w, ts in first):
        kept.setdefault(w, ts)
    assert seen(given(first)) == sorted((w, "listed", None, None) for w in kept)
    assert held.timers == {(min(kept.values()) // DAY + 31) * DAY * 1000}
    now = 51 * DAY
    held.timers.clear()
    gone = {w for w, ts in kept.items() if (ts // DAY + 31) * DAY <= now}
    assert seen(listed.handleExpiredTimer((1, 0), Clock(now), None)) == sorted((w, "retired", None, None) for w in gone)
    kept = {w: ts for w, ts in kept.items() if w not in gone}
    assert held.timers == {(min(kept.values()) // DAY + 31) * DAY * 1000}
    new = {w for w, _ in second} - set(kept)
    both = new | set(kept)
    assert seen(given(second, 52 * DAY)) == sorted([(w, "listed", None, None) for w in new] + [(w, "resolved", True, 52 * DAY) for w in both])
    assert held.timers == {52 * DAY * 1000}  # the earlier of the oldest bet's day and a week after the resolution
    held.timers.clear()
    assert seen(listed.handleExpiredTimer((1, 0), Clock(59 * DAY), None)) == sorted((w, "retired", True, 52 * DAY) for w in both)
    assert not held.timers and not any(held.maps.values()) and held.calls < 1000


def test_what_is_looked_up_by_time_is_looked_up_once_a_time(spark):
    """F8 to F11: bets of one market and time share volume, news and filings; bets themselves aren't put in order for them."""
    trades = spark.createDataFrame([(1, f"w{k}", "BUY", "YES", 0.5, 1000.0 + k, 2000.0, 3600 * (k % 3), k) for k in range(60)], "cond long, wallet string, side string, outcome string, price double, usd double, size double, ts long, tx long")
    catalog = spark.createDataFrame([(1, "Will Iran strike Iraq?")], "cond long, question string")
    public = spark.createDataFrame([("Iran", 3600)], "entity string, ts long")
    flagged = spark.createDataFrame([("w1",)], "wallet string")
    found = watchlist.candidates(trades, catalog, flagged, public, public.where("ts < 0"))
    assert not re.search(r"wallet#\d+[^\n]*AS _row", found._jdf.queryExecution().optimizedPlan().toString())
    got = found.collect()
    assert len(got) == 60 and all(x["public_info"] == (x["ts"] >= 3600) and x["blackout"] == (x["ts"] < 3600) and x["flagged"] == (x["wallet"] == "w1") for x in got)
    per_hour = [sum(1000.0 + k for k in range(60) if k % 3 <= h) for h in range(3)]
    assert all(x["vol_share"] == round(100 * x["usd"] / per_hour[x["ts"] // 3600], 2) for x in got)


def test_scratch_tables_are_gone_after_their_block(spark):
    """F8 to F11: tables of an earlier step don't stay on disk."""
    with shared.scratch(spark) as held:
        table = held(spark.range(5))
        files = [f.removeprefix("file://") for f in table.inputFiles()]
        assert table.count() == 5 and files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


def test_exchanges_of_earlier_steps_leave_the_disk(spark):
    """F8 to F11: they stayed until the driver's collector came by."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    seen = files()
    table = shared.staged(spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(5):
        shared.staged(spark.range(1), free=True)
        time.sleep(1)
    assert not files() - seen and table.count() == 1000
