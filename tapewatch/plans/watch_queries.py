"""Queries of the watchlist: signals, what becomes of the rows, the board, and the same as a stream; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.functions.text import CATEGORY_RULES
from tapewatch.operators import positions, wallet, watchlist
from tapewatch.plans.oracle import FUSED, WATCH, _rules
from tapewatch.sources import driver, shared
from tapewatch.streaming import trades as streams
from tapewatch.streaming import watchlist as live

QUERIES: dict = {}
NOW = 1_004_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _public(spark, sf_dir):
    """Orders stand for news (urgent ones) and filings (those of status P) on the names that questions have."""
    name = F.get(F.array(*map(F.lit, driver.NAMES)), (F.col("o_custkey") % len(driver.NAMES)).cast("int"))
    o = driver.read(spark, sf_dir, "orders").select(name.alias("entity"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), "o_orderpriority", "o_orderstatus")
    return o.where("o_orderpriority = '1-URGENT'").select("entity", "ts"), o.where("o_orderstatus = 'P' and o_orderpriority = '5-LOW'").select("entity", "ts")


#: what records of wallets take of positions
_OF_POSITIONS = ("cond", "wallet", "event_group", "resolved_ts", "corr_key", "outcome", "entry", "gross", "stake", "pnl", "won", "held", "ts")


def _inputs(spark, sf_dir):
    """Catalogue, flagged wallets and candidates of one run. Trades are computed once, without what follows from the rest of a row;
    positions are gone when wallets are flagged."""
    size = (F.col("usd") / F.col("price")).alias("size")
    t = shared.staged(driver.trades(spark, sf_dir).drop("size")).select("*", size)
    c = shared.staged(driver.catalog(t))
    with shared.scratch(spark) as held:
        p = held(positions.net_positions(t, c).select(*_OF_POSITIONS))
        facts = held(positions.peers(p).join(positions.price_shock(t).select("cond", "shock_ts"), "cond", "left"))
        records = wallet.records(positions.beside_peers(p, facts), accounts=driver.accounts(spark, sf_dir))
        tiers = shared.staged(wallet.fuse(records).select("wallet", "tier"), free=True)
    flagged = tiers.where("tier in ('high', 'extreme', 'notable')").select("wallet")
    return c, flagged, watchlist.candidates(t, c, flagged, *_public(spark, sf_dir))


def _listing(spark, sf_dir):
    """The list at ``NOW``: some markets have resolved by then, some of their rows were promoted or cleared before."""
    c, flagged, found = _inputs(spark, sf_dir)
    rows = watchlist.listed(found)
    rows = rows.withColumns({"status": F.when(F.col("cond") % 7 == 0, "promoted").when(F.col("cond") % 7 == 1, "cleared").otherwise("watching"), "resolved_ts": F.when(F.col("cond") % 7 == 0, NOW - 3 * 86_400).when(F.col("cond") % 7 == 1, NOW - 9 * 86_400).cast("long")})
    known = c.withColumn("resolved_ts", F.when(F.col("cond") % 3 == 1, NOW - 1).otherwise(NOW + 86_400))
    return watchlist.reconciled(rows, known, flagged.where("hash(wallet) is not null"), NOW), flagged


@query
def watch_signals(spark, sf_dir):
    rows = watchlist.rescored(_inputs(spark, sf_dir)[2])
    return rows.select("cond", "wallet", "ts", "size_z", "whale_x", "vol_share", "peers", "flagged", "fresh", "blackout", "anticipated", "public_info", "score", "signals")


@query
def watch_lifecycle(spark, sf_dir):
    return _listing(spark, sf_dir)[0].select("cond", "wallet", "status", "won", "score", "gone")


@query
def watch_board(spark, sf_dir):
    kept = _listing(spark, sf_dir)[0].where("gone is null or gone = 'retire'")
    return watchlist.board(kept).select("place", "cond", "wallet", "status", "ts", "score")


@query
def watch_rules(spark, sf_dir):
    """Rows whose score another version of the rules changes: here a repeated suspect counts ten points more."""
    found = watchlist.listed(_inputs(spark, sf_dir)[2])
    new = watchlist.Rules(version=4, repeat=40)
    again = watchlist.rescored(found.withColumn("was", F.col("score")), new)
    return again.where("score <> was").select("cond", "wallet", "was", "score", "version")


@query
def stream_watch_bets(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    c, flagged, found = _inputs(spark, sf_dir)
    folder = shared.folder(spark)
    at = F.timestamp_seconds("ts").alias("at")
    found.withColumn("at", at).write.parquet(f"{folder}/bets")
    c.select("cond", "winner", F.timestamp_seconds("resolved_ts").alias("at")).write.parquet(f"{folder}/ends")
    read = lambda name, like: spark.readStream.schema(like).parquet(f"{folder}/{name}").withWatermark("at", "1 hour")
    bets = read("bets", spark.read.parquet(f"{folder}/bets").schema)
    ends = read("ends", spark.read.parquet(f"{folder}/ends").schema)
    out = live.judged(streams.collected(live.lifecycle(bets, ends, parts=4), folder), flagged)
    last = out.groupBy("cond", "wallet").agg(F.max(F.struct(F.when(F.col("event") == "listed", 0).when(F.col("event") == "resolved", 1).otherwise(2).alias("step"), "score", "status", "won")).alias("b"))
    return last.select("cond", "wallet", "b.score", "b.status", "b.won", (F.col("b.step") == 2).alias("retired"))


def _trade_stream(spark, sf_dir):
    """Order lines as a stream of trades, joined with the orders that stand still."""
    lines = driver.read(spark, sf_dir, "lineitem").schema
    raw = spark.readStream.schema(lines).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/lineitem*.parquet")
    return driver.trades_of(raw, driver.read(spark, sf_dir, "orders"))


@query
def stream_watch_peers(spark, sf_dir):
    folder = shared.folder(spark)
    streams.drained(_trade_stream(spark, sf_dir), folder, live.PeerTables(f"{folder}/peers", streams.versions))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/peers/scored")
    return rows.select("cond", "wallet", "ts", "usd", "peers", "size_z", "vol_share")


_FLAGGED = WATCH[len(FUSED) :].split("), peer AS")[0]
_HALF = "floor(abs(x) * {m} + 0.5) / {m} * sign(x)"
_SIGNALS = FUSED + _FLAGGED + f"""), buys AS MATERIALIZED (SELECT * FROM trades WHERE side <> 'SELL' AND usd > 0
), b AS (SELECT * FROM buys WHERE usd >= 1000 QUALIFY row_number() OVER (PARTITION BY cond, wallet ORDER BY ts, tx) = 1
), sizes AS (SELECT cond, list(usd) AS every FROM buys GROUP BY cond
), apart AS (SELECT b.*, list_sort(list_filter(every, lambda s: s <> b.usd)) AS s FROM b JOIN sizes USING (cond)
), figures AS (SELECT * EXCLUDE (s), len(s) AS peers, list_avg(s) AS mu, CASE WHEN len(s) > 1 THEN list_stddev_samp(s) ELSE 0 END AS sd, CASE WHEN len(s) > 0 THEN s[CAST(floor(0.9::DOUBLE * (len(s) - 1)) AS BIGINT) + 1] ELSE 0 END AS p90 FROM apart
), hours AS (SELECT cond, ts // 3600 AS hour, sum(usd) AS usd FROM trades GROUP BY ALL
), volumes AS (SELECT cond, hour, sum(usd) OVER (PARTITION BY cond ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS volume FROM hours
), firsts AS (SELECT wallet, min(ts) AS since FROM trades GROUP BY wallet
), names AS (SELECT o_orderpriority, o_orderstatus, {driver._list(driver.NAMES)}[o_custkey % {len(driver.NAMES)} + 1] AS entity, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders
), news AS (SELECT DISTINCT entity, ts FROM names WHERE o_orderpriority = '1-URGENT'), filings AS (SELECT DISTINCT entity, ts FROM names WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
), topics AS (SELECT cond, ents[1] AS entity FROM named
), met AS (SELECT f.*, v.volume, t.entity, since, w.wallet IS NOT NULL AS flagged FROM figures f JOIN volumes v ON v.cond = f.cond AND v.hour = f.ts // 3600 JOIN firsts USING (wallet) LEFT JOIN topics t ON t.cond = f.cond LEFT JOIN flagged w ON w.wallet = f.wallet
), info AS (SELECT m.*, entity IS NOT NULL AND (EXISTS (FROM news n WHERE n.entity = m.entity AND n.ts BETWEEN m.ts - 86400 AND m.ts) OR EXISTS (FROM filings n WHERE n.entity = m.entity AND n.ts BETWEEN m.ts - 2592000 AND m.ts)) AS public_info,
    entity IS NOT NULL AND EXISTS (FROM filings n WHERE n.entity = m.entity AND n.ts > m.ts AND n.ts <= m.ts + 10368000) AS later FROM met m
), stored AS (SELECT cond, wallet, outcome, price, usd, ts, round(CASE WHEN sd > 0 THEN (usd - mu) / sd ELSE 0 END, 1) + 0.0::DOUBLE AS size_z, round(CASE WHEN p90 > 0 THEN usd / p90 ELSE 0 END, 1) AS whale_x, round(100 * usd / volume, 2) AS vol_share, peers,
    flagged, ts - since <= 14 * 86400 AS fresh, entity IS NOT NULL AND NOT public_info AS blackout, NOT public_info AND later AS anticipated, public_info FROM info"""


def _score(source: str, name: str, repeat: int = 30) -> str:
    """``source`` with the score's parts and ``score, signals``, as the common table expression ``name``."""
    return f"""), {name}_1 AS (SELECT *, usd >= 25000 OR (usd >= 5000 AND vol_share / 100 >= 0.08) OR (usd >= 5000 AND peers >= 6 AND (size_z >= 3 OR whale_x >= 10)) AS big, least(price, 1.0::DOUBLE) AS q FROM {source}
), {name}_2 AS (SELECT *, CASE WHEN usd < 1000 OR price <= 0 THEN 0 WHEN q < 0.85 THEN floor(35 * (0.85::DOUBLE - q) / 0.85::DOUBLE + 0.5) ELSE floor(-25 * (q - 0.85::DOUBLE) / (1 - 0.85::DOUBLE) + 0.5) END AS points,
    CASE WHEN usd >= 1000 AND price > 0 THEN CASE WHEN q <= 0.15 THEN 'deepLongshot' WHEN q <= 0.35 THEN 'longshot' WHEN q <= 0.6 THEN 'underdog' WHEN q < 0.85 THEN 'slightEdge' WHEN q >= 0.92 THEN 'nearCertain' ELSE 'nearConsensus' END END AS tier FROM {name}_1
), {name}_3 AS (SELECT *, greatest(0, points + 20 * big::INTEGER + {repeat} * flagged::INTEGER + 15 * fresh::INTEGER + 35 * blackout::INTEGER + 12 * anticipated::INTEGER - 20 * public_info::INTEGER) AS raw FROM {name}_2
), {name} AS (SELECT * EXCLUDE (big, q, points, tier, raw), CAST(CASE WHEN q >= 0.95 THEN least(raw, 15) ELSE raw END AS INTEGER) AS score,
    concat_ws(',', CASE WHEN big THEN 'outsized' END, tier, CASE WHEN flagged THEN 'repeat' END, CASE WHEN fresh THEN 'fresh' END, CASE WHEN blackout THEN 'blackout' END, CASE WHEN anticipated THEN 'anticipated' END, CASE WHEN public_info THEN 'publicInfo' END) AS signals FROM {name}_3"""


_LISTING = _SIGNALS + _score("stored", "entered") + f"""), listing AS (SELECT * EXCLUDE (score, signals), CASE cond % 7 WHEN 0 THEN 'promoted' WHEN 1 THEN 'cleared' ELSE 'watching' END AS status, CASE cond % 7 WHEN 0 THEN {NOW} - 3 * 86400 WHEN 1 THEN {NOW} - 9 * 86400 END AS resolved_ts FROM entered WHERE score >= 25
), asked AS (SELECT cond, question, CASE WHEN cond % 3 = 1 THEN winner END AS done, CASE {_rules(CATEGORY_RULES, "lower(' ' || question)")} ELSE '' END AS kind FROM catalog
), again AS (SELECT l.* REPLACE (CASE WHEN status = 'watching' THEN f.wallet IS NOT NULL ELSE l.flagged END AS flagged), done, kind FROM listing l LEFT JOIN asked USING (cond) LEFT JOIN flagged f USING (wallet)""" + _score("again", "scored") + f"""), ended AS (SELECT *, status = 'watching' AND done IS NOT NULL AS ends FROM scored
), settled AS (SELECT * EXCLUDE (status, resolved_ts), status AS was, CASE WHEN ends THEN CASE WHEN done = outcome AND flagged AND score >= 65 THEN 'promoted' ELSE 'cleared' END WHEN status = 'promoted' AND score < 65 THEN 'cleared' ELSE status END AS status,
    CASE WHEN ends THEN done = outcome END AS won, CASE WHEN ends THEN {NOW} ELSE resolved_ts END AS resolved_ts FROM ended
), judged AS (SELECT *, CASE WHEN was = 'watching' AND coalesce(kind, '') = '' THEN 'purge' WHEN status <> 'promoted' AND score < 25 THEN 'prune' WHEN coalesce({NOW} - resolved_ts > 7 * 86400, false) OR {NOW} - ts > 30 * 86400 THEN 'retire' END AS gone FROM settled)"""

ORACLES: dict[str, str] = {
    "watch_signals": _SIGNALS + _score("stored", "found") + ") SELECT cond, wallet, ts, size_z, whale_x, vol_share, peers, flagged, fresh, blackout, anticipated, public_info, score, signals FROM found",
    "watch_lifecycle": _LISTING + " SELECT cond, wallet, status, won, score, gone FROM judged",
    "watch_board": _LISTING + " SELECT row_number() OVER (ORDER BY CASE status WHEN 'promoted' THEN 1 WHEN 'watching' THEN 2 ELSE 3 END, ts DESC, cond, wallet) AS place, cond, wallet, status, ts, score FROM judged WHERE gone IS NULL OR gone = 'retire' ORDER BY place LIMIT 150",
    "watch_rules": _SIGNALS + _score("stored", "old") + _score("(SELECT * EXCLUDE (score, signals), score AS was FROM old WHERE score >= 25)", "new", 40) + ") SELECT cond, wallet, was, score, 4 AS version FROM new WHERE score <> was",
    "stream_watch_bets": _SIGNALS + _score("stored", "found") + """), mark AS (SELECT least((SELECT max(ts) FROM stored), (SELECT max(resolved_ts) FROM catalog)) - 3600 AS upto
      ) SELECT f.cond, f.wallet, score, CASE WHEN winner = outcome AND flagged AND score >= 65 THEN 'promoted' ELSE 'cleared' END AS status, winner = outcome AS won, (f.ts + 30 * 86400 + 86399) // 86400 * 86400 <= upto OR (c.resolved_ts + 7 * 86400 + 86399) // 86400 * 86400 <= upto AS retired FROM found f JOIN catalog c USING (cond), mark WHERE score >= 25""",
    "stream_watch_peers": """WITH t AS (SELECT l_partkey % 200 AS cond, 'w' || o_custkey AS wallet, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_extendedprice AS usd, CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 3600 AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      ), m AS (SELECT cond, count(*) AS n, sum(usd) AS total, sum(usd * usd) AS squares FROM t WHERE side = 'BUY' AND usd > 0 GROUP BY cond), h AS (SELECT cond, ts // 3600 AS hour, sum(usd) AS usd FROM t GROUP BY ALL
      ) SELECT t.cond, wallet, ts, t.usd, n - 1 AS peers, round((t.usd - (total - t.usd) / (n - 1)) / sqrt((squares - t.usd * t.usd - (total - t.usd) * (total - t.usd) / (n - 1)) / (n - 2)), 1) + 0.0::DOUBLE AS size_z,
      round(100 * t.usd / volume, 2) AS vol_share FROM t JOIN m USING (cond) JOIN (SELECT cond, hour, sum(usd) OVER (PARTITION BY cond ORDER BY hour RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS volume FROM h) v ON v.cond = t.cond AND v.hour = ts // 3600 WHERE side = 'BUY' AND t.usd >= 1000""",
}
