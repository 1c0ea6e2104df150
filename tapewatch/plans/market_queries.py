"""Queries of markets in one row, and of the move times that they share; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.operators import enrichment, lifecycle, market, surveillance
from tapewatch.sources import driver, shared

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df, digits: int = 4):
    return df.select(*((F.round(F.col(c) + 1e-7, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _settled(spark, sf_dir):
    """Series in which high prices stand for a settlement."""
    return driver.series(spark, sf_dir).withColumn("p", F.when(F.col("p") > 0.6, 0.995).otherwise(F.col("p")))


def _inputs(spark, sf_dir):
    t = shared.staged(driver.trades(spark, sf_dir))
    s = shared.staged(_settled(spark, sf_dir))
    l, m = driver.read(spark, sf_dir, "lineitem"), F.col("market")
    ends = s.groupBy("market").agg(F.max_by("p", F.struct("t", "id")).alias("prob"))
    markets = ends.select("market", (m % 2 == 1).alias("anonymous"), (m % 4 == 0).alias("resolved"), F.when(m % 4 == 0, m % 8 == 0).alias("won"), "prob", F.when(m % 5 != 0, (m % 10) / 10).alias("quality"), F.get(F.array(F.lit("Elections"), F.lit("world"), F.lit(None)), (m % 3).cast("int")).alias("category"))
    held = lifecycle.holders(l.select((F.col("l_partkey") % 200).alias("market"), F.col("l_suppkey").alias("wallet"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity") * 100).alias("amount")))
    seen = driver.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("wallet"), (1_704_067_200 + (F.col("s_suppkey") % 60) * 43_200).alias("first_seen"))
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13
    levels = l.select((F.col("l_partkey") % 200).alias("market"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), (0.03 + (n % 45) / 100).alias("price"), F.col("l_quantity").alias("size"))
    return markets, s, market.wallet_volumes(t).withColumnRenamed("cond", "market"), held, seen, surveillance.order_book(levels)


@query
def spike_time(spark, sf_dir):
    return enrichment.spike_time(driver.series(spark, sf_dir))


@query
def market_enrichment(spark, sf_dir):
    return _rounded(enrichment.enriched(*_inputs(spark, sf_dir)))


@query
def market_report(spark, sf_dir):
    """The same of the markets that the first supplier's parts are listed at, and nothing of the others is put in order."""
    l = driver.read(spark, sf_dir, "lineitem")
    first = driver.read(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("s"))
    asked = l.join(F.broadcast(first), F.col("l_suppkey") == F.col("s")).select((F.col("l_partkey") % 200).alias("market")).distinct()
    return _rounded(enrichment.report(asked, *_inputs(spark, sf_dir)))


_Z = "ln(greatest(0.001::DOUBLE, least(0.999::DOUBLE, p)) / (1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, p))))"
_CLIP = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
_PLACED = lambda source: f"SELECT *, {_Z} AS z, row_number() OVER w AS k, count(*) OVER (PARTITION BY market) AS n, {_Z} - lag({_Z}) OVER w AS move FROM {source} WHERE p > 0 AND p < 1 AND t IS NOT NULL WINDOW w AS (PARTITION BY market ORDER BY t, id)"
_ENRICHED = f"""WITH {driver.SQL}, given AS (SELECT market, t, id, CASE WHEN p > 0.6 THEN 0.995 ELSE p END AS p, volume FROM series
), fin AS (SELECT market, arg_max(p, (t, id)) AS prob, count(*) AS given_n, max(t) AS ended_at FROM given GROUP BY market
), marks AS (SELECT market, max(t) AS last FROM given JOIN fin USING (market) WHERE abs(p - round(prob)) > 0.01 GROUP BY market
), kept AS (SELECT g.* FROM given g JOIN fin USING (market) LEFT JOIN marks USING (market) WHERE market % 4 <> 0 OR least(prob, 1 - prob) > 0.01 OR t <= last
), placed AS ({_PLACED('kept')}
), jumps AS (SELECT market, t AS moved_at FROM placed QUALIFY row_number() OVER (PARTITION BY market ORDER BY abs(move) DESC NULLS LAST, CASE WHEN move IS NULL THEN -k ELSE k END) = 1
), f AS (SELECT market, max(n) AS points, median(p) FILTER (k <= greatest(3, floor(n * 0.6))) AS calm, avg(move) FILTER (k BETWEEN 2 AND greatest(3, floor((n - 1) * 0.6)) + 1) AS mu, stddev_pop(move) FILTER (k BETWEEN 2 AND greatest(3, floor((n - 1) * 0.6)) + 1) AS sigma,
    sum(move) FILTER (k > greatest(3, floor((n - 1) * 0.6)) + 1) AS moved, count(*) FILTER (k > greatest(3, floor((n - 1) * 0.6)) + 1) AS late, sum(volume) FILTER (k > n // 2) AS pre, sum(volume) FILTER (k <= n // 2) AS base,
    median(abs(move) / volume) FILTER (volume > 0 AND move <> 0) AS mid, median(abs(move) / volume) FILTER (volume > 0 AND move <> 0 AND n - k < 3) AS recent FROM placed GROUP BY market
), h AS (SELECT l_partkey % 200 AS market, l_suppkey AS wallet, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity * 100 END) AS balance FROM lineitem GROUP BY ALL HAVING balance > 0
), h3 AS (SELECT h.market, bool_or(coalesce(moved_at / 1000000 - (1704067200 + (wallet % 60) * 43200) BETWEEN -86400 AND 1209600, false)) AS fresh FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY market ORDER BY balance DESC, wallet) <= 3) h JOIN jumps USING (market) GROUP BY h.market
), hs AS (SELECT market, sum(balance * balance) / (sum(balance) * sum(balance)) AS hhi, max(balance) / sum(balance) AS top1, max(balance) AS largest, count(*) AS wallets FROM h GROUP BY market
), buys AS (SELECT market, max(usd) AS bought FROM (SELECT cond AS market, wallet, sum(usd) AS usd FROM trades WHERE side <> 'SELL' GROUP BY ALL) GROUP BY market
), bk AS (SELECT l_partkey % 200 AS market, sum((0.03::DOUBLE + ((l_orderkey * 7 + l_linenumber * 13) % 45)::DOUBLE / 100) * l_quantity * CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END) AS tilt, sum((0.03::DOUBLE + ((l_orderkey * 7 + l_linenumber * 13) % 45)::DOUBLE / 100) * l_quantity) AS depth FROM lineitem GROUP BY ALL
), j AS (SELECT fin.*, f.* EXCLUDE (market), moved_at, hs.* EXCLUDE (market), coalesce(fresh, false) AS fresh, bought, tilt, depth, market % 2 = 1 AS anonymous, market % 4 = 0 AS resolved, CASE WHEN market % 4 = 0 THEN market % 8 = 0 END AS won, CASE WHEN market % 5 <> 0 THEN (market % 10) / 10 END AS quality,
    given_n < 8 AS thin, coalesce(points < 8, true) AS empty, CASE market % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.52 ELSE 0.14 END::DOUBLE AS rate FROM fin LEFT JOIN f USING (market) LEFT JOIN jumps USING (market) LEFT JOIN hs USING (market) LEFT JOIN h3 USING (market) LEFT JOIN buys USING (market) LEFT JOIN bk USING (market)
), s AS (SELECT *, NOT thin AND NOT empty AS scored, CASE WHEN resolved AND NOT thin AND NOT empty THEN round(calm, 4) ELSE prob END AS implied FROM j
), enriched AS (SELECT market, CASE WHEN thin THEN 'insufficient price history' WHEN empty THEN 'no pre-event window' END AS note, CASE WHEN scored THEN moved_at WHEN NOT thin THEN ended_at END AS moved_at, round(implied + 1e-7, 4) AS implied,
    round(CASE WHEN (NOT thin AND empty) OR (resolved AND scored AND (calm < 0.03 OR calm > 0.97)) THEN least(coalesce(quality, 1), 0.2) ELSE quality END + 1e-7, 4) AS quality,
    round(CASE WHEN scored AND sigma > 0 AND late >= 1 THEN {_CLIP('abs((moved - late * mu) / sigma / sqrt(late)) / 4')} END + 1e-7, 4) AS run_up, round(CASE WHEN scored THEN {_CLIP('log2(greatest(1.0::DOUBLE, CASE WHEN mid > 0 THEN coalesce(recent, 0) / mid ELSE 0 END)) / log2(12.0::DOUBLE)')} END + 1e-7, 4) AS impact,
    round(CASE WHEN scored THEN CASE WHEN anonymous THEN CASE WHEN depth > 0 THEN {_CLIP('abs(tilt / depth)')} END WHEN wallets >= 3 THEN {_CLIP('0.55 * hhi + 0.45 * top1 + CASE WHEN fresh THEN 0.12 ELSE 0 END')} END END + 1e-7, 4) AS concentration,
    round(CASE WHEN scored THEN CASE WHEN anonymous THEN CASE WHEN points >= 6 THEN {_CLIP('log2(greatest(1.0::DOUBLE, pre / CASE WHEN base > 0 THEN base ELSE 1 END)) / log2(10.0::DOUBLE)')} END
      WHEN bought IS NOT NULL THEN {_CLIP('0.45 * least(1, log10(greatest(1.0::DOUBLE, bought)) / 5) + 0.30 * 0.5 + 0.25 * CASE WHEN won IS NULL THEN 0.5 WHEN won THEN 1 ELSE 0 END')} END END + 1e-7, 4) AS accumulation,
    round(CASE WHEN scored AND NOT anonymous AND largest IS NOT NULL THEN CASE WHEN largest < 2500 OR implied > 0.35 THEN 0 WHEN won IS NULL THEN least(0.5, greatest(0, (0.35 - implied) / 0.35 * 0.4)) WHEN won THEN {_CLIP('0.45 + 0.4 * ' + _CLIP('1 - implied') + ' + 0.15 * ' + _CLIP('(rate - implied) / greatest(0.05, rate)'))} ELSE 0.1 END END + 1e-7, 4) AS longshot FROM s)"""

ORACLES: dict[str, str] = {
    "spike_time": f"WITH {driver.SQL}, placed AS ({_PLACED('series')}) SELECT market, t AS moved_at FROM placed QUALIFY row_number() OVER (PARTITION BY market ORDER BY abs(move) DESC NULLS LAST, CASE WHEN move IS NULL THEN -k ELSE k END) = 1",
    "market_enrichment": f"{_ENRICHED} SELECT * FROM enriched",
    "market_report": f"{_ENRICHED} SELECT * FROM enriched WHERE market IN (SELECT l_partkey % 200 FROM lineitem WHERE l_suppkey = (SELECT min(s_suppkey) FROM supplier))",
}
