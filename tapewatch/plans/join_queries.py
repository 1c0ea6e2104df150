"""Queries of documents matched by text, of tables kept by buckets, and of the queue as a stream; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewatch.functions import text
from tapewatch.operators import asof, lifecycle, positions, publish
from tapewatch.plans.oracle import ORACLES as _KNOWN
from tapewatch.sources import driver, shared
from tapewatch.streaming import tables
from tapewatch.streaming import trades as streams

QUERIES: dict = {}
BACK, AHEAD = 14 * 86_400, 120 * 86_400


def query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark, sf_dir):
    """Orders stand for filings; a title is a question, an abstract names another one's subject in capitals."""
    o, k = driver.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.get(F.array(*map(F.lit, driver.NAMES)), (F.col("o_custkey") % len(driver.NAMES)).cast("int"))
    return o.select(k.alias("id"), driver.question(k).alias("title"), F.when(k % 4 == 0, F.concat(F.lit("on pre"), F.upper(name), F.lit("x"))).alias("abstract"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))


def _entities(spark, sf_dir):
    # staged, or Spark takes the inner distinct away and looks for names in every listing
    asked = shared.staged(driver.listings(spark, sf_dir).select("question").distinct())
    return asked.select(F.get(text.entities(F.col("question")), F.lit(0)).alias("entity")).where("entity is not null").distinct()


@query
def entity_documents(spark, sf_dir):
    return asof.containing(_entities(spark, sf_dir), shared.staged(_documents(spark, sf_dir)), ["title", "abstract"]).groupBy("entity").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def document_matches(spark, sf_dir):
    t = shared.staged(driver.trades(spark, sf_dir))
    # staged, or the filter on the entity goes below the catalogue's aggregation and looks for names in every trade
    named = shared.staged(driver.catalog(t).select("cond", F.get(text.entities(F.col("question")), F.lit(0)).alias("entity")))
    bets = t.where("side = 'BUY'").join(named, "cond").where("entity is not null").groupBy(F.col("tx").alias("bet_id")).agg(F.min(F.struct("ts", "entity")).alias("b")).select("bet_id", "b.*")
    return publish.document_matches(shared.staged(bets), shared.staged(_documents(spark, sf_dir)), back=BACK, ahead=AHEAD)


def _in_turn(spark, rows, parts, folder):
    """``rows`` as a stream of files, one for each of ``parts`` (conditions), in their order."""
    for k, part in enumerate(parts):
        rows.where(part).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


@query
def stream_bet_table(spark, sf_dir):
    """Bets accumulated in two batches; only buckets that a batch touches are written again."""
    folder = shared.folder(spark)
    t = shared.staged(driver.trades(spark, sf_dir))
    p = positions.net_positions(t, driver.catalog(t)).select("wallet", "cond", "outcome", "stake", F.when(F.col("tx") % 2 == 0, F.col("entry")).alias("z"), "pnl", F.lit(False).alias("from_feed"), "ts")
    p = shared.staged(p.withColumn("batch", F.lit(0)))
    fresh = p.where("cond % 2 = 0").withColumns({"stake": F.col("stake") * F.when(F.col("ts") % 7 < 3, 2).otherwise(0.5), "z": F.lit(9.0), "pnl": F.col("pnl") + 1, "from_feed": F.col("cond") % 4 == 0, "ts": F.col("ts") + 5, "batch": F.lit(1)})
    table = tables.BucketTable(f"{folder}/table", ("wallet", "cond", "outcome"), lifecycle.accumulated, buckets=8)
    streams.drained(_in_turn(spark, p.unionByName(fresh), ["batch = 0", "batch = 1"], folder), folder, lambda rows, number: table(rows.drop("batch"), number))
    d = table.read(spark)
    return d.select("wallet", "cond", "outcome", *((F.round(F.col(c) + 1e-7, 3) + F.lit(0.0)).alias(c) for c in ("stake", "z", "pnl")), "from_feed", "ts")


@query
def stream_queue(spark, sf_dir):
    """The queue after three batches of ten days, and every audit row, one kind of row beside the other."""
    folder = shared.folder(spark)
    e = driver.read(spark, sf_dir, "events")
    day = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1_704_067_200) / 86_400)
    # events come in three spans; in the later ones some engines' markets aren't scanned any more
    span = F.when(day < 10, 0).when(day < 20, 1).otherwise(2)
    rows = e.select(F.lit("insider").alias("engine"), F.col("user_id").alias("market"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), F.floor("value").cast("long").alias("score"), span.alias("span"))
    rows = shared.staged(rows.where("span = 0 or market % (span + 1) = 0"))
    queue = tables.QueueStream(f"{folder}/queue", least=20, retire_after=14 * 86_400)
    streams.drained(_in_turn(spark, rows, ["span = 0", "span = 1", "span = 2"], folder), folder, queue)
    now, said = queue.read(spark), queue.audit(spark)
    return now.select(F.lit("queue").alias("kind"), "market", "first_seen", "last_scanned", "tier", "score", F.col("status").alias("what")).unionByName(
        said.select(F.lit("audit").alias("kind"), "market", F.lit(None).cast("long").alias("first_seen"), F.col("ts").alias("last_scanned"), "tier", F.lit(None).cast("long").alias("score"), F.col("type").alias("what")))


_NAMES = driver._list(driver.NAMES)
_DOCS = f"docs AS (SELECT o_orderkey AS id, {driver.sql_question('o_orderkey')} AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'on pre' || upper({_NAMES}[o_custkey % {len(driver.NAMES)} + 1]) || 'x' END AS abstract, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders)"
_HOLDS = "(contains(lower(title), lower(entity)) OR coalesce(contains(lower(abstract), lower(entity)), false))"


def _step(k: int, before: str) -> str:
    """One batch of the queue: what was known, what is scanned, and what comes of it."""
    return f"""s{k} AS (SELECT market, arg_max(score, (ts, id)) AS score, max(ts) AS last FROM spans WHERE span = {k} GROUP BY market
), n{k} AS (SELECT max(ts) AS now FROM spans WHERE span = {k}
), q{k} AS (SELECT coalesce(p.market, s.market) AS market, coalesce(first_seen, now) AS first_seen, CASE WHEN s.market IS NOT NULL THEN now ELSE last_scanned END AS last_scanned, CASE WHEN s.market IS NULL THEN p.tier WHEN s.score >= 20 THEN 'Elevated' ELSE 'Watch' END AS tier, coalesce(s.score, p.score) AS score,
    CASE WHEN s.market IS NOT NULL THEN 'active' WHEN now - last_scanned > 1209600 THEN 'retired' ELSE p.status END AS status,
    CASE WHEN p.market IS NULL THEN 'appear' WHEN s.market IS NOT NULL AND p.tier <> CASE WHEN s.score >= 20 THEN 'Elevated' ELSE 'Watch' END THEN 'tier' WHEN s.market IS NULL AND now - last_scanned > 1209600 AND p.status <> 'retired' THEN 'retire' END AS change, now AS at
  FROM {before} p FULL JOIN s{k} s ON p.market = s.market, n{k})"""


ORACLES: dict[str, str] = {
    "entity_documents": f"WITH {driver.SQL}, {driver.sql_entities('listings', 'said', 'market')}, e AS (SELECT DISTINCT ents[1] AS entity FROM said WHERE len(ents) > 0), {_DOCS} SELECT entity, count(*) AS n, sum(id)::BIGINT AS ids FROM e JOIN docs ON {_HOLDS} GROUP BY entity",
    "document_matches": f"""WITH {driver.SQL}, {_DOCS}, e AS (SELECT cond, ents[1] AS entity FROM named WHERE len(ents) > 0), m AS (SELECT x.entity, d.id, d.ts FROM (SELECT DISTINCT entity FROM e) x JOIN docs d ON {_HOLDS}
      ), b AS (SELECT tx AS bet_id, min({{'ts': ts, 'entity': entity}}) AS b FROM trades JOIN e USING (cond) WHERE side = 'BUY' GROUP BY tx), j AS (SELECT bet_id, b.b.ts AS ts, m.ts AS seen, row_number() OVER (PARTITION BY bet_id ORDER BY m.ts DESC, m.id DESC) AS r FROM b JOIN m ON m.entity = b.b.entity AND m.ts BETWEEN b.b.ts - {BACK} AND b.b.ts + {AHEAD})
      SELECT bet_id, CAST(count(*) FILTER (WHERE seen >= ts) AS INTEGER) AS ahead, CAST(count(*) AS INTEGER) AS docs FROM j WHERE r <= 5 GROUP BY bet_id""",
    "stream_bet_table": _KNOWN["accumulated_bets"],
    "stream_queue": f"""WITH dated AS (SELECT user_id AS market, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS id, CAST(floor(value) AS BIGINT) AS score FROM events), spans AS (SELECT * FROM (SELECT *, CASE WHEN (ts - 1704067200) // 86400 < 10 THEN 0 WHEN (ts - 1704067200) // 86400 < 20 THEN 1 ELSE 2 END AS span FROM dated) WHERE span = 0 OR market % (span + 1) = 0
      ), nothing AS (SELECT NULL::BIGINT AS market, NULL::BIGINT AS first_seen, NULL::BIGINT AS last_scanned, NULL::VARCHAR AS tier, NULL::BIGINT AS score, NULL::VARCHAR AS status WHERE false
      ), {_step(0, 'nothing')}, {_step(1, 'q0')}, {_step(2, 'q1')}, every AS (FROM q0 UNION ALL FROM q1 UNION ALL FROM q2)
      SELECT 'queue' AS kind, market, first_seen, last_scanned, tier, score, status AS what FROM q2 UNION ALL SELECT 'audit', market, NULL, last_scanned, tier, NULL, change FROM every WHERE change IS NOT NULL""",
}
