"""The engine's tables as views of the driver's star schema (one fixed derivation each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions import text

#: Category names by remainder of a market's number.
CATEGORIES = ("Geopolitics", "Elections", "Macro", "Tech", "Legal")


#: Questions of markets by remainder of their number, the names in them, and tags of listings.
QUESTIONS = (
    "Will the US strike {} by March 3?", "Will {} step down before July?", "Will {} announce a new model in 2025?", "{} and Strait of Hormuz ceasefire by Friday?",
    "Who will win the {} election?", "Will the FDA approve {} before June?", "Will {} acquire OPEC Holdings?", "{} CPI inflation above 3%?", "Will NATO troops enter {}?",
    "How many times will {} mention tariffs?", "nothing named will happen", "Will {} win the championship game?", "{} price above $100 on Monday?", "Will {} win an Oscar?",
)
NAMES = ("Iran", "North Korea", "Supreme Court of Brazil", "Gemini Labs", "European Central Bank", "Taiwan", "OFAC", "Nobel Committee", "Coinbase", "Bank of England", "Maduro", "Acme-Works and Sons")
TAGS = ("Sports", "Politics", "crypto", "Weather", "AI tech", "World news", "misc", "Movies", "gold")


def question(number: Column) -> Column:
    """The question of a market by its number."""
    one = F.get(F.array(*map(F.lit, QUESTIONS)), (number % len(QUESTIONS)).cast("int"))
    name = F.get(F.array(*map(F.lit, NAMES)), (F.floor(number / 10) % len(NAMES)).cast("int"))
    return F.replace(one, F.lit("{}"), name)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``market, question, tags, volume`` of listed markets, one for each part."""
    p = read(spark, sf_dir, "part")
    n, tags = F.col("p_partkey"), F.array(*map(F.lit, TAGS))
    return p.select(n.alias("market"), question(n).alias("question"), F.array(F.get(tags, (n % 9).cast("int")), F.get(tags, (F.floor(n / 3) % 9).cast("int"))).alias("tags"), F.col("p_retailprice").alias("volume"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wallet`` and what its profile, its funding and its episodes say; null where nothing is known."""
    n = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("w"), n.cast("string")).alias("wallet"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_name")).alias("username"), F.when(n % 11 != 0, F.col("c_acctbal") * 20).alias("account_pnl"),
        F.when(n % 7 != 0, (n % 120).cast("double")).alias("age_days"), F.when(n % 13 != 0, n % 3).alias("prior_tx"), F.when(n % 4 == 0, (n % 10) / 10).alias("split_ratio"),
        F.when(n % 3 == 0, (n % 60).cast("double")).alias("cash_out_hours"), F.when(n % 6 == 0, 0.5 + (n % 50) / 100).alias("mean_link"), F.when(n % 2 == 0, n % 4).alias("news_count"), F.when(n % 5 == 0, n % 3).alias("docs_ahead"),
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cond, wallet, side, outcome, price, usd, size, ts, tx`` from order lines; ts in epoch seconds."""
    return trades_of(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"))


def trades_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The same of given order lines, which may be a stream."""
    lines = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = 0.03 + ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 95) / 100
    return lines.select(
        (F.col("l_partkey") % 200).alias("cond"), F.concat(F.lit("w"), "o_custkey").alias("wallet"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("l_linestatus") == "O", "YES").otherwise("NO").alias("outcome"),
        price.alias("price"), F.col("l_extendedprice").alias("usd"), (F.col("l_extendedprice") / price).alias("size"),
        (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3600).alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx"),
    )


def catalog(trades_: DataFrame) -> DataFrame:
    """``cond, winner, event_group, category, resolved_ts, question, corr_key``: a market resolves a day after its last trade."""
    names = F.array(*map(F.lit, CATEGORIES))
    last = trades_.groupBy("cond").agg((F.max("ts") + 86_400).alias("resolved_ts"))
    return last.select(
        "cond", F.when(F.col("cond") % 3 == 0, "YES").otherwise("NO").alias("winner"), F.floor(F.col("cond") / 10).alias("event_group"),
        F.get(names, (F.col("cond") % 5).cast("int")).alias("category"), "resolved_ts", question(F.col("cond")).alias("question"),
    ).withColumn("corr_key", F.coalesce(F.concat(F.lit("c:"), text.correlation_key(F.col("question"))), F.concat(F.lit("g:"), F.col("event_group"))))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``market, t, id, p, volume`` from events."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("market"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), (0.05 + 0.9 * F.col("value") / (F.col("value") + 20)).alias("p"), F.col("value").alias("volume"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_question(n: str) -> str:
    return f"replace({_list(QUESTIONS)}[{n} % {len(QUESTIONS)} + 1], '{{}}', {_list(NAMES)}[({n} // 10) % {len(NAMES)} + 1])"


def sql_entities(source: str, name: str, keys: str) -> str:
    """Common table expressions that end in ``name``: ``keys, question, ents, corr`` of the rows of ``source``."""
    cap = lambda x: f"regexp_matches({x}, '^[A-Z][A-Za-z0-9&/-]*$')"
    acronym = lambda x: f"regexp_matches({x}, '^[A-Z]{{2,6}}$')"
    stop, joins = _list(text.ENTITY_STOP), _list(text.CONNECTORS)
    generic = lambda x: f"(list_contains({stop}, lower({x})) OR list_contains({joins}, lower({x})))"
    action = " ".join(f"WHEN regexp_matches(lower(question), '{pattern}') THEN '{kind}'" for kind, pattern in text.ACTIONS)
    return f"""{name}_1 AS (SELECT {keys}, question, list_filter(string_split_regex(regexp_replace(question, '[?,;:()"“”‘’''.]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM {source}
), {name}_2 AS (SELECT *, list_transform(string_split(array_to_string(list_transform(ws, lambda w, i: CASE WHEN {cap('w')} THEN w WHEN list_contains({joins}, lower(w)) AND i > 1 AND {cap('ws[i - 1]')} AND {cap('ws[i + 1]')} THEN lower(w) ELSE chr(1) END), ' '), chr(1)),
    lambda r: list_filter(string_split(r, ' '), lambda w: w <> '')) AS raw FROM {name}_1
), {name}_3 AS (SELECT *, list_transform(list_filter(raw, lambda r: len(list_filter(r, lambda w: NOT {generic('w')})) > 0), lambda r:
    r[list_position(list_transform(r, lambda w: NOT {generic('w')}), true) : len(r) + 1 - list_position(list_reverse(list_transform(r, lambda w: NOT {generic('w')})), true)]) AS runs FROM {name}_2
), {name}_4 AS (SELECT *, list_concat(list_transform(list_filter(runs, lambda r: len(list_filter(r, lambda w: NOT {generic('w')})) > 1 OR {acronym(f"list_filter(r, lambda w: NOT {generic('w')})[1]")} OR length(list_filter(r, lambda w: NOT {generic('w')})[1]) > 3), lambda r: array_to_string(r, ' ')),
    list_filter(ws, lambda w: {acronym('w')} AND NOT list_contains({stop}, lower(w)))) AS every FROM {name}_3
), {name}_5 AS (SELECT *, list_transform(list_sort(list_filter(list_transform(every, lambda e, i: {{'n': -len(string_split(e, ' ')), 'l': -length(e), 'i': i, 'e': e}}), lambda x: list_position(every, x.e) = x.i AND length(x.e) >= 2))[1:4], lambda x: x.e) AS ents FROM {name}_4
), {name}_6 AS (SELECT *, list_sort(list_filter(list_transform(ents[1:2], lambda e: regexp_replace(lower(e), '[^a-z0-9]+', '', 'g')), lambda e: e <> '')) AS top FROM {name}_5
), {name} AS (SELECT {keys}, question, ents, CASE WHEN len(top) > 0 THEN array_to_string(top, '-') || '|' || CASE {action} ELSE 'x' END END AS corr FROM {name}_6)"""


#: The same views for the SQL side.
SQL = f"""
trades AS MATERIALIZED (
  SELECT l_partkey % 200 AS cond, 'w' || o_custkey AS wallet,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         CASE WHEN l_linestatus = 'O' THEN 'YES' ELSE 'NO' END AS outcome,
         CAST(0.03 AS DOUBLE) + CAST((l_orderkey * 7 + l_linenumber * 13) % 95 AS DOUBLE) / 100 AS price,
         l_extendedprice AS usd,
         l_extendedprice / (CAST(0.03 AS DOUBLE) + CAST((l_orderkey * 7 + l_linenumber * 13) % 95 AS DOUBLE) / 100) AS size,
         CAST(epoch(l_shipdate) AS BIGINT) + l_linenumber * 3600 AS ts, l_orderkey * 10 + l_linenumber AS tx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), catalog0 AS (
  SELECT cond, CASE WHEN cond % 3 = 0 THEN 'YES' ELSE 'NO' END AS winner, cond // 10 AS event_group,
         ['Geopolitics', 'Elections', 'Macro', 'Tech', 'Legal'][cond % 5 + 1] AS category, max(ts) + 86400 AS resolved_ts, {sql_question('cond')} AS question
  FROM trades GROUP BY cond
), {sql_entities('catalog0', 'named', 'cond')}, catalog AS (SELECT c.*, coalesce('c:' || n.corr, 'g:' || c.event_group) AS corr_key FROM catalog0 c JOIN named n USING (cond)
), accounts AS (
  SELECT 'w' || c_custkey AS wallet, CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS username, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal * 20 END AS account_pnl,
    CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 120)::DOUBLE END AS age_days, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 3 END AS prior_tx, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 10) / 10 END AS split_ratio,
    CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 60)::DOUBLE END AS cash_out_hours, CASE WHEN c_custkey % 6 = 0 THEN 0.5::DOUBLE + (c_custkey % 50) / 100 END AS mean_link,
    CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 END AS news_count, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 END AS docs_ahead, true AS has_profile
  FROM customer
), listings AS (
  SELECT p_partkey AS market, {sql_question('p_partkey')} AS question, [{_list(TAGS)}[p_partkey % 9 + 1], {_list(TAGS)}[(p_partkey // 3) % 9 + 1]] AS tags, p_retailprice AS volume FROM part
), series AS (
  SELECT user_id AS market, epoch_us(ts) AS t, event_id AS id, CAST(0.05 AS DOUBLE) + CAST(0.9 AS DOUBLE) * value / (value + 20) AS p, value AS volume
  FROM events
)"""
