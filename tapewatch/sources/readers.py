"""Readers and writers of landed feeds; every reader has an explicit schema and pushes its filter to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions import text

TRADES_RAW = (
    "proxyWallet string, user string, maker string, taker string, conditionId string, market string, side string, size string, price string, "
    "outcome string, outcomeIndex int, timestamp long, matchTime long, time long, transactionHash string, transaction_hash string, txHash string"
)
MARKETS_RAW = (
    "slug string, title string, tags array<string>, markets array<struct<conditionId:string,question:string,outcomes:string,outcomePrices:string,"
    "closedTime:string,endDate:string,clobTokenIds:string,volume24hr:double,liquidity:double,closed:boolean>>"
)
POSITIONS_RAW = "wallet string, conditionId string, avgPrice double, curPrice double, size double, initialValue double, redeemable boolean, cashPnl double, realizedPnl double, endDate string, eventSlug string, title string, outcome string"
TRANSFERS_RAW = "from string, to string, value string, timeStamp long, blockNumber long, hash string, contractAddress string"
DOCKETS_RAW = "results array<struct<docket_id:long,caseName:string,court_id:string,dateFiled:string,dateTerminated:string,docketNumber:string,suitNature:string,docket_absolute_url:string,party:array<string>,_query:string>>"
MATTERS = "id string, caption string, platform string, contract string, forum string, outcome string, posture string, gate string, states array<string>, statutes array<string>, sources array<string>, filed_date string, decided_date string, last_update string"
RSS = "title string, link string, pubDate string, description string"


#: The column that holds a line that is no JSON of the schema.
BAD = "_bad_line"


def landed(spark: SparkSession, path: str, schema: str, multi: bool = False) -> DataFrame:
    """Rows of a feed, bad lines too: those have nothing but ``BAD``."""
    return spark.read.schema(f"{schema}, {BAD} string").option("multiLine", multi).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row ``rows, bad, keyed``: how many lines of a landed feed there are, can't be read, and have the schema's first column."""
    rows = landed(spark, path, schema)
    return rows.agg(F.count("*").alias("rows"), F.count(BAD).alias("bad"), F.count(rows.columns[0]).alias("keyed"))


def _json(spark: SparkSession, path: str, schema: str, multi: bool = False) -> DataFrame:
    return landed(spark, path, schema, multi).where(F.col(BAD).isNull()).drop(BAD)


def _number(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def outcome(text: Column, index: Column) -> Column:
    """YES or NO from a name or an index, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "0"), "YES").when(t.isin("no", "1"), "NO").when(index == 0, "YES").when(index == 1, "NO")


def normalised_trades(raw: DataFrame) -> DataFrame:
    """Aliases of the feeds' fields made one: ``cond, wallet, side, outcome, size, price, usd, ts, tx``."""
    size, price = _number("size"), _number("price")
    return raw.select(
        F.coalesce("conditionId", "market").alias("cond"), F.lower(F.coalesce("proxyWallet", "user", "maker", "taker")).alias("wallet"),
        F.when(F.upper("side") == "SELL", "SELL").otherwise("BUY").alias("side"), outcome(F.col("outcome"), F.col("outcomeIndex")).alias("outcome"),
        size.alias("size"), price.alias("price"), (size * price).alias("usd"), F.coalesce("timestamp", "matchTime", "time").alias("ts"),
        F.coalesce("transactionHash", "transaction_hash", "txHash").alias("tx"),
    ).where(F.col("wallet").isNotNull() & F.col("outcome").isNotNull() & (F.col("size") != 0))


def trades(spark: SparkSession, path: str) -> DataFrame:
    return normalised_trades(_json(spark, path, TRADES_RAW))


def wallet_trades(spark: SparkSession, path: str, wallet: str) -> DataFrame:
    """One wallet's trades: feeds leak others, so the owner is filtered again; repeats are dropped."""
    return trades(spark, path).where(F.col("wallet") == wallet.lower()).dropDuplicates(["tx", "cond", "outcome", "size"])


def binary(outcomes: Column) -> Column:
    names = F.transform(F.from_json(outcomes, "array<string>"), lambda x: F.lower(F.trim(x)))
    return F.coalesce((F.size(names) == 2) & F.array_contains(names, "yes") & F.array_contains(names, "no"), F.lit(False))


def winner(outcomes: Column, prices: Column) -> Column:
    """The settled side of a binary market: its price is .95 or more and the other's .05 or less."""
    names = F.transform(F.from_json(outcomes, "array<string>"), lambda x: F.lower(F.trim(x)))
    values = F.transform(F.from_json(prices, "array<string>"), lambda x: x.try_cast("double"))
    yes, no = F.get(values, F.array_position(names, "yes").cast("int") - 1), F.get(values, F.array_position(names, "no").cast("int") - 1)
    return F.when((yes >= 0.95) & (no <= 0.05), "YES").when((no >= 0.95) & (yes <= 0.05), "NO")


def markets(spark: SparkSession, path: str) -> DataFrame:
    """A row for each market nested in an event."""
    events = _json(spark, path, MARKETS_RAW)
    return events.select("slug", "title", "tags", F.inline("markets")).withColumns({"binary": binary(F.col("outcomes")), "winner": winner(F.col("outcomes"), F.col("outcomePrices"))})


def resolved_winners(primary: DataFrame, backstop: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cond, winner`` of wanted markets, the first source before the second."""
    return wanted.join(primary.select("cond", F.col("winner").alias("w1")), "cond", "left").join(backstop.select("cond", F.col("winner").alias("w2")), "cond", "left").select("cond", F.coalesce("w1", "w2").alias("winner"))


def settled_bets(spark: SparkSession, path: str) -> DataFrame:
    """Redeemable positions as bets; won from the final price, else from the sign of the profit, else unknown."""
    p = _json(spark, path, POSITIONS_RAW).where("redeemable and avgPrice > 0.0001 and avgPrice < 0.9999")
    pnl = F.coalesce("realizedPnl", F.lit(0.0)) + F.coalesce("cashPnl", F.lit(0.0))
    won = F.when(F.col("curPrice").isNotNull(), F.col("curPrice") >= 0.5).when(pnl != 0, pnl > 0)
    return p.select(F.lower("wallet").alias("wallet"), F.col("conditionId").alias("cond"), F.col("avgPrice").alias("entry"), F.col("initialValue").alias("stake"), pnl.alias("pnl"), won.alias("won"), outcome(F.col("outcome"), F.lit(None).cast("int")).alias("outcome"), F.col("eventSlug").alias("event_group"))


def hex_number(x: Column, decimals: int) -> Column:
    """A hexadecimal amount in units of its token: summed from groups of twelve digits, so no digit is lost; null if it is none."""
    digits = F.regexp_replace(F.lower(x), "^0x0*", "")
    padded = F.lpad(digits, 72, "0")
    total = F.lit(0.0)
    for k in range(6):
        total = total * 2.0**48 + F.conv(F.substring(padded, 12 * k + 1, 12), 16, 10).cast("double")
    return F.when(digits.rlike("^[0-9a-f]{0,72}$") & x.rlike("^0x"), total / 10**decimals)


LOGS_RAW = "address string, topics array<string>, data string, blockNumber string, timeStamp string, transactionHash string"
CANDLES_RAW = "market string, t long, p double, yes_price double, volume double"
PROFILES_RAW = "wallet string, kind string, t long, p double, name string, volume double, traded long, pnl double"
NEWS_RAW = "title string, source string, ts long, entity string"
POOL_RAW = "wallet string, first_ts long, max_stake double, wins long, bets long"


def inbound_logs(spark: SparkSession, path: str, decimals: int = 6) -> DataFrame:
    """``from, to, value, block, hash`` of transfer logs: addresses from their padded topics, amounts from their data."""
    rows = _json(spark, path, LOGS_RAW)
    return rows.select(unpadded_address(F.get("topics", F.lit(1))).alias("from"), unpadded_address(F.get("topics", F.lit(2))).alias("to"), hex_number(F.col("data"), decimals).alias("value"), hex_number(F.col("blockNumber"), 0).cast("long").alias("block"), F.col("transactionHash").alias("hash"))


def open_markets(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """``cond, question, category, volume, token`` of open binary markets in scope, most traded first; a report of ``top`` if asked."""
    rows = markets(spark, path).where("binary and not closed")
    rows = rows.select(F.col("conditionId").alias("cond"), "question", text.category(F.col("tags"), F.col("question")).alias("category"), F.col("volume24hr").alias("volume"), F.get(F.from_json("clobTokenIds", "array<string>"), F.lit(0)).alias("token"))
    rows = rows.where("category is not null").orderBy(F.desc_nulls_last("volume"), "cond")
    return rows if top is None else rows.limit(top)


def market_meta(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Markets of the keys in ``wanted`` (``cond``)."""
    return markets(spark, path).withColumnRenamed("conditionId", "cond").join(wanted.select("cond").distinct(), "cond", "left_semi")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """``wallet, name, pnl, volume, traded``: profit is the last point of the profit curve, else what the leaderboard says."""
    rows = _json(spark, path, PROFILES_RAW)
    last = F.max_by("p", F.when((F.col("kind") == "curve") & F.col("p").isNotNull(), F.col("t")))
    board = F.max(F.when(F.col("kind") == "board", F.col("pnl")))
    return rows.groupBy(F.lower("wallet").alias("wallet")).agg(F.max("name").alias("name"), F.coalesce(last, board).alias("pnl"), F.max("volume").alias("volume"), F.max("traded").alias("traded"))


def candles(spark: SparkSession, path: str) -> DataFrame:
    """``market, t, p, volume`` of price points strictly between 0 and 1; prices in cents are brought to dollars."""
    price = F.coalesce("p", F.when(F.col("yes_price") > 1, F.col("yes_price") / 100).otherwise(F.col("yes_price")))
    return _json(spark, path, CANDLES_RAW).select("market", "t", price.alias("p"), "volume").where("p > 0 and p < 1")


def news_items(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, NEWS_RAW)


def wallet_pool(spark: SparkSession, path: str) -> DataFrame:
    """The pool of screened wallets; of rows that repeat a wallet the one with most bets."""
    rows = _json(spark, path, POOL_RAW)
    return rows.groupBy("wallet").agg(F.max(F.struct("bets", "first_ts", "max_stake", "wins")).alias("b")).select("wallet", "b.first_ts", "b.max_stake", "b.wins", "b.bets")


def append_pool(rows: DataFrame, path: str) -> None:
    """Add rows to the pool's folder; readers see a whole batch or none of it."""
    rows.select("wallet", "first_ts", "max_stake", "wins", "bets").write.mode("append").json(path)


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed values: courts, exchange labels, baselines."""
    return spark.createDataFrame(rows, schema)


def unpadded_address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, -40, 40)))


def transfers(spark: SparkSession, path: str, contracts: list[str], decimals: int = 6) -> DataFrame:
    t = _json(spark, path, TRANSFERS_RAW).where(F.lower("contractAddress").isin(*[c.lower() for c in contracts]))
    return t.select(F.lower("from").alias("from"), F.lower("to").alias("to"), (F.col("value").try_cast("double") / 10**decimals).alias("value"), F.col("timeStamp").alias("ts"), F.col("blockNumber").alias("block"), "hash")


def dockets(spark: SparkSession, path: str) -> DataFrame:
    """A row for each docket of landed search pages, each id once."""
    rows = _json(spark, path, DOCKETS_RAW, multi=True).select(F.inline("results"))
    return rows.select("docket_id", F.col("caseName").alias("case_name"), "court_id", F.col("dateFiled").alias("filed"), F.col("dateTerminated").alias("terminated"), F.col("docketNumber").alias("number"), F.col("suitNature").alias("suit_nature"), F.col("docket_absolute_url").alias("url"), "party", F.col("_query").alias("query")).dropDuplicates(["docket_id"])


def matters(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MATTERS)


def press_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items with entities and tags taken out of their texts."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    clean = lambda c: text.decode_entities(F.col(c)).alias(c)
    return items.select(clean("title"), F.trim("link").alias("link"), "pubDate", clean("description"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_ranked(rows: DataFrame, path: str, order: list) -> None:
    """A ranked table: ranges of the order are dealt out, so files are in order and no task holds all."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
