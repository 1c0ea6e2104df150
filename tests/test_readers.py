"""Landed feeds in their raw shapes."""

import json

from pyspark.sql import functions as F

from tapewatch.sources import readers


def test_trades(spark, tmp_path):
    rows = [{"proxyWallet": "0xA", "conditionId": "m", "side": "buy", "size": "10", "price": 0.5, "outcome": "Yes", "timestamp": 5, "transactionHash": "t"}, {"maker": "0xB", "market": "m", "side": "SELL", "size": 2, "price": "0.25", "outcomeIndex": 1, "matchTime": 6}, {"user": "0xC", "size": 0}]
    path = tmp_path / "t.json"
    path.write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    got = sorted(tuple(r) for r in readers.trades(spark, str(path)).select("wallet", "side", "outcome", "usd", "ts").collect())
    assert got == [("0xa", "BUY", "YES", 5.0, 5), ("0xb", "SELL", "NO", 0.5, 6)]
    assert readers.wallet_trades(spark, str(path), "0xA").count() == 1


def test_markets(spark, tmp_path):
    event = {"slug": "s", "tags": ["x"], "markets": [{"conditionId": "m", "outcomes": '["Yes","No"]', "outcomePrices": '["0.99","0.01"]'}, {"conditionId": "n", "outcomes": '["A","B"]', "outcomePrices": '["1","0"]'}]}
    (tmp_path / "m.json").write_text(json.dumps(event))
    got = {r["conditionId"]: (r["binary"], r["winner"]) for r in readers.markets(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"m": (True, "YES"), "n": (False, None)}


def test_press_and_hex(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link> l </link><pubDate>x</pubDate><description>&lt;b&gt;t&lt;/b&gt;</description></item></channel></rss>")
    row = readers.press_items(spark, str(tmp_path / "f.xml")).first()
    assert (row["title"], row["link"], row["description"]) == ("A & B", "l", "t")
    x = spark.range(1).select(readers.hex_number(F.lit("0x0000000005f5e100"), 6).alias("n"), readers.unpadded_address(F.lit("0x" + "0" * 24 + "AB" * 20)).alias("a")).first()
    assert x["n"] == 100.0 and x["a"] == "0x" + "ab" * 20


def lines(tmp_path, name, rows):
    import json

    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_bad_lines_are_counted(spark, tmp_path):
    path = lines(tmp_path, "pool.json", [{"wallet": "a", "bets": 2, "wins": 1}, "{broken", {"wallet": "a", "bets": 5, "wins": 2}])
    assert tuple(readers.bad_lines(spark, path, readers.POOL_RAW).first()) == (3, 1, 2)
    assert [(r["wallet"], r["bets"]) for r in readers.wallet_pool(spark, path).collect()] == [("a", 5)]
    folder = str(tmp_path / "pool")
    for _ in range(2):
        readers.append_pool(readers.wallet_pool(spark, path), folder)
    assert readers.wallet_pool(spark, folder).count() == 1


def test_logs_and_large_amounts(spark, tmp_path):
    a, b = "0x" + "0" * 24 + "AB" * 20, "0x" + "0" * 24 + "cd" * 20
    path = lines(tmp_path, "logs.json", [{"topics": ["t", a, b], "data": hex(123_456_789), "blockNumber": "0x10", "transactionHash": "h"}, {"topics": ["t", a, b], "data": hex(10**24), "blockNumber": "0x11", "transactionHash": "i"}, {"topics": ["t", a, b], "data": "zz", "blockNumber": "0x12", "transactionHash": "j"}])
    got = {r["hash"]: r for r in readers.inbound_logs(spark, path).collect()}
    assert got["h"]["value"] == 123.456789 and got["i"]["value"] == 1e18 and got["j"]["value"] is None
    assert got["h"]["from"] == "0x" + "ab" * 20 and got["h"]["to"] == "0x" + "cd" * 20 and got["h"]["block"] == 16


def test_market_feeds(spark, tmp_path):
    def market(cond, question, volume, closed=False, prices='["0.98", "0.02"]'):
        return {"conditionId": cond, "question": question, "outcomes": '["Yes", "No"]', "outcomePrices": prices, "clobTokenIds": '["t1", "t2"]', "volume24hr": volume, "closed": closed}

    path = lines(tmp_path, "events.json", [{"slug": "s", "title": "t", "tags": ["World"], "markets": [market("c1", "Will NATO troops enter Iran?", 5.0), market("c2", "Will the FDA approve it?", 9.0), market("c3", "Will the Lakers win?", 99.0), market("c4", "Old election", 1.0, True)]}])
    assert [(r["cond"], r["category"], r["token"]) for r in readers.open_markets(spark, path, 2).collect()] == [("c2", "Legal & Regulatory", "t1"), ("c1", "Military & Defense", "t1")]
    wanted = spark.createDataFrame([("c4",), ("x",)], "cond string")
    assert [r["cond"] for r in readers.market_meta(spark, path, wanted).collect()] == ["c4"]
    first, second = spark.createDataFrame([("c4", None)], "cond string, winner string"), spark.createDataFrame([("c4", "NO"), ("x", "YES")], "cond string, winner string")
    assert {r["cond"]: r["winner"] for r in readers.resolved_winners(first, second, wanted).collect()} == {"c4": "NO", "x": "YES"}


def test_profiles_candles_and_positions(spark, tmp_path):
    path = lines(tmp_path, "profiles.json", [{"wallet": "A", "kind": "curve", "t": 1, "p": 5.0}, {"wallet": "a", "kind": "curve", "t": 9, "p": 7.5, "name": "n"}, {"wallet": "a", "kind": "board", "pnl": 99.0}, {"wallet": "b", "kind": "board", "pnl": -3.0, "volume": 10.0}])
    assert {r["wallet"]: (r["pnl"], r["name"]) for r in readers.profiles(spark, path).collect()} == {"a": (7.5, "n"), "b": (-3.0, None)}
    path = lines(tmp_path, "candles.json", [{"market": "m", "t": 1, "p": 0.4}, {"market": "m", "t": 2, "yes_price": 55.0}, {"market": "m", "t": 3, "p": 1.0}, {"market": "m", "t": 4, "yes_price": 0.2}])
    assert [(r["t"], r["p"]) for r in readers.candles(spark, path).orderBy("t").collect()] == [(1, 0.4), (2, 0.55), (4, 0.2)]
    base = {"wallet": "W", "avgPrice": 0.3, "initialValue": 10.0, "outcome": "Yes", "eventSlug": "e"}
    path = lines(tmp_path, "positions.json", [base | {"conditionId": "a", "redeemable": True, "curPrice": 1.0, "cashPnl": 5.0}, base | {"conditionId": "b", "redeemable": True, "realizedPnl": -4.0}, base | {"conditionId": "c", "redeemable": True}, base | {"conditionId": "d", "redeemable": False, "curPrice": 1.0}])
    assert {r["cond"]: (r["won"], r["pnl"]) for r in readers.settled_bets(spark, path).collect()} == {"a": (True, 5.0), "b": (False, -4.0), "c": (None, 0.0)}


def test_transfers_dockets_matters_and_sinks(spark, tmp_path):
    import json

    path = lines(tmp_path, "transfers.json", [{"from": "A", "to": "B", "value": "2500000", "timeStamp": 5, "contractAddress": "0xC"}, {"from": "A", "to": "B", "value": "1", "timeStamp": 6, "contractAddress": "0xD"}])
    assert [(r["from"], r["to"], r["value"]) for r in readers.transfers(spark, path, ["0xc"]).collect()] == [("a", "b", 2.5)]
    for k in (1, 2):
        (tmp_path / f"page{k}.json").write_text(json.dumps({"results": [{"docket_id": 7, "caseName": "X v. Y"}, {"docket_id": k + 10, "caseName": "Z"}]}))
    assert sorted(r["docket_id"] for r in readers.dockets(spark, str(tmp_path / "page*.json")).collect()) == [7, 11, 12]
    path = lines(tmp_path, "matters.json", [{"id": "m-cl7", "caption": "X v. Y", "states": ["NV"]}])
    assert readers.matters(spark, path).first()["states"] == ["NV"]
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id long, s double")
    readers.write_ranked(rows, str(tmp_path / "ranked"), [F.desc("s"), F.col("id")])
    readers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "ranked")).count() == 50 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 50


def test_press_items_are_decoded(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title><![CDATA[A &amp; B &#8212; c]]></title><link> http://x </link><pubDate>d</pubDate><description>&lt;b&gt;bold&lt;/b&gt; it&apos;s</description></item></channel></rss>")
    row = readers.press_items(spark, str(tmp_path / "feed.xml")).first()
    assert (row["title"], row["link"], row["description"]) == ("A & B — c", "http://x", "bold it's")


def test_lifecycle_tables(spark):
    from tapewatch.operators import lifecycle, watch

    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ts long")
    fresh = spark.createDataFrame([("b", 9), ("c", 3)], "id string, ts long")
    assert [(r["id"], r["ts"]) for r in lifecycle.rolling_history(old, fresh, 2).collect()] == [("b", 9), ("c", 3)]
    assert {r["id"]: r["ts"] for r in lifecycle.newest_wins(old, fresh, ["id"]).collect()} == {"a": 1, "b": 9, "c": 3}
    assert [r["id"] for r in lifecycle.newest(fresh, "ts", "id", 1).collect()] == ["b"]
    queue = spark.createDataFrame([("e", 1, "High-signal", "active", 100), ("e", 2, "Elevated", "active", 10), ("e", 3, "Watch", "retired", 50)], "engine string, market long, tier string, status string, last_scanned long")
    assert [r["market"] for r in lifecycle.new_alerts(queue, queue.where("market = 1")).collect()] == [2]
    assert tuple(lifecycle.staleness(queue, 110, 20).first()) == (100, 1, 2, 1)
    listed = spark.createDataFrame([("c1", "w1", "YES", 70), ("c1", "w2", "NO", 70), ("c2", "w1", "YES", 70), ("c3", "w1", "YES", 70)], "cond string, wallet string, outcome string, score int")
    catalog = spark.createDataFrame([("c1", "YES", 1000), ("c2", "YES", 10)], "cond string, winner string, resolved_ts long")
    got = watch.reconcile(listed, catalog, spark.createDataFrame([("w1",)], "wallet string"), now=2000, keep=1500)
    assert {(r["cond"], r["wallet"]): r["status"] for r in got.collect()} == {("c1", "w1"): "promoted", ("c1", "w2"): "cleared", ("c2", "w1"): "retired", ("c3", "w1"): "open"}


def test_repeated_entries_make_no_failure(spark):
    from tapewatch.operators import linkage

    wallets = spark.createDataFrame([("a", "f", 0), ("b", "f", 3600)], "wallet string, funder string, first_seen_ts long")
    entries = spark.createDataFrame([("a", 1, 50), ("a", 1, 10), ("b", 1, 20), ("b", 2, 5)], "wallet string, event_group long, ts long")
    row = linkage.funder_pairs(wallets, entries).first()
    assert (row["shared"], row["co_spend"], row["sync"]) == (1, 0.5, 1.0)


def test_concealment_needs_tactics(spark):
    from tapewatch.operators import wallet

    def tactics(**known):
        row = {"wallet": "w", "wins": 9, "decoys": 0, "reals": 0} | known
        names = {"wallet": "string", "wins": "bigint", "decoys": "bigint", "reals": "bigint"} | wallet.ACCOUNT
        one = spark.createDataFrame([tuple(row.get(c) for c in names)], ", ".join(f"{c} {t}" for c, t in names.items()))
        has, fires, score, measure = wallet.detector_columns()["conceal"]
        return tuple(one.select(F.coalesce(has, F.lit(False)), fires, F.round(score, 3), measure).first())

    assert tactics()[0] is False  # three wins alone say nothing
    assert tactics(has_profile=True) == (True, False, 0.15, 1.0)
    assert tactics(has_profile=True, cash_out_hours=24.0) == (True, True, 0.8, 2.0)
    assert tactics(split_ratio=0.5, decoys=3, reals=10) == (True, True, 0.8, 2.0) and tactics(username="n", has_profile=True)[0] is False
