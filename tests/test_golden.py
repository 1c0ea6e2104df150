"""Hand-checked values on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tapewatch.functions import stats
from tapewatch.operators import lifecycle, litigation, market, positions, wallet, watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "k", "p", "expected"), [(2, 2, 0.5, 0.25), (4, 2, 0.5, 11 / 16), (10, 10, 0.5, 1 / 1024), (5, 0, 0.5, 1.0), (3, 4, 0.5, 0.0), (16, 14, 0.11, 3.67e-12)])
def test_binomial_tail(spark, n, k, p, expected):
    got = one(spark, stats.binomial_tail(F.lit(n), F.lit(k), F.lit(p)))
    assert math.isclose(got, expected, rel_tol=1e-3, abs_tol=1e-15)


def test_normal_tail(spark):
    assert abs(one(spark, stats.upper_tail(F.lit(1.96))) - 0.0249979) < 1e-6
    assert abs(one(spark, stats.normal_cdf(F.lit(-1.0))) - 0.1586553) < 1e-6


MARKET = "cond long, winner string, event_group long, category string, resolved_ts long"
TRADE = "cond long, wallet string, side string, outcome string, price double, usd double, size double, ts long, tx long"


@pytest.mark.parametrize(("sold", "at", "pnl", "stake"), [(0, 0.0, 90_000, 10_000), (100_000, 0.12, 2_000, 0), (40_000, 0.15, 56_000, 4_000)])
def test_net_profit(spark, sold, at, pnl, stake):
    trades = [(1, "a", "BUY", "YES", 0.10, 10_000.0, 100_000.0, 1000, 1)] + ([(1, "a", "SELL", "YES", at, sold * at, float(sold), 2000, 2)] if sold else [])
    row = positions.net_positions(spark.createDataFrame(trades, TRADE), spark.createDataFrame([(1, "YES", 0, "Macro", 9000)], MARKET)).first()
    assert math.isclose(row["pnl"], pnl, abs_tol=1e-6) and math.isclose(row["stake"], stake, abs_tol=1e-6)


def test_false_discovery(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert wallet.false_discovery_cut(df, 0.05, least=1, ceiling=0.05).first()["cut"] == 0.0095
    assert wallet.false_discovery_cut(df, 0.05, least=500).first()["cut"] == 1.0


@pytest.mark.parametrize(("price", "points"), [(0.0, 0), (0.10, 31), (0.85, 0), (1.0, -25)])
def test_conviction(spark, price, points):
    assert one(spark, watch.conviction(F.lit(price), F.lit(5000.0))) == points


def test_hhi_and_wash(spark):
    v = spark.createDataFrame([(1, "a", 50.0, 50.0, 1, 1, 1), (1, "b", 50.0, 0.0, 1, 1, 1)], "cond long, wallet string, buy_usd double, sell_usd double, first_ts long, last_ts long, n long")
    assert market.concentration(v).first()["hhi"] == 0.5
    assert math.isclose(market.wash(v).first()["self_share"], 2 * 50 / 150)


def test_relevance_and_ids(spark):
    d = spark.createDataFrame([(1, "ACME V. STATE OF OHIO", ["Acme"], "850 x"), (2, "United States v. State of Ohio", [], "850 x"), (3, "X v. Y", ["venue co"], ""), (4, None, None, None)], "docket_id long, case_name string, party array<string>, suit_nature string")
    t = spark.createDataFrame([(1, "Venue", "venue co")], "rank int, platform string, needle string")
    got = {r["docket_id"]: (r["accept"], r["platform"]) for r in litigation.relevance(d, t).collect()}
    assert got == {1: (False, ""), 2: (True, "Other"), 3: (True, "Venue"), 4: (False, "")}
    assert one(spark, litigation.matter_id(F.lit("ACME & CO  vs. Jones"), F.lit(7))) == "acme-and-co-v-jones-cl7"
    assert one(spark, litigation.docket_of(F.lit("acme-v-jones-cl77"))) == 77


def test_newest_wins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert {tuple(r) for r in lifecycle.newest_wins(a, b, ["k"]).collect()} == {(1, "x"), (2, "z")}


def test_trim_settlement(spark):
    s = spark.createDataFrame([(1, t, t, p) for t, p in enumerate([0.2, 0.5, 0.7, 0.995, 1.0])], "market long, t long, id long, p double")
    assert market.trim_settlement(s).count() == 3


def test_interval_join_and_blackout(spark):
    from tapewatch.operators import publish

    bets = spark.createDataFrame([(1, 7, 100_000, 5000.0), (2, 7, 10, 5000.0), (3, 8, 100_000, 10.0)], "bet_id long, entity long, ts long, stake double")
    news = spark.createDataFrame([(7, 99_000), (7, 100_001), (7, 10_000)], "entity long, ts long")
    got = {r["bet_id"]: (r["n"], r["score"]) for r in publish.news_blackout(bets, news).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 1, 2: 0, 3: 0} and [got[k][1] for k in (1, 2, 3)] == pytest.approx([0.18, 0.6, 0.3])


def test_funding_network(spark):
    from tapewatch.operators import publish

    t = spark.createDataFrame([("h", "s", 5.0, 1), ("h", "x", 3.0, 2), ("k", "x", 9.0, 3)], "from string, to string, value double, ts long")
    got = publish.funding_network(t, spark.createDataFrame([("s",)], "wallet string")).collect()
    assert [tuple(r) for r in got] == [("s", "h", "x", 3.0, 2)]
