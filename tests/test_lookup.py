"""Reports of given wallets work on their markets alone."""

from tapewatch.operators import lookup


def test_closure_has_whole_markets_and_no_others(spark):
    trades = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("b", 2, 3.0), ("c", 2, 4.0), ("c", 3, 5.0), (None, 1, 6.0), ("a", None, 7.0)], "wallet string, cond long, usd double")
    asked = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "wallet string")
    assert sorted(r["usd"] for r in lookup.closure(trades, asked).collect()) == [1.0, 2.0, 6.0]
    bets = spark.createDataFrame([("a", "Politics"), ("a", "Sports"), ("a", None), ("b", "Politics")], "wallet string, category string")
    assert sorted(map(str, lookup.in_scope(bets, asked).collect())) == ["Row(wallet='a', category='Politics')", "Row(wallet='a', category=None)"]


def test_filters_reach_the_read(spark, tmp_path):
    spark.range(1000).selectExpr("concat('w', id % 50) as wallet", "id % 200 as cond", "1.0 as usd").write.parquet(str(tmp_path / "t"))
    found = lookup.closure(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([("w3",)], "wallet string"))
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
