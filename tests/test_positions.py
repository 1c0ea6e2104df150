"""Positions and records: a busy market is spread over tasks, and medians need no maps of values."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapewatch.operators import positions, publish, validation, wallet, watchlist
from tapewatch.plans import catalog


def _trades(spark, wallets):
    return spark.range(wallets).select(
        F.lit(1).cast("long").alias("cond"), F.concat(F.lit("w"), "id").alias("wallet"), F.lit("BUY").alias("side"), F.lit("YES").alias("outcome"), F.lit(0.5).alias("price"),
        (F.col("id") % 9 + 1.0).alias("usd"), (F.col("id") % 9 + 1.0).alias("size"), (F.col("id") * 60).alias("ts"), F.col("id").alias("tx"),
    )


def _catalog(spark):
    return spark.createDataFrame([(1, "YES", 0, "Tech", 10**6, "q", "g:0")], "cond long, winner string, event_group long, category string, resolved_ts long, question string, corr_key string")


def test_one_market_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = positions.net_positions(_trades(spark, 2000), _catalog(spark)).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == 2000 and len(sizes) > 1


def test_median_stake_is_the_upper_one(spark):
    stakes = {"even": [10.0, 40.0, 20.0, 30.0], "odd": [5.0, 1.0, 3.0], "none": [0.0], "some": [0.0, 0.0, 7.0, None, 9.0]}
    rows = [(w, k, 0, "g:0", "YES", 0.5, x, 1.0, True, True, 1, None, 9, 0.0) for w, xs in stakes.items() for k, x in enumerate(xs)]
    bets = spark.createDataFrame(rows, "wallet string, cond long, event_group long, corr_key string, outcome string, entry double, stake double, pnl double, won boolean, held boolean, ts long, shock_ts long, resolved_ts long, z_profit double")
    found = wallet.records(bets)
    assert {r["wallet"]: (r["median_stake"], r["staked_bets"]) for r in found.collect()} == {"even": (30.0, 4), "odd": (3.0, 3), "none": (None, 0), "some": (9.0, 2)}
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_question_is_looked_through_once_a_market(spark):
    rows = spark.createDataFrame([(1, "a", "watching", 0.5, 9.0, 5), (2, "b", "watching", 0.5, 9.0, 5)], "cond long, wallet string, status string, price double, usd double, ts long")
    more = {c: F.lit(None).cast(t) for c, t in {"outcome": "string", "size_z": "double", "whale_x": "double", "vol_share": "double", "peers": "long", "flagged": "boolean", "fresh": "boolean", "blackout": "boolean", "anticipated": "boolean", "public_info": "boolean", "won": "boolean", "resolved_ts": "long"}.items()}
    known = _catalog(spark).withColumn("question", F.lit("Will the US strike Iran by March 3?"))
    out = watchlist.reconciled(rows.withColumns(more), known, spark.createDataFrame([], "wallet string"), 10)
    assert {r["cond"]: r["gone"] for r in out.collect()} == {1: "prune", 2: "purge"}  # 2 isn't in the catalogue
    above, _, _ = out._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert "question" not in above and "RLIKE" not in above


def test_cents_are_rounded_as_sql_does(spark):
    values = [1.005, -1.005, 2.675, 0.125, -0.125, 2463968.155, 502980.975, 1.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(catalog.cents("v").alias("v"))
    assert [r["v"] for r in rows.collect()] == [duckdb.execute("select round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values]


def test_bets_move_no_positions_to_small_market_tables(spark):
    plan = catalog._bets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_gated_records_meet_no_records_again(spark):
    bets = catalog._bets(spark, "/root/testdata/sf0.001")
    r = catalog._records(spark, "/root/testdata/sf0.001", bets)
    wide, joined = publish.record_context(wallet.fuse(r, keep=True)), publish.record_context(wallet.fuse(r), r)
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()
    columns = [c for c in joined.columns if c != "contribution"]
    assert set(joined.columns) == set(wide.columns) and wide.select(columns).exceptAll(joined.select(columns)).count() == 0 and wide.count() == joined.count()


def test_a_hash_has_two_draws_and_odds_keep_their_chance():
    n = 4096
    key, p = np.arange(n) * 2654435761, np.where(np.arange(n) % 2 == 0, 0.3, 0.9)
    p[:4] = [0, 1, np.nan, 1 - 1e-12]
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(p)], names=["key", "p"])
    drawn = {d: next(validation._drawn_wins(iter([batch]), d, block)).column(1).to_numpy() for d, block in ((2001, 1 << 15), (2000, 512))}
    assert len(drawn[2001]) == 2001 and (drawn[2001][:2000] == drawn[2000]).all()
    expected, sd = np.nansum(p), np.sqrt(np.nansum(p * (1 - p)))
    assert abs(drawn[2001].mean() - expected) < 4 * sd / 2001**0.5 and abs(drawn[2001].std() / sd - 1) < 0.08
    assert abs(np.corrcoef(drawn[2000][::2], drawn[2000][1::2])[0, 1]) < 0.13


def test_expected_wins_are_the_same_in_any_order_of_bets(spark):
    import math
    import random

    from tapewatch.functions import stats

    draw = random.Random(4)
    own = [draw.choice((0.1, 0.2, 0.3, 0.7, 0.07, 1e-6)) for _ in range(61)]
    for k in range(4):
        draw.shuffle(own)
        df = spark.createDataFrame([(v,) for v in [*own, None]], "v double").repartition(1 + k)
        got = df.agg(stats.exact_sum(F.col("v")).alias("s"), stats.exact_mean(F.col("v")).alias("m")).first()
        assert got["s"] == math.fsum(own) and got["m"] == math.fsum(own) / len(own)
    bets = [("w", f"g:{k}", k, v) for k, v in enumerate(own)]
    for k in range(4):
        draw.shuffle(bets)
        rows = spark.createDataFrame(bets, "wallet string, corr_key string, event_group long, entry double").selectExpr(
            "*", "100D as stake", "1D as pnl", "true as won", "true as held", "'YES' as outcome", "0L as ts", "10L as resolved_ts", "cast(null as long) as shock_ts", "0D as z_profit")
        assert wallet.records(rows).first()["expected"] == math.fsum(own)


def test_accumulated_bets_take_positions_once(spark):
    plan = catalog.QUERIES["accumulated_bets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("Relation") == 3  # trades, and the markets' facts of two steps
