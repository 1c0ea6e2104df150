"""As-of joins, names in texts, tables by buckets and the streamed queue, against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import asof, lifecycle, publish
from tapewatch.sources.shared import staged
from tapewatch.streaming import tables

BET = "wallet string, cond long, outcome string, stake double, z double, pnl double, from_feed boolean, ts long"


@pytest.mark.parametrize("block", [7, 1000])
def test_counts_and_newest_equal_plain_versions(spark, block):
    r = random.Random(block)
    found = [(r.choice(["a", "b", None, "c"]), r.randint(0, 200), i) for i in range(150)]
    asked = [(i, r.choice(["a", "b", None, "d"]), r.randint(0, 200)) for i in range(120)]
    f, a = spark.createDataFrame(found, "entity string, ts long, doc int"), spark.createDataFrame(asked, "id int, entity string, ts long")
    got = {x["id"]: (x["x"], x["y"]) for x in asof.counted(a, f, "entity", {"x": F.col("ts"), "y": F.col("ts") - 30}, block).collect()}
    assert got == {i: tuple(sum(k == key and t <= at - off for k, t, _ in found) for off in (0, 30)) for i, key, at in asked}
    pairs: dict = {}
    for x in asof.newest_within(a, f, "entity", 20, 60, 3, ["doc"]).collect():
        pairs.setdefault(x["id"], set()).add((x["found"]["ts"], x["found"]["doc"]))
    for i, key, at in asked:
        reach = sorted((t, d) for k, t, d in found if k == key and at - 20 <= t <= at + 60)
        assert pairs.get(i, set()) == set(reach[-3:])
    numbers = {x["doc"]: x["number"] for x in asof.numbered(f, "entity", ["doc"], block).collect()}
    for key in ("a", "b", None, "c"):
        assert [numbers[d] for _, d in sorted((t, d) for k, t, d in found if k == key)] == list(range(1, 1 + sum(k == key for k, *_ in found)))


def test_names_in_texts_equal_a_plain_version(spark):
    r = random.Random(8)
    letters = "abAB é"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 30))), None if i % 5 == 0 else "".join(r.choice(letters) for _ in range(r.randint(0, 9)))) for i in range(200)] + [(900, None, None), (901, "Iranian oil", ""), (902, "x", "IRAN"), (903, "of Ira", "n")]
    names = ["ab", "abA", "É a", "bbbbb", "Iran", "aba b", "zzz", None, ""]
    docs = spark.createDataFrame(texts, "id int, title string, abstract string").withColumn("_low", F.lit(1))
    got = {(x["entity"], x["id"]) for x in asof.containing(spark.createDataFrame([(n,) for n in names], "entity string"), docs, ["title", "abstract"]).collect()}
    assert got == {(n, i) for n in names if n and len(n) >= 3 for i, t, a in texts if n.lower() in (t or "").lower() or n.lower() in (a or "").lower()} and ("Iran", 901) in got


def test_no_text_is_broadcast(spark):
    """small files hold many rows of equal texts."""
    docs = staged(spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, "Iranian oil").otherwise("none").alias("title"), F.lit(None).cast("string").alias("abstract"), F.col("id").alias("ts")))
    found = asof.containing(spark.createDataFrame([("Iran",)], "entity string"), docs, ["title", "abstract"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2500 and plan.count("SortMergeJoin") == 3


def test_documents_of_a_bet(spark):
    day = 86_400
    docs = spark.createDataFrame([(1, "Iran deal", None, 10 * day), (2, "other", "on IRANIAN oil", 20 * day), (3, "Iraq", "", 20 * day), (4, "iran again", None, 200 * day)], "id int, title string, abstract string, ts long")
    bets = spark.createDataFrame([(1, "Iran", 15 * day), (2, "Iran", 300 * day), (3, None, 15 * day), (4, "Ir", 15 * day)], "bet_id int, entity string, ts long")
    assert [tuple(x) for x in publish.document_matches(bets, docs).collect()] == [(1, 1, 2)]


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part")}


def test_bucket_table_over_four_batches(spark, tmp_path):
    r = random.Random(2)
    key = ("wallet", "cond", "outcome")
    table = tables.BucketTable(str(tmp_path), key, lifecycle.accumulated, buckets=16)
    whole, batches = None, []
    for k in range(4):
        rows = {(f"w{r.randint(0, 5 if k else 60)}", r.randint(0, 3), r.choice(["YES", "NO"])): None for _ in range(80 if k == 0 else 5)}
        batches.append([(*x, float(r.randint(1, 99)), r.choice([None, 2.5]), float(r.randint(-9, 9)), r.random() < 0.3, r.randint(0, 1000)) for x in rows])
    for k, batch in enumerate(batches):
        before = files(tmp_path / "data")
        new = spark.createDataFrame(batch, BET)
        table(new, k)
        after = files(tmp_path / "data")
        assert all(after[f] == t for f, t in before.items())
        touched = {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)}
        assert k == 0 or 0 < len(touched) <= len(batch) < 16
        whole = spark.createDataFrame(lifecycle.accumulated(new.limit(0) if whole is None else whole, new).collect(), BET)
        assert sorted(map(str, table.read(spark).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    table(spark.createDataFrame(batches[3], BET), 3)
    assert sorted(map(str, table.read(spark).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    table(spark.createDataFrame([], BET), 4)
    assert table.read(spark).count() == whole.count()


def test_streamed_queue_equals_batches(spark, tmp_path):
    day = 86_400
    scans = "engine string, market long, ts long, id long, score long"
    batches = [[("a", 1, 0, 1, 10), ("a", 1, 5, 2, 30), ("a", 2, 3, 3, 30), ("b", 1, 1, 4, 1)], [("a", 1, 9 * day, 5, 10)], [("a", 1, 16 * day, 6, 10)], [], [("a", 2, 40 * day, 7, 30)]]
    queue = tables.QueueStream(str(tmp_path), least=20)
    for k, batch in enumerate(batches):
        queue(spark.createDataFrame(batch, scans), k)
    queue(spark.createDataFrame(batches[4], scans), 4)
    said = sorted((x["ts"], x["engine"], x["market"], x["type"]) for x in queue.audit(spark).collect())
    assert sorted(s[1:] for s in said) == sorted([("a", 1, "appear"), ("a", 2, "appear"), ("b", 1, "appear"), ("a", 1, "tier"), ("a", 2, "retire"), ("b", 1, "retire"), ("a", 1, "retire")])
    assert {(x["engine"], x["market"]): (x["status"], x["tier"]) for x in queue.read(spark).collect()} == {("a", 1): ("retired", "Watch"), ("a", 2): ("active", "Elevated"), ("b", 1): ("retired", "Watch")}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    table = tables.BucketTable(str(tmp_path / "t"), ("id",), lambda old, new: new, buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table(spark.range(1000), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert table.read(spark).distinct().count() == 1000
    assert len(list((tmp_path / "t/data/version=0/bucket=0").glob("*.parquet"))) > 1
