"""Connected components of an edge table by alternating large and small stars.

Each round joins edges with the least neighbour of their ends; nothing is gathered per node, so a
hub costs a join that adaptive execution can split. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, staged


def _ordered(a, b) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the least node reachable.

    Null ends, loops and repeated edges are ignored. An empty table gives an empty result.
    """
    clean = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = staged(clean.select(*_ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        big = staged(large.distinct(), "big")
        low = staged(big.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = big.join(low, "u").where("v <> m").select(*_ordered(F.col("v"), F.col("m")))
        new = staged(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _mark(new)
        for old in (now, least, big, low):
            dropped(old)
        now, done, mark = new, after == mark, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = tops.select(F.col("component").alias("node"), "component").distinct()
    return tops.unionAll(roots)
