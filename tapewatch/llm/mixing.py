"""Mix sources to target weights: budgets down a tree, then a token-prefix of each leaf.

Levels of the tree are columns, say domain, language and source. Each node's budget is dealt to its
children by weight; a child that holds less than its share takes what it has, and its shortage goes to
its siblings; only what a whole branch can't hold reaches the siblings of its ancestors. A leaf's
budget is filled by seeded epochs: whole epochs first, then the prefix of the next epoch's order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import packed, staged

FEW_LEAVES = 100_000  # a plan of so many leaves is broadcast; a larger one is joined by shuffling
PARTS = 1024  # a leaf's order is summed up in this many parts
DIGITS = 6  # of a token, that budgets are rounded to


@dataclass(frozen=True)
class Mix:
    """``weights[path]`` of a node, path a tuple of its and its ancestors' names; a missing one weighs 1.

    ``share`` of all tokens is the total budget; ``epochs`` bounds how often a document is taken.
    """

    levels: tuple[str, ...]
    weights: dict[tuple, float] = field(default_factory=dict)
    share: float = 1.0
    epochs: int = 1
    seed: int = 17


def _same(one: DataFrame, two: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names, nulls equal too; the names come from ``one``."""
    two = two.select(*(F.col(c).alias(f"_same_{k}") for k, c in enumerate(names)), *(c for c in two.columns if c not in names))
    on = F.lit(True)
    for k, c in enumerate(names):
        on = on & one[c].eqNullSafe(F.col(f"_same_{k}"))
    return one.join(two, on, how).drop(*(f"_same_{k}" for k in range(len(names))))


def _dealt(children: DataFrame, parent: list[str]) -> DataFrame:
    """Each child's ``amount`` of its parent's ``budget``: its weight's share, or all its ``room`` if that is less.

    A child is full if the level (tokens for one unit of weight) reaches the ratio of its room to its weight;
    what full children leave raises the level of the others. In ascending order of the ratio, all full
    children come first, so the level is found from running sums. Only distinct ratios are put in order.
    Children without weight get, alike, what the weighted ones can't hold.
    """
    rest = F.col("weight") <= 0
    children = children.withColumns({"rest": rest, "own": F.when(rest, F.lit(1.0)).otherwise(F.col("weight"))}).withColumn("ratio", F.col("room") / F.col("own"))
    cells = children.groupBy(*parent, "rest", "ratio").agg(F.sum("room").alias("room"), F.sum("own").alias("own"), F.max("budget").alias("budget"))
    held = F.coalesce(F.sum("room").over(Window.partitionBy(*parent).orderBy("rest", "ratio").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("own").over(Window.partitionBy(*parent, "rest").orderBy("ratio").rowsBetween(0, Window.unboundedFollowing))
    cells = cells.withColumn("level", F.greatest(F.lit(0.0), F.col("budget") - held) / open_)
    levels = cells.where("level < ratio").groupBy(*parent, "rest").agg(F.max("level").alias("level"))
    found = _same(children, levels, [*parent, "rest"], "left")
    return found.withColumn("amount", F.round(F.coalesce(F.least("room", F.col("level") * F.col("own")), "room"), DIGITS)).drop("rest", "own", "ratio", "level", "budget", "room", "weight")


def budgets(leaves: DataFrame, mix: Mix, total: float) -> DataFrame:
    """``leaves`` (the levels and ``supply`` tokens) with each leaf's ``budget``, dealt level by level down the tree.

    Budgets add up to the total, or to all that the leaves hold in ``epochs`` epochs. Null is a name of its own.
    """
    names, spark = list(mix.levels), leaves.sparkSession
    room = leaves.agg(F.sum("supply")).first()[0] or 0
    above = spark.createDataFrame([(float(min(total, room * mix.epochs)),)], "budget double")
    for k in range(1, len(names) + 1):
        here = leaves.groupBy(*names[:k]).agg((F.sum("supply") * F.lit(float(mix.epochs))).alias("room"))
        said = [(*path, float(w)) for path, w in mix.weights.items() if len(path) == k]
        fields = [T.StructField(c, T.StringType()) for c in names[:k]]
        weights = spark.createDataFrame(said, T.StructType([*fields, T.StructField("weight", T.DoubleType())]))
        weighted = _same(here, weights, names[:k], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        children = _same(weighted, above, names[: k - 1])
        above = staged(_dealt(children, names[: k - 1]).withColumnRenamed("amount", "budget"), "budgets")
    return _same(leaves, above, names)


def select(docs: DataFrame, mix: Mix, id_col: str, tokens_col: str) -> DataFrame:
    """``id``, the levels, ``tokens`` and ``epoch``: one row for each time that a document is taken.

    A document is taken while the tokens before it in its leaf's order are less than the budget, so a
    leaf may exceed it by one document. Null levels are a node of their own and stay null; null tokens
    count 0, and documents without tokens are taken with every epoch that reaches them. Null and repeated
    ids stay rows of their own.
    """
    levels = list(mix.levels)
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).cast("string").alias(c) for c in levels), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("tokens"))
    rows = staged(rows, "mix")
    leaves = staged(rows.groupBy(*levels).agg(F.sum("tokens").alias("supply")).withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    count, supply = leaves.agg(F.count("*"), F.sum("supply")).first()
    whole = F.when(F.col("supply") > 0, F.least(F.lit(mix.epochs), F.floor(F.col("budget") / F.col("supply")))).otherwise(F.lit(mix.epochs)).cast("int")
    plan = budgets(leaves, mix, mix.share * (supply or 0)).withColumn("whole", whole)
    plan = plan.withColumn("part_budget", F.when(F.col("whole") < mix.epochs, F.col("budget") - F.col("whole") * F.col("supply")).otherwise(F.lit(0.0)))
    plan = staged(plan.select(*levels, "leaf", "whole", "part_budget"), "plan")
    order = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col("whole"), F.col("id").cast("string")))
    piece = (F.conv(F.substring("order", 1, 3), 16, 10).cast("int") / F.lit(4096 // PARTS)).cast("int")
    placed = _same(rows, F.broadcast(plan) if count <= FEW_LEAVES else plan, levels).withColumn("order", order).withColumn("piece", piece)
    pieces = placed.groupBy("leaf", "piece").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("leaf").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("leaf", "piece").orderBy("order", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(pieces, ["leaf", "piece"])
    taken = F.col("whole") + (F.col("ahead") + F.col("inside") < F.col("part_budget")).cast("int")
    return summed.withColumn("taken", taken).where("taken > 0").select("id", *levels, "tokens", F.explode(F.expr("sequence(0, taken - 1)")).alias("epoch"))


def keep_selected(docs: DataFrame, mix: Mix, id_col: str, tokens: Column, levels: dict[str, Column]) -> DataFrame:
    """``docs`` once for each id that :func:`select` takes; same columns. Rows that repeat an id stay together.

    ``tokens`` and ``levels`` are columns of ``docs`` or made from them; no name of ``docs`` meets theirs.
    """
    rows = packed(docs, id=docs[id_col])
    chosen = select(docs.select(docs[id_col].alias("id"), tokens.alias("tokens"), *(levels[c].alias(c) for c in mix.levels)), mix, "id", "tokens")
    chosen = chosen.select(F.col("id").alias("taken_id")).distinct()
    return rows.join(chosen, F.col("id").eqNullSafe(F.col("taken_id")), "left_semi").select("row.*")
