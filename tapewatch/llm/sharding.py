"""Shards by best-fit-decreasing bin packing of groups that must stay together.

A group is all rows with equal texts. Groups are put into classes by weight: up to 65,535 bytes
exactly; above, groups whose sixteen leading bits are equal count as their mean, which is their weight but
for one part in 32,768. Groups of a class are packed as runs: best fit puts groups of one weight into
the same bin until it is full, so a run costs one step for each bin it enters. The driver gets the classes
(32,768 for each doubling above, whatever the input), packs them, and each group finds its bin by its
rank in its class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

PARTS = 256  # rows of one class or shard are ranked in this many parts, so no task ranks a whole one
BITS = 16


class _Node:
    __slots__ = ("high", "key", "left", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.high = key, None, None, 1


def _fix(node: _Node) -> _Node:
    high = lambda x: x.high if x else 0

    def up(x):
        x.high = 1 + max(high(x.left), high(x.right))
        return x

    def right(x):
        y = x.left
        x.left, y.right = y.right, x
        up(x)
        return up(y)

    def left(x):
        y = x.right
        x.right, y.left = y.left, x
        up(x)
        return up(y)

    lean = high(node.left) - high(node.right)
    if lean > 1:
        if high(node.left.left) < high(node.left.right):
            node.left = left(node.left)
        return right(node)
    if lean < -1:
        if high(node.right.right) < high(node.right.left):
            node.right = right(node.right)
        return left(node)
    return up(node)


class Room:
    """Bins in a height-balanced tree by (remaining capacity, bin)."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return _Node(key)
            if key < node.key:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return _fix(node)

        self.root = put(self.root)

    def take(self, weight: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is ``weight`` at least."""
        found, node = None, self.root
        while node:
            if node.key[0] >= weight:
                found, node = node.key, node.left
            else:
                node = node.right

        def drop(node, key):
            if key < node.key:
                node.left = drop(node.left, key)
            elif key > node.key:
                node.right = drop(node.right, key)
            else:
                if node.left is None:
                    return node.right
                if node.right is None:
                    return node.left
                least = node.right
                while least.left:
                    least = least.left
                node.key = least.key
                node.right = drop(node.right, least.key)
            return _fix(node)

        if found is not None:
            self.root = drop(self.root, found)
        return found


@dataclass(frozen=True)
class Run:
    """``count`` groups of class ``kind`` from ``first`` on (by rank in their class) go to ``bin``."""

    kind: int
    first: int
    count: int
    bin: int


def pack(classes: list[tuple[int, int, int]], capacity: int, bins: int | None = None) -> list[Run] | None:
    """Best fit, heaviest first. ``classes``: (kind, groups, bytes of all of them).

    A group heavier than the capacity gets a bin of its own. New bins open when no open one has room;
    None if more than ``bins`` would be needed.
    """
    room, opened, runs = Room(), 0, []
    for kind, groups, size in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        weight = max(1, -(-size // groups))
        first = 0
        while first < groups:
            found = room.take(weight)
            if found is None:
                if bins is not None and opened == bins:
                    return None
                found = (max(capacity, weight), opened)
                opened += 1
            fits = min(groups - first, found[0] // weight)
            runs.append(Run(kind, first, fits, found[1]))
            first += fits
            room.add((found[0] - fits * weight, found[1]))
    return runs


def pack_evenly(classes: list[tuple[int, int, int]], bins: int) -> list[Run]:
    """The least capacity, to one part in 2^16, at which ``bins`` bins are enough.

    Groups so heavy that the others couldn't fill a bin beside them get bins of their own first.
    """
    total, left, heavy, rest = sum(c[2] for c in classes), bins, [], sorted(classes, key=lambda c: (-c[2] / c[1], c[0]))
    while rest and left > 1 and rest[0][1] <= left - 1 and rest[0][2] / rest[0][1] > total / left:
        heavy.append(rest.pop(0))
        total, left = total - heavy[-1][2], left - heavy[-1][1]
    runs, at = [], 0
    for kind, groups, _ in heavy:
        runs += [Run(kind, k, 1, at + k) for k in range(groups)]
        at += groups
    low = max(1, -(-total // left))
    step, best = max(1, low >> 16), None
    under, over = 0, 1
    while (found := pack(rest, low + over * step, left)) is None:
        under, over = over, over * 2
    best = found
    while over - under > 1:
        middle = (under + over) // 2
        found = pack(rest, low + middle * step, left)
        under, over, best = (under, middle, found) if found is not None else (middle, over, best)
    return runs + [Run(r.kind, r.first, r.count, r.bin + at) for r in best]


def _class_of(weight: Column) -> Column:
    """Weights of up to ``BITS`` bits as they are, above rounded down to that many; heavier is larger."""
    extra = F.greatest(F.length(F.bin(weight)) - BITS, F.lit(0))
    return (F.expr("0L") + extra.cast("long")) * (1 << BITS) + F.call_function("shiftrightunsigned", weight, extra.cast("int"))


def _ranked(rows: DataFrame, by: str, order: list, out: str) -> DataFrame:
    """Add the rank (from 0) of each row within ``by``: ranks in parts, plus the rows of the parts before."""
    parts = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1
    placed = rows.withColumn("_own", own).join(parts, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_by", "_p", "_before")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """``id, size, text_crc32, shard, slot``: every row in one of ``shards`` shards of near equal bytes.

    Size is the text's UTF-8 bytes and ``overhead``; null and empty texts are one group. Rows with
    null or repeated ids stay. A group heavier than an even share has a shard of its own. Shards may
    stay empty where there are fewer groups. Slots count rows of a shard from 0. An empty table gives an
    empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key")), "rows")
    groups = rows.groupBy("text_key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    groups = staged(groups.withColumn("weight", F.col("copies") * F.col("size")).withColumn("kind", _class_of(F.col("weight"))), "groups")
    classes = [tuple(r) for r in groups.groupBy("kind").agg(F.count("*"), F.sum("weight")).collect()]
    runs = pack_evenly(classes, shards) if classes else []
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r.kind, r.first, r.first + r.count, r.bin) for r in runs], "kind long, first long, stop long, shard int")
    lists = plan.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("stop", "shard"))).alias("runs"))
    ranked = _ranked(groups.withColumn("_part", F.pmod("text_key", F.lit(PARTS)).cast("int")), "kind", ["text_key", "size", "text_crc32"], "rank")
    bins = ranked.join(F.broadcast(lists), "kind").select("text_key", "size", "text_crc32", F.expr("filter(runs, r -> rank < r.stop)[0].shard").alias("shard"))
    bins = staged(bins, "bins")
    placed = staged(rows.join(bins, ["text_key", "size", "text_crc32"]).select("id", "size", "text_crc32", "shard"), "placed")
    slots = _ranked(placed.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")), "shard", ["id", "text_crc32", "size"], "slot")
    return slots.select("id", "size", "text_crc32", "shard", "slot")
