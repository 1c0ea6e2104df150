"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook; a cell of the product grid is a pair of
codes. Every vector is filed in its nearest cell. As a query it visits the cells nearest to it in
multi-sequence order (ascending sum of its halves' distances), as many as the target recall needs,
and each pair met there is verified by its cosine in double precision. A pair is met from the side of its
lesser node, so it counts once. Equal vectors are one node with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import staged
from .components import connected_components
from .gray_index import least_labels

SAMPLE = 20_000  # vectors that the codebooks and the number of visits are fitted on, at least
PER_CODE = 8  # of them for each code, at least
CELLS = 1 << 22  # distances held at once
FILL = 64  # vectors in a cell, on average
CAP = 4096  # rows of one side that meet in one task at once
FULL = 100_000  # cells over CAP that are sent to all tasks at most
RECALL = 0.99
PAIRS = 50  # of a sampled vector that the number of visits is fitted on


def codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly drawn points; fewer points than codes are all codes."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= codes:
        return distinct
    centres = distinct[np.random.default_rng(5).choice(len(distinct), codes, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmin(_apart(p, centres), 1) for p in _slices(points, codes)])
        total, n = np.zeros_like(centres), np.bincount(nearest, minlength=codes)
        np.add.at(total, nearest, points)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]


def _slices(points: np.ndarray, width: int) -> list[np.ndarray]:
    """The rows in slices, so that ``width`` numbers for each row stay bounded."""
    step = max(1, CELLS // max(1, width))
    return [points[at : at + step] for at in range(0, len(points), step)]


def nearest_cells(unit: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The first ``visits`` cells of each row's multi-sequence, nearest first.

    With each half's codes sorted by distance, the pair of ranks (i, j) has (i+1)(j+1)-1 pairs before it
    at least, so only pairs with (i+1)(j+1) <= visits are looked at.
    """
    if len(unit) > (step := max(1, CELLS // (len(books[0]) + len(books[1])))):
        return np.concatenate([nearest_cells(unit[at : at + step], books, visits) for at in range(0, len(unit), step)])
    half = books[0].shape[1]
    one, two = _apart(unit[:, :half], books[0]), _apart(unit[:, half:], books[1])
    visits = min(visits, one.shape[1] * two.shape[1])
    a, b = np.argsort(one, 1, kind="stable"), np.argsort(two, 1, kind="stable")
    i, j = np.divmod(np.arange(min(visits, one.shape[1]) * min(visits, two.shape[1])), min(visits, two.shape[1]))
    able = (i + 1) * (j + 1) <= visits
    i, j = i[able], j[able]
    total = np.take_along_axis(one, a, 1)[:, i] + np.take_along_axis(two, b, 1)[:, j]
    first = np.argsort(total, 1, kind="stable")[:, :visits]
    return np.take_along_axis(a[:, i], first, 1) * len(books[1]) + np.take_along_axis(b[:, j], first, 1)


def _visits(unit: np.ndarray, books: tuple, least: float, recall: float) -> int:
    """Cells that a query must visit to meet ``recall`` of the sample's pairs; where the sample has few,
    pairs at the limit are made from it."""
    rng = np.random.default_rng(6)
    asked = unit[rng.permutation(len(unit))[:1500]]
    pairs = [(asked[i], unit[k]) for i in range(len(asked)) for k in np.flatnonzero(unit @ asked[i] >= least)[:PAIRS] if not np.array_equal(unit[k], asked[i])]
    if len(pairs) < 200:
        aside = rng.normal(size=asked.shape)
        aside -= (aside * asked).sum(1)[:, None] * asked
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        if asked.shape[1] > 1 and (norm > 0).all():
            # at the limit itself, where a pair is hardest to meet
            pairs += list(zip(asked, least * asked + np.sqrt(1 - least**2) * aside / norm, strict=True))
    if not pairs:
        return 1
    ask, found = np.array([p for p, _ in pairs]), np.array([p for _, p in pairs])
    grid = len(books[0]) * len(books[1])
    home, visits = nearest_cells(found, books, 1), 8
    while True:
        met = (nearest_cells(ask, books, visits) == home).any(1).mean()
        if met >= recall or visits >= grid:
            return min(visits, grid)
        visits = min(grid, visits * 3 // 2)


def _nodes(rows: DataFrame) -> DataFrame:
    same = rows.where("valid").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("embedding").alias("embedding"))
    return same.withColumn("node", F.coalesce("least", "k1"))


def _filed(nodes: DataFrame, books, visits: int, kind: str) -> DataFrame:
    """``cell, role, node, copies, vector``: each node once where it is filed (1) and where it asks (0).

    Vectors travel as numbers of their ``kind`` in the table and are brought to length 1 where they meet.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(2))
                cells = nearest_cells(_units(x), shared.value, visits)
                data = [v.tobytes() for v in x.astype(kind)]
                for k in range(-1, cells.shape[1]):
                    cell = cells[:, max(k, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(np.full(len(cell), int(k < 0), np.int32)), part.column(0), part.column(1), pa.array(data, pa.binary())], names=["cell", "role", "node", "copies", "vector"])

    return nodes.select("node", "copies", "embedding").mapInArrow(run, "cell long, role int, node long, copies long, vector binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(batches, least: float, kind: str):
    """``node, links, root`` of the linked nodes of each (cell, one, two) group; groups arrive one after another."""

    def block(part: pa.Table):
        role = part.column("role").to_numpy()
        node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
        unit = _units(np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(len(node), -1).astype(float))
        ask, filed = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        links = np.zeros(len(node), np.int64)
        names, name = np.unique(node, return_inverse=True)

        def pairs():
            for at in range(0, len(ask), 256):
                some = ask[at : at + 256]
                i, j = np.nonzero((unit[some] @ unit[filed].T >= least) & (node[some][:, None] < node[filed][None]))
                i, j = some[i], filed[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                yield name[i], name[j]

        label = least_labels(len(names), pairs())
        total = np.zeros(len(names), np.int64)
        np.add.at(total, name, links)
        linked = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(total[linked]), pa.array(names[label[linked]])], names=["node", "links", "root"])

    held: pa.Table | None = None
    keys = ("cell", "one", "two")
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        change = np.zeros(len(held) - 1, bool)
        for k in keys:
            x = held.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield block(held.slice(a, b - a))
        held = held.slice(edges[-1]).combine_chunks()
    if held is not None and len(held):
        yield block(held)


def _met(nodes: DataFrame, size: int, count: int, least: float, recall: float, sample: int, kind: str) -> DataFrame:
    """``node, links, root`` of the linked nodes among ``count`` vectors of one length."""
    codes = max(1, round((count / FILL) ** 0.5))
    chosen = nodes.orderBy(F.xxhash64("k1"), "k2").limit(max(sample, PER_CODE * codes)).select("embedding").toArrow().column(0).combine_chunks()
    unit, half = _units(_matrix(chosen)), max(1, size // 2)
    books = (codebook(unit[:, :half], codes), codebook(unit[:, half:], codes) if size > 1 else np.zeros((1, 0)))
    filed = _filed(nodes, books, _visits(unit, books, least, recall), kind)
    counts = filed.groupBy("cell").agg(F.ceil(F.sum("role") / CAP).cast("int").alias("homes"), F.ceil(F.sum(1 - F.col("role")) / CAP).cast("int").alias("guests"))
    # only cells over CAP are cut; they are few, and sent to all tasks only as long as they are
    full = staged(counts.where("homes > 1 or guests > 1"), "cells")
    full = F.broadcast(full) if full.count() <= FULL else full
    one = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    split = filed.join(full, "cell", "left").withColumns({"homes": one(F.col("homes")), "guests": one(F.col("guests"))})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("role") == 1, F.col("homes")).otherwise(F.col("guests"))).cast("int")
    dealt = split.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, if(role = 1, guests, homes) - 1)")))
    dealt = dealt.select("cell", F.expr("if(role = 1, own, other)").alias("one"), F.expr("if(role = 1, other, own)").alias("two"), "role", "node", "copies", "vector")
    met = dealt.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two").mapInArrow(lambda b: _verified(b, least, kind), "node long, links long, root long")
    return staged(met, "met")


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors``: ``id, n_links, component_id, kept``.

    n_links counts other rows at a cosine of ``least`` or more, equal vectors included. Null, empty and
    zero vectors and those with null or non-finite components link with nothing. Vectors of each length are
    compared among themselves. Repeated and null ids stay rows of their own; null ids are passed over
    for the least id. An empty table gives an empty result; other columns are not read.

    The codebooks, with a square root of one code for each ``FILL`` vectors, and the number of visits are
    fitted on ``sample`` vectors, ``PER_CODE`` for each code at least; every vector is filed and asks.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("valid", F.coalesce(fine & (F.size("embedding") > 0), F.lit(False))).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.hash("embedding"))
    nodes = staged(_nodes(rows), "nodes")
    keys = rows.select("id", "valid", "k1", "k2")
    sizes = nodes.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()
    if not sizes:
        return keys.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    met = None
    for size, count in sizes:
        own = _met(nodes.where(F.size("embedding") == size), size, count, least, recall, sample, kind)
        met = own if met is None else met.unionAll(own)
    total = met.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("k1", "k2", "node", "copies", "least").join(total, "node", "left").join(classes, "node", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), "least")
    known = staged(known, "known")
    first = known.groupBy("component").agg(F.min("least").alias("first"))
    known = staged(known.join(first, "component").select("k1", "k2", "n_links", "first"), "classes")
    placed = keys.join(known, ["k1", "k2"], "left")
    component = F.when(F.col("valid"), F.col("first")).otherwise(F.col("id"))
    out = placed.select("id", F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
