"""SimHash near-duplicates by a Gray-order hierarchical index.

1. Every text gets a fingerprint; equal fingerprints become one node.
2. Upper nodes of the index are masked bit patterns: a node is filed under the pattern it shows on
   each of several masks. With ``exact`` masks (pigeonhole) any two fingerprints within the distance
   agree on one mask; drawn masks find such pairs with a stated likelihood.
3. The rows of an upper node are sorted by Gray rank and searched with :mod:`gray_index`. What leaves
   the task is a spanning star for each linked set, never all pairs.
4. Connected components over the stars give each document its class.
5. With ``similar`` those components are candidates only: the shingle sets of a component's nodes are
   compared exactly, pair by pair, and the classes are the components of the pairs that are similar enough.

An upper node with more than ``cap`` rows is dealt out as all pairs of its chunks of about ``cap``
rows, so every pair still meets in one task of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, packed, staged
from .components import connected_components
from .gray_index import gray_order, least_labels, linked_pairs
from .pieces import let_go

SEED = 42
CAP = 2048
PIECE = 1 << 15


@dataclass(frozen=True)
class SimHash:
    """``words`` in a shingle, ``bits`` of the fingerprint (64, 128, 256), ``distance`` that still links.

    ``differ`` replaces the exact masks by drawn ones, where the distance is too wide for pigeonhole: a
    pair whose bits differ with that chance shares a mask of b bits with a chance of (1 - differ)^b. b is such
    that an upper node holds about ``cap`` rows, ``mask_bits`` at least, and as many masks are drawn as
    make a pair meet with a chance of ``recall``.
    ``ties`` gives bits with exactly half the votes the bit of a hash of the whole text instead of 0.
    ``similar``, in percent, is the Jaccard similarity of shingle sets that links in the end; each distinct
    shingle then votes once, and equal sets are one node. 0: the fingerprints alone link.
    """

    words: int = 4
    bits: int = 64
    distance: int = 4
    differ: float = 0.0
    mask_bits: int = 14
    recall: float = 0.999
    ties: bool = False
    similar: int = 0
    cap: int = CAP


def _spread(hashes: np.ndarray, count: int) -> np.ndarray:
    """From one 64-bit hash a shingle to ``count`` of them: the hash itself, then mixed sums of it."""
    columns = [hashes]
    for k in range(1, count):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        columns.append(x ^ (x >> np.uint64(31)))
    return np.stack(columns, 1)


def _shingles(text: str | None, how: SimHash) -> tuple[bytes, np.ndarray]:
    """The text's words with single blanks, and one hash for each shingle; with ``similar``, in order and each once."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, one = b" ".join(parts), xxhash.xxh64_intdigest
    if not parts:
        return line, np.zeros(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    width = min(how.words, len(parts))
    begin, end = begin[: len(parts) - width + 1], end[width - 1 :]
    hashes = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), PIECE):
        b, e = begin[at : at + PIECE].tolist(), end[at : at + PIECE].tolist()
        hashes[at : at + PIECE] = np.fromiter((one(line[i:j], SEED) for i, j in zip(b, e, strict=True)), np.uint64, len(b))
    return line, np.unique(hashes) if how.similar else hashes


def _print(hashes: np.ndarray, own: int, how: SimHash) -> np.ndarray:
    """Fingerprint of these shingles; ``own`` decides ties. Long texts are voted on in pieces of a fixed number of shingles."""
    count = how.bits // 64
    if not len(hashes):
        return np.zeros(count, np.uint64)
    votes = np.zeros(how.bits, np.int64)
    for at in range(0, len(hashes), PIECE):
        rows = _spread(hashes[at : at + PIECE], count).astype(">u8").view(np.uint8)
        votes += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    bits = 2 * votes > len(hashes)
    if how.ties:
        mixed = _spread(np.array([own], np.uint64), count).astype(">u8").view(np.uint8)
        bits |= (2 * votes == len(hashes)) & np.unpackbits(mixed, axis=1)[0].astype(bool)
    return np.packbits(bits.astype(np.uint8)).view(">u8").astype(np.uint64)


def _set_mark(hashes: np.ndarray) -> int:
    """The node of a shingle set."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED + 1)


def fingerprint(text: str | None, how: SimHash = SimHash()) -> np.ndarray:
    """Big-endian words of the fingerprint. Null, empty and blank texts: all bits zero."""
    line, hashes = _shingles(text, how)
    return _print(hashes, _set_mark(hashes) if how.similar else xxhash.xxh64_intdigest(line, SEED + 1), how)


def _word_names(how: SimHash) -> list[str]:
    return [f"fp{k}" for k in range(how.bits // 64)]


def fingerprints(docs: DataFrame, how: SimHash, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp0, ...)``: words of the fingerprint as signed longs. One pass over the whole texts.

    Also ``text_hash``, and with ``similar`` ``node``, the mark of the shingle set.
    """
    names = _word_names(how)
    more = ["text_hash", *["node"] * bool(how.similar)]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names + more)])

    def run(batches):
        let_go()
        for batch in batches:
            found, marks = [], []
            for x in batch.column(1):
                line, hashes = _shingles(x.as_py(), how)
                marks.append(_set_mark(hashes) if how.similar else xxhash.xxh64_intdigest(line, SEED + 1))
                found.append(_print(hashes, marks[-1], how))
            words = np.array(found, np.uint64).reshape(-1, len(names))
            columns = [*(pa.array(words[:, k].astype(np.int64)) for k in range(len(names))), batch.column(2)]
            if how.similar:
                columns.append(pa.array(np.array(marks, np.uint64).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, schema)


def masks(how: SimHash, rows: int) -> list[list[int]]:
    """Bit positions of each mask.

    Exact: with b blocks, a pair within d bits agrees on b-d blocks at least, so each choice of b-d
    blocks is a mask. b is the least for which an upper node holds about ``cap`` of ``rows`` rows.
    """
    if how.differ:
        width = max(how.mask_bits, math.ceil(math.log2(max(1, rows) / how.cap)))
        count = math.ceil(math.log(1 - how.recall) / math.log1p(-((1 - how.differ) ** width)))
        draw, order = np.random.default_rng(SEED), []
        while len(order) < count * width:
            order += draw.permutation(how.bits).tolist()
        return [order[i * width : (i + 1) * width] for i in range(count)]
    for blocks in range(how.distance + 1, min(how.bits, how.distance + 6) + 1):
        edges = np.linspace(0, how.bits, blocks + 1).astype(int)
        parts = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        chosen = [sum(c, []) for c in combinations(parts, blocks - how.distance)]
        if rows / 2.0 ** min(map(len, chosen)) <= how.cap:
            break
    return chosen


def _routed(nodes: DataFrame, how: SimHash, chosen: list[list[int]]) -> DataFrame:
    """Each node once for each mask: ``key`` is the hash of the mask's number and the pattern on it."""
    names = _word_names(how)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "node", *names)])

    def run(batches):
        let_go()
        for batch in batches:
            words = np.stack([batch.column(1 + k).to_numpy() for k in range(len(names))], 1)
            node = batch.column(0).to_numpy()
            bits = np.unpackbits(words.astype(np.uint64).astype(">u8").view(np.uint8), axis=1)
            for number, positions in enumerate(chosen):
                pattern = np.zeros(len(node), np.uint64)
                for p in positions:
                    pattern = (pattern << np.uint64(1)) | bits[:, p].astype(np.uint64)
                key = pattern * np.uint64(1 << 12) + np.uint64(number)  # of patterns over 52 bits some share a key; no pair is lost
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), *(pa.array(words[:, k]) for k in range(len(names)))], names=schema.names)

    return nodes.select("node", *names).mapInArrow(run, schema)


def _search(batches, how: SimHash, names: list[str]):
    """Stars of the linked sets of each (key, one, two) group; groups arrive sorted, one after another."""

    def stars(block: pa.Table):
        head = [block.column(n).to_numpy() for n in ("key", "one", "two")]
        change = np.zeros(len(head[0]), bool)
        change[0] = True
        for column in head:
            change[1:] |= column[1:] != column[:-1]
        bucket = np.cumsum(change)
        words = np.stack([block.column(n).to_numpy() for n in names], 1).astype(np.uint64)
        order = gray_order(bucket, words)
        node = block.column("node").to_numpy()[order]
        label = least_labels(len(node), linked_pairs(bucket[order], words[order], how.distance))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if len(held) >= 32_768:
            last = [held.column(n)[-1].as_py() for n in ("key", "one", "two")]
            same = np.ones(len(held), bool)
            for n, v in zip(("key", "one", "two"), last, strict=True):
                same &= held.column(n).to_numpy() == v
            cut = int(np.argmax(same))
            if cut:
                yield stars(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
    if held is not None and len(held):
        yield stars(held.combine_chunks())


def stars(nodes: DataFrame, how: SimHash) -> DataFrame:
    """``(a, b)``: a spanning star of each linked set that some upper node holds."""
    names = _word_names(how)
    rows = nodes.count()
    routed = _routed(nodes, how, masks(how, rows))
    full = staged(routed.groupBy("key").count().where(F.col("count") > how.cap), "full")
    chunks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(how.cap)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (
        routed.join(full, "key", "left").withColumn("chunks", chunks).withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", *names)
    )
    together = dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return together.mapInArrow(lambda batches: _search(batches, how, names), "a long, b long")


def _similar_stars(node: np.ndarray, sets: list[np.ndarray], percent: int):
    """``(a, b)``: a spanning star of each set of nodes that pairs of ``percent`` Jaccard or more connect.

    Every node reached is compared with every node not reached yet, so no similar pair is passed over.
    """
    node, first = np.unique(node, return_index=True)
    sets = [sets[k] for k in first]
    size = np.array([len(x) for x in sets])
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.cumsum(size) - size
    has, rest = np.zeros(len(terms), bool), np.flatnonzero(size)
    left = flat
    while len(rest) > 1:
        hub, queue = rest[0], [rest[0]]
        rest, left = rest[1:], left[size[rest[0]] :]
        while queue and len(rest):
            k = queue.pop()
            own = flat[edge[k] : edge[k] + size[k]]
            has[own] = True
            shared = np.add.reduceat(has[left], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            has[own] = False
            hit = 100 * shared >= percent * (size[k] + size[rest] - shared)
            if hit.any():
                queue += rest[hit].tolist()
                yield node[rest[hit]], np.repeat(node[hub], int(hit.sum()))
                left, rest = left[np.repeat(~hit, size[rest])], rest[~hit]


def _compare(batches, percent: int):
    """Stars of each (group, one, two), whose rows arrive one after another."""
    kinds = ("group", "one", "two")
    held: pa.Table | None = None

    def stars(block: pa.Table):
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in block.column("shingles")]
        found = list(_similar_stars(block.column("node").to_numpy(), sets, percent))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        head = [held.column(n).to_numpy() for n in kinds]
        change = np.zeros(max(0, len(held) - 1), bool)
        for column in head:
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield stars(held.slice(start, end - start))
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield stars(held)


def similar_stars(docs: DataFrame, nodes: DataFrame, edges: DataFrame, how: SimHash, id_col: str, text_col: str) -> DataFrame:
    """``(a, b)``: stars of nodes whose shingle sets are similar, found by exact comparison inside the components of ``edges``.

    Only the texts of nodes with an edge are read again, one for each node. A component of many nodes
    is dealt out as all pairs of its chunks, so that each pair meets in one task of bounded size.
    """
    groups = staged(connected_components(edges).withColumnRenamed("component", "group"), "groups")
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    asked = nodes.join(groups, "node").join(sizes, "group").select("group", "node", "size", F.col("one_of.id").alias("at"), F.col("one_of.text_hash").alias("at_hash"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    read = texts.join(staged(asked, "asked"), F.col("id").eqNullSafe(F.col("at")) & (F.col("text_hash") == F.col("at_hash")))

    def run(batches):
        for batch in batches:
            sets = [_shingles(x.as_py(), how)[1].astype("<u8").tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["group", "node", "size", "shingles"])

    sets = read.select("group", "node", "size", "text").mapInArrow(run, "group long, node long, size long, shingles binary")
    chunk = F.greatest(F.lit(how.cap // 8), F.least(F.lit(how.cap), F.ceil(F.col("size") / 8)))
    dealt = (
        sets.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("group", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", "shingles")
    )
    together = dealt.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two")
    percent = how.similar
    return together.mapInArrow(lambda batches: _compare(batches, percent), "a long, b long")


def _classes(docs: DataFrame, how: SimHash, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, fp0..., class, first`` of each row: its class, and the least id of the class."""
    names = _word_names(how)
    prints = staged(fingerprints(docs, how, id_col, text_col), "prints")
    least = F.min("id").alias("least")
    if how.similar:
        key = ["node"]
        nodes = prints.groupBy("node", *names).agg(least, F.min(F.struct("id", "text_hash")).alias("one_of"))
    else:
        key = names
        nodes = prints.groupBy(*names).agg(least).withColumn("node", F.col("fp0") if len(names) == 1 else F.xxhash64(*names))
    distinct = staged(nodes, "nodes")
    edges = staged(stars(distinct, how), "stars")
    if how.similar:
        candidates, edges = edges, staged(similar_stars(docs, distinct, edges, how, id_col, text_col), "similar")
        dropped(candidates)
    found = connected_components(edges)
    placed = staged(distinct.join(found, "node", "left").withColumn("class", F.coalesce("component", "node")), "placed")
    dropped(edges)
    first = placed.groupBy("class").agg(F.min("least").alias("first"))
    classes = staged(placed.join(first, "class").select(*key, "class", "first"), "classes")
    dropped(placed)
    dropped(distinct)
    return prints.join(classes, key).select("id", "text_hash", *names, "class", "first")


def near_duplicate_classes(docs: DataFrame, how: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp0``..., ``component`` (least id reachable by links).

    Null, empty and blank texts share the zero fingerprint and link like any other. Repeated rows
    and ties of ids stay. Rows with a null id stay; such ids are passed over for the least. An empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    return _classes(docs, how, id_col, text_col).select("id", *_word_names(how), F.col("first").alias("component"))


def drop_near_duplicates(docs: DataFrame, how: SimHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one with the least id; same columns.

    A null id comes after all others. Of rows that repeat the least id the one with the least hash of
    its text stays, and of rows that repeat both any one. Rows of other classes stay, whatever their ids.
    """
    found = _classes(docs, how, id_col, text_col)
    order = [F.col("id").isNull().alias("none"), "id", "text_hash"]
    keep = found.groupBy("class").agg(F.min(F.struct(*order)).alias("one")).select(F.col("one.id").alias("kept_id"), F.col("one.text_hash").alias("kept_hash"))
    rows = packed(docs, id=docs[id_col], text_hash=F.xxhash64(docs[text_col]))
    joined = rows.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    return joined.dropDuplicates(["id", "text_hash"]).select("row.*")
