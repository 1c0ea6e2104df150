"""Best-fit packing of tokenised documents into sequences by sums of squares.

A sequence is open while it has a gap. Each piece goes where the squared counts of open sequences per gap sum to
least: into a gap that many sequences share, leaving one that few have. Counts of gaps, one for each size, are all that
a placement looks at.

Pieces are dealt into chunks by hash and packed chunk by chunk, the longest first. Sequences that stay open at the end are taken apart
and packed again, now together with those of many other chunks, until one chunk holds the rest or nothing is gained.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, staged
from .pieces import Memory, kept

CAPACITY = 4096
CHUNK = 1 << 16
_PIECE = "key long, id long, piece int, start long, length long, ids_crc32 long, tokens binary"


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed one after another in the given order.

    Putting a piece of size s into a gap g takes one from the count of g and gives one to that of g - s; no gap and
    a new sequence are not counted. Halved, the sum changes by count[g - s] - count[g] + 1; the ends are off by a half.
    Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -np.inf)
    count[0], taken[capacity] = -0.5, 0.5
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gap = s + int(np.argmin(count[: capacity + 1 - s] - taken[s:]))
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = open_at[gap].pop()
            count[gap] -= 1
            taken[gap] = count[gap] or -np.inf
        sequences[i], offsets[i] = bin_, capacity - gap
        if rest := gap - s:
            open_at[rest].append(bin_)
            count[rest] += 1
            taken[rest] = count[rest]
    return sequences, offsets


def _memory(tokenizer_json: str) -> Memory:
    """The library's ids of pieces. A piece of Latin letters is one match of its pattern, so its model alone does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tokenizer_json)
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    whole, model = own.encode_batch_fast, own.model.tokenize

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for k, p in enumerate(pieces):
            word = p.removeprefix(" ")
            if word.isalpha() and max(word) <= "\xff":
                word = word.lower()
                out[k] = [t.id for t in model(word if word.isascii() else word.encode().decode("latin-1").translate(letters))]
            else:
                rest.append(k)
        for k, found in zip(rest, whole([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    return Memory(encode, "<u2" if own.get_vocab_size() <= 1 << 16 else "<u4")


def pieces_of(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = False) -> DataFrame:
    """``key, id, piece, start, length, ids_crc32, tokens``: the ids of whole texts and ``end_id``, cut where a document is longer than ``capacity``.

    Null and empty texts are the end id alone. ``tokens`` are little-endian unsigned 32-bit ids, null unless asked for.
    ``key`` tells pieces apart, as ids may be null or repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept("packing", zlib.crc32(shared.value.encode()), lambda: _memory(shared.value))
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, tokens, sizes in memory.batches(batch, 1):
                ends = np.cumsum(sizes + 1)
                ids = np.full(int(ends[-1]), end_id, "<u4")
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = tokens
                size = sizes + 1
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                first = (ends - size)[doc] + start
                data = memoryview(ids.tobytes())
                cut = [data[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                said = pa.array([bytes(c) for c in cut], pa.binary()) if keep_tokens else pa.nulls(len(cut), pa.binary())
                columns = [pa.array(key + np.arange(len(doc))), part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()), said]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "piece", "start", "length", "ids_crc32", "tokens"])
                key += len(doc)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, _PIECE)


def _packed(items: DataFrame, level: int, chunks: int, capacity: int) -> DataFrame:
    """``items`` (``key, length`` and more) with ``sequence_id``, ``offset`` and ``fill``, chunk by chunk, the longest first."""

    def run(chunk: tuple, rows: pa.Table) -> pa.Table:
        # the order follows from the rows alone, so that a task that runs again packs alike
        rows = rows.sort_by([("length", "descending"), ("key", "ascending")])
        lengths = rows["length"].to_numpy()
        sequences, offsets = place(lengths, capacity)
        fill = np.bincount(sequences, lengths, minlength=1).astype(np.int64)[sequences]
        number = sequences + (((level << 32) + chunk[0].as_py()) << 24)
        out = rows.drop_columns(["_chunk"])
        return out.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fill))

    schema = T.StructType([*items.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "fill"))])
    dealt = items.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(chunks)))
    return dealt.groupBy("_chunk").applyInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """``items`` (``key, length`` and more columns; lengths from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every item is placed once; sequences hold at most ``capacity`` and have no gap but at their ends. Each round takes apart the
    sequences that are not full; a round that saves less than one in a thousand of its sequences is the last. An empty table
    gives an empty result.
    """
    extra = ("sequence_id", "offset", "fill")
    done, rest = [], items
    rows, level, before = rest.count(), 0, None
    while True:
        chunks = max(1, -(-rows // chunk))
        now = staged(_packed(rest.drop(*extra), level, chunks, capacity), f"level{level}")
        after = now.where("offset = 0").count()
        if before is not None and after >= before:
            dropped(now)
            done.append(rest)
            break
        done.append(now.where(F.col("fill") == capacity))
        rest = now.where(F.col("fill") < capacity)
        rows, left = rest.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if chunks == 1 or not rows or (before is not None and before - after < before / 1000):
            done.append(rest)
            break
        before, level = left, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("fill")


def pack_documents(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece of all documents, and ``tokens`` where kept."""
    cut = staged(pieces_of(docs, tokenizer_json, end_id, capacity, id_col, text_col, keep_tokens), "pieces")
    out = pack(cut.drop("tokens"), capacity)
    if keep_tokens:
        out = out.join(cut.select("key", "tokens"), "key")
    return out.drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, n_tokens`` from ``pack_documents(keep_tokens=True)``: the bytes of each sequence's pieces in order."""
    one = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("p"), F.sum("length").alias("n_tokens"))
    return one.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["tokens"])).alias("ids"), "n_tokens")
