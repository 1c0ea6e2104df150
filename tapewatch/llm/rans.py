"""Token ids on disk: static range asymmetric numeral system in independent interleaved blocks.

A written folder holds two tables.

``table``: ``token, freq`` - one shared frequency table; frequencies add up to 2^20.
``frames``: ``shard, row, payload`` - frames of whole documents in ascending id order (by shard, row).

A payload is a header, the frame's documents (ids and token counts), and blocks of up to 8,192
tokens. A block is decoded alone: its checkpoint has the states of its 32 lanes, the place of its
32-bit words and the crc32 of its ids. Lanes take turns, so that numpy decodes all lanes of all blocks
of a frame at once; any block range can also be given to another task.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, shared_dir, staged
from .pieces import Memory, kept

MAGIC = b"TWR1"
SCALE = 20
LANES = 32
BLOCK = 8192
FRAME = 1 << 19
RANGE = 1 << 24
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIQ")  # magic, documents, blocks, tokens in a block, tokens


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scale counts to a sum of 2^scale; every symbol, seen or not, keeps one at least."""
    total = 1 << scale
    if len(counts) > total // 2:
        raise ValueError("alphabet too large for the scale")
    spare = total - len(counts)
    share = np.floor(counts / max(1, counts.sum()) * spare).astype(np.int64) + 1
    share[int(np.argmax(counts))] += total - share.sum()
    return share


class Coder:
    """The tables of one frequency table, for encoding and decoding."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)
        self.pad = int(np.argmax(freq))

    def encode(self, ids: np.ndarray) -> tuple[int, list[tuple[bytes, bytes, int]]]:
        """Tokens in a block, and (states, words, crc) of each block."""
        block = min(BLOCK, -(-max(1, len(ids)) // LANES) * LANES)
        blocks = -(-len(ids) // block)
        if not blocks:
            return block, []
        padded = np.full(blocks * block, self.pad, np.uint32)
        padded[: len(ids)] = ids
        grid = padded.reshape(blocks, block // LANES, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        shift, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
        limit = self.freq << np.uint64(63 - SCALE)
        said, flags = [], []
        for row in range(grid.shape[1] - 1, -1, -1):
            s = grid[:, row]
            f = self.freq[s]
            out = state >= limit[s]
            said.append((state & low32).astype("<u4"))
            flags.append(out)
            state = np.where(out, state >> shift, state)
            part = state // f
            state = (part << np.uint64(SCALE)) + (state - part * f) + self.start[s]
        said, flags = np.stack(said[::-1], 1), np.stack(flags[::-1], 1)
        return block, [(state[b].astype("<u8").tobytes(), said[b][flags[b]].tobytes(), zlib.crc32(padded[b * block : (b + 1) * block].astype("<u4").tobytes())) for b in range(blocks)]

    def decode(self, states: np.ndarray, words: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
        """Ids of blocks from their checkpoints: ``states`` (blocks, lanes) and the first word of each block."""
        state, at = states.astype(np.uint64), first.astype(np.int64)[:, None]
        words = np.append(words, np.zeros(LANES + 1, np.uint32)).astype(np.uint64)
        out = np.empty((len(states), rows, LANES), np.uint32)
        mask, shift, top = np.uint64((1 << SCALE) - 1), np.uint64(32), len(words) - 1
        for row in range(rows):
            slot = state & mask
            s = self.symbol[slot]
            out[:, row] = s
            state = self.freq[s] * (state >> np.uint64(SCALE)) + slot - self.start[s]
            need = state < LOW
            ahead = np.cumsum(need, 1)
            got = words[np.minimum(at + ahead - 1, top)]
            state = np.where(need, (state << shift) | got, state)
            at = at + ahead[:, -1:]
        if (state != LOW).any():  # every lane ends where its encoder began
            raise ValueError("a block fails its checksum: lanes end elsewhere")
        return out.reshape(len(states), -1)

    def frame(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
        block, parts = self.encode(ids)
        head = _HEAD.pack(MAGIC, len(docs), len(parts), block, len(ids))
        body = [head, docs.astype("<i8").tobytes(), sizes.astype("<u8").tobytes()]
        body.append(np.cumsum([0, *(len(w) // 4 for _, w, _ in parts)]).astype("<u8").tobytes())
        body.append(np.array([c for *_, c in parts], "<u4").tobytes())
        return b"".join(body + [s for s, *_ in parts] + [w for _, w, _ in parts])

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, token counts and all ids of a frame; raises if a block fails its checksum."""
        magic, docs, blocks, block, tokens = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token frame")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        names, sizes, first, sums = take("<i8", docs), take("<u8", docs), take("<u8", blocks + 1), take("<u4", blocks)
        states = take("<u8", blocks * LANES).reshape(blocks, LANES)
        words = take("<u4", int(first[-1]))
        if not blocks:
            return names, sizes, np.zeros(0, np.uint32)
        ids = self.decode(states, words, first[:-1], block // LANES)
        for b in range(blocks):
            if zlib.crc32(ids[b].astype("<u4").tobytes()) != sums[b]:
                raise ValueError(f"block {b} fails its checksum")
        return names, sizes, ids.reshape(-1)[:tokens]


def _memory(tokenizer_json: str, specials_as_text: bool = False) -> Memory:
    """The library's ids of pieces. A piece of letters is one match of its pattern, so its model alone does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(tokenizer_json)
    own.encode_special_tokens = specials_as_text
    # byte-level letters: printable bytes stand for themselves, the others for code points from 256 on
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(256 + k) for k, b in enumerate(others)}
    blank = letters[0x20]
    whole, model = own.encode_batch_fast, own.model.tokenize

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for k, p in enumerate(pieces):
            word = p.removeprefix(" ")
            if not word.isalpha():
                rest.append(k)
            elif p.isascii():
                out[k] = [t.id for t in model(p if word is p else blank + word)]
            else:
                out[k] = [t.id for t in model(p.encode().decode("latin-1").translate(letters))]
        for k, found in zip(rest, whole([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    return Memory(encode, "<u2" if own.get_vocab_size() <= 1 << 16 else "<u4")


def _tokenised(docs: DataFrame, tokenizer_json: str, end_id: int, vocabulary: int, id_col: str, text_col: str, partitions: int, specials_as_text: bool) -> DataFrame:
    """``shard, row, id, ids, counts`` in ascending id order: texts are dealt out by ranges of ids, then encoded.

    The last row of a shard has nothing but ``counts``: the tokens of the shard and how often each occurs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = _kind(vocabulary)

    def run(batches):
        memory = kept("tokens", zlib.crc32(shared.value.encode()) + specials_as_text, lambda: _memory(shared.value, specials_as_text))
        shard, row, counts = TaskContext.get().partitionId(), 0, np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part, tokens, sizes in memory.batches(batch, 1):
                n, ends = len(sizes), np.cumsum(sizes + 1)
                ids = np.empty(len(tokens) + n, kind)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner], ids[ends - 1] = tokens, end_id
                counts += np.bincount(ids, minlength=vocabulary)
                columns = [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), part.column(0), _binaries(ids, ends), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=_SHARD)
                row += n
        seen = np.flatnonzero(counts)
        said = np.stack([seen, counts[seen]]).astype("<i8").tobytes()
        columns = [pa.array([shard], pa.int32()), pa.array([row]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([said])]
        yield pa.RecordBatch.from_arrays(columns, names=_SHARD)

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    dealt = plain.repartitionByRange(partitions, "id", "mark").sortWithinPartitions("id", "mark")
    return dealt.select("id", "text").mapInArrow(run, "shard int, row long, id long, ids binary, counts binary")


_SHARD = ["shard", "row", "id", "ids", "counts"]


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose item k ends before ``values[ends[k]]``; nothing is copied item by item."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(values)]).cast(pa.binary())


def _counted(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all rows; one array of the vocabulary's size reaches the driver."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                counts[seen] += n
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["token", "n"])

    found = ids.select("counts").where("counts is not null").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _frames(batches, coder: Coder, kind: str):
    """Frames of about ``FRAME`` tokens. A frame holds rows of one shard that follow one another."""
    held: list[tuple[np.ndarray, np.ndarray, bytes]] = []
    size, shard, row, after = 0, 0, 0, None

    def close():
        nonlocal held, size
        docs, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        ids = np.frombuffer(b"".join(h[2] for h in held), kind)
        out = [pa.array([shard], pa.int32()), pa.array([row]), pa.array([len(ids)]), pa.array([coder.frame(docs, sizes, ids)], pa.binary())]
        held, size = [], 0
        return pa.RecordBatch.from_arrays(out, names=["shard", "row", "tokens", "payload"])

    for batch in batches:
        shards, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        docs = batch.column(2).fill_null(-(1 << 63)).to_numpy()
        binary = batch.column(3).cast(pa.large_binary())
        offsets = np.frombuffer(binary.buffers()[1], "<i8")[binary.offset : binary.offset + len(binary) + 1]
        data, width = memoryview(binary.buffers()[2] or b""), np.dtype(kind).itemsize
        total = (offsets - offsets[0]) // width
        apart = np.flatnonzero((shards[1:] != shards[:-1]) | (rows[1:] != rows[:-1] + 1)) + 1
        at = 0
        while at < len(docs):
            if held and after != (shards[at], rows[at]):
                yield close()
            stop = int(np.searchsorted(total, total[at] + FRAME - size, "right")) - 1
            if stop <= at:
                if held:
                    yield close()
                    continue
                stop = at + 1
            stop = min(stop, *apart[apart > at][:1].tolist(), len(docs))
            if not held:
                shard, row = int(shards[at]), int(rows[at])
            held.append((docs[at:stop], np.diff(total[at : stop + 1]), bytes(data[offsets[at] : offsets[stop]])))
            size += int(total[stop] - total[at])
            after, at = (shards[stop - 1], rows[stop - 1] + 1), stop
    if held:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", specials_as_text: bool = False, range_bytes: int = RANGE) -> None:
    """Encode whole texts, end each document with ``end_id`` and write them in ascending id order.

    Null and empty texts are the end id alone; repeated ids stay rows of their own, in order of a hash of
    their texts; null ids come first and are written as the least long. An empty table writes an empty
    folder. A document is never split over frames, so a frame is as long as its longest document at least.
    Special tokens' strings in a text become their ids, as the library does by itself, unless ``specials_as_text``.
    Each range of ids holds about ``range_bytes`` of text.
    """
    spark = docs.sparkSession
    kind = _kind(vocabulary)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-size // range_bytes))
    ids = staged(_tokenised(docs, tokenizer_json, end_id, vocabulary, id_col, text_col, partitions, specials_as_text), "ids", compression="zstd")
    freq = frequencies(_counted(ids, vocabulary))
    spark.createDataFrame(pa.table({"token": np.arange(vocabulary), "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    frames = ids.where("counts is null").select("shard", "row", "id", "ids").mapInArrow(lambda batches: _frames(batches, Coder(shared.value), kind), "shard int, row long, tokens long, payload binary")
    frames.write.option("compression", "none").parquet(f"{path}/frames")
    dropped(ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, tokens`` of each document; tokens are little-endian unsigned 32-bit integers.

    start counts the tokens of all documents before it. Only the sizes of frames are ordered to find
    it: frames within their shard, and one total of each shard.
    """
    table = spark.read.parquet(f"{path}/table").toPandas().sort_values("token")
    shared = spark.sparkContext.broadcast(table["freq"].to_numpy(np.int64))
    frames = spark.read.schema("shard int, row long, tokens long, payload binary").parquet(f"{path}/frames")
    shards = frames.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = frames.select("shard", "row", inside.alias("inside")).join(shards.select("shard", before.alias("before")), "shard")
    starts = staged(starts.select("shard", "row", (F.col("before") + F.col("inside")).alias("start")), "starts")
    placed = frames.join(starts, ["shard", "row"])

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, sizes, ids = coder.read(payload.as_py())
                ends = np.cumsum(sizes.astype(np.int64))
                for at in range(0, len(docs), 1024):
                    part = slice(at, at + 1024)
                    n, last = sizes[part].astype(np.int64), ends[part]
                    own = _binaries(ids[last[0] - n[0] : last[-1]].astype("<u4"), last - (last[0] - n[0]))
                    names = pa.array(docs[part], mask=docs[part] == -(1 << 63))
                    yield pa.RecordBatch.from_arrays([names, pa.array(start + last - n), pa.array(n), own], names=["id", "start", "n_tokens", "tokens"])

    return placed.select("start", "payload").mapInArrow(run, "id long, start long, n_tokens long, tokens binary")


def new_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tapewatch-{uuid.uuid4().hex}/tokens"
