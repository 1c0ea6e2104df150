"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Tokens are strings of bytes, written as Latin-1 so that an Aho-Corasick automaton takes them. One
pass of the automaton gives the longest token that starts at each byte. Tokens are then laid from
the left, longest first; a token is allowed beside its left neighbour only if merging would not have
joined bytes across their border (remembered for each pair). Where none fits, the last token is taken
back and shortened, and the place is marked, so no place is tried twice. Time is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import Memory, kept

#: What a worker remembers of pairs and pieces, and the text it cuts at once; each worker of an executor holds its own.
PAIRS_REMEMBERED = 200_000
PIECES_REMEMBERED = 100_000
SLICE = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file's ranks: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts that merges of a rank under ``below`` leave of a token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
        if ranks.get(parts[at] + parts[at + 1], below) >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def library_classes(pattern: str) -> tuple[str, str]:
    """The pattern with classes as tiktoken's tables of Unicode have them, for :mod:`regex` whose tables may be newer,
    and the code points that the tables differ in, in order."""
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    differ: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        if kind not in pattern:
            continue
        library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs, ours = set(bytes(library.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
        less, more = ("".join(f"\\U{ord(c):08x}" for c in sorted(x)) for x in (ours - theirs, theirs - ours))
        named = f"[{kind}{more}]" if more else kind
        pattern = pattern.replace(kind, f"[{named}--[{less}]]" if less else named)
        differ |= ours ^ theirs
    return f"(?V1){pattern}", "".join(sorted(differ))


class Encoder:
    """Built once on the driver and sent to tasks; the automaton is built again in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.exact, self.differ = library_classes(pattern)
        self.mark = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.halves: dict[int, tuple[int, int]] = {}
        usable = {t: r for t, r in ranks.items() if len(t) == 1}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(parts := _merged(token, ranks, rank)) == 2:
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                usable[token] = rank
        # a token that merges never make is still the result where a piece equals it (see piece())
        self.usable = usable
        self.whole = {pair: rank for rank, pair in self.halves.items()}
        self.shorter = {r: next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), -1) for t, r in usable.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "compatible", "splitter", "exact_splitter", "unsure", "text_of")}

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        return found

    @cached_property
    def compatible(self) -> dict[int, bool]:
        return {}

    @cached_property
    def splitter(self):
        return regex.compile(self.pattern)

    @cached_property
    def exact_splitter(self):
        """Slower than the plain one, for texts with a code point that the tables differ in."""
        return regex.compile(self.exact)

    @cached_property
    def unsure(self) -> frozenset[str]:
        return frozenset(self.differ)

    @cached_property
    def text_of(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    def beside(self, left: int, right: int) -> bool:
        """Would merging keep these two tokens apart? Undo their merges, the latest first, and see whether
        what touches at the border would have been joined earlier."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIRS_REMEMBERED:
                self.compatible.clear()
            known = self.compatible[key] = self._beside(left, right)
        return known

    def _beside(self, left: int, right: int) -> bool:
        before = float("inf")  # merges of a lower rank came before what is in place now
        while True:
            joined = self.whole.get((left, right))
            if joined is not None and joined < before:
                return False
            one, two = self.halves.get(left), self.halves.get(right)
            if one is None and two is None:
                return True
            if two is None or (one is not None and left > right):
                before, left = left, one[1]
            else:
                before, right = right + 1, two[0]

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        size, longest = len(data), [-1] * len(data)
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank  # ends ascend, so the last one is the longest
        text_of, shorter, beside = self.text_of, self.shorter, self.beside
        open_ = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + len(text_of[token])
                if open_[end] and (not out or beside(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest[at]
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(text_of[token])

    def encode(self, text: str) -> list[int]:
        if text.isascii() and text.removeprefix(" ").isalpha():
            return self.piece(text.encode())  # a word is one match
        clear = text.isascii() or not self.differ or max(text) < self.differ[0] or self.unsure.isdisjoint(text)
        splitter = self.splitter if clear else self.exact_splitter
        return [i for match in splitter.findall(text) for i in self.piece(match.encode("utf-8", "surrogatepass"))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))


def encode(docs: DataFrame, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``tokens`` (array of int) of each row's whole text; null and empty texts have none.

    Rows, ids (nulls and repeats too) and their number stay. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        memory = _memory(shared.value)
        for batch in batches:
            for part, tokens, sizes in memory.batches(batch, 1):
                yield from _rows([part.column(0), _lists(tokens, sizes)], ["id", "tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, encoder: Encoder) -> DataFrame:
    """``id`` and ``bytes`` of the column ``tokens``; a null list gives null."""
    shared = tokens.sparkSession.sparkContext.broadcast(encoder)
    schema = T.StructType([tokens.schema["id"], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        for batch in batches:
            out = [shared.value.decode(x) if (x := v.as_py()) is not None else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    return tokens.select("id", "tokens").mapInArrow(run, schema)


def round_trip(docs: DataFrame, encoder: Encoder, keep_tokens: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, decode the ids again and describe both: ``id, n_tokens, ids_sha256, decoded_sha256``.

    ``keep_tokens`` adds the column ``tokens``. Null and empty texts have no tokens. See :func:`encode`.
    Both ways run in one pass, so that a task needs one worker process.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("tokens", T.ArrayType(T.IntegerType(), True))] * keep_tokens)

    def run(batches):
        own = shared.value
        memory = _memory(own)
        digits, text_of = [*map(str, range(max(own.text_of) + 1))], own.text_of
        for batch in batches:
            for part, tokens, sizes in memory.batches(batch, 1):
                said, decoded, at = [], [], 0
                for n in sizes.tolist():
                    each = tokens[at : at + n].tolist()
                    at += n
                    said.append(hashlib.sha256(",".join(map(digits.__getitem__, each)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(text_of.__getitem__, each))).hexdigest())
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
                yield from _rows([*columns, *[_lists(tokens, sizes)] * keep_tokens], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _memory(own: Encoder) -> Memory:
    return kept("bpe", own.mark, lambda: Memory(lambda pieces: [own.encode(p) for p in pieces], "<i4", PIECES_REMEMBERED, SLICE))


def _lists(tokens: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(tokens))


def _rows(columns: list[pa.Array], names: list[str], most: int = 256):
    """Batches of a few rows, so that arrays on their way to Spark stay small."""
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, len(whole), most):
        yield whole.slice(at, most)
