"""Cut texts where no token can cross, and remember the tokens of each piece.

The pre-tokeniser pattern looks at nothing before a match. No match goes on across a blank (it opens one)
unless white space stands on both sides of the blank, none holds a letter or digit and then one of
``.,;:!?``, and none goes beyond a single line end between two other signs. Cut there, the pieces encoded
one by one give the tokens of the whole text. Pieces repeat, so a batch is cut and its distinct pieces are
found with Arrow, and only those are looked up in Python.
"""

from __future__ import annotations

import ctypes
import gc
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by any library's table, and separators that only some count as such.
_SPACE = r"\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A blank between white space opens no match of its own; the mark of cuts and unclear separators.
_WHOLE = rf"[{_SPACE}] (?:[{_SPACE}]|$)|[\x00\x1c-\x1f]"
_SIGNS = r"([0-9A-Za-z])([.,;:!?])"
_LINE = rf"([^{_SPACE}])\n([^{_SPACE}])"
REMEMBERED = 450_000
LONGEST = 64
SLICE = 1 << 23
_INSIDE = re.compile(r"(?<=\S) (?=\S)")


def cut(texts: pa.Array) -> pa.Array:
    """A list of pieces for each text."""
    marked = pc.replace_substring(texts, " ", "\0 ")
    marked = pc.replace_substring_regex(marked, _SIGNS, "\\1\0\\2")
    return pc.split_pattern(pc.replace_substring_regex(marked, _LINE, "\\1\0\n\0\\2"), "\0")


def _long(text: str) -> Iterator[str]:
    """Parts of a very long text, each of about ``SLICE`` characters and cut before a blank."""
    at = 0
    while len(text) - at > 2 * SLICE and (found := _INSIDE.search(text, at + SLICE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Memory:
    """Tokens of pieces as little-endian bytes. Holds at most twice ``most`` short pieces.

    ``encode`` gets a list of pieces and returns a list of id lists. When the young half is full it
    becomes the old half; pieces used again move back. ``most`` and ``slice_bytes`` bound what a worker holds and change no token.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], kind: str, most: int = REMEMBERED, slice_bytes: int | None = None):
        self.encode, self.kind, self.most = encode, np.dtype(kind), most
        self.slice_bytes = min(slice_bytes or SLICE, SLICE)
        self.code = {2: "H", 4: "i"}[self.kind.itemsize]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, parts: list[str]) -> list[bytes]:
        """Tokens of each piece."""
        found = [*map(self.young.get, parts)]
        gaps = [i for i, f in enumerate(found) if f is None]
        if not gaps:
            return found
        old, young, new = self.old, self.young, []
        for i in gaps:
            part = parts[i]
            if (tokens := old.get(part)) is None:
                new.append(i)
            else:
                found[i] = tokens
                if len(young) < self.most:
                    young[part] = tokens
        if new:
            code = self.code
            for i, ids in zip(new, self.encode([parts[i] for i in new]), strict=True):
                found[i] = array(code, ids).tobytes()
                if len(parts[i]) <= LONGEST and len(young) < self.most:
                    young[parts[i]] = found[i]
        if len(young) >= self.most:
            self.old, self.young = young, {}
        return found

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, one text after another, and how many each has. Nulls have none."""
        texts = texts.fill_null("").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _WHOLE)
        pieces = cut(pc.if_else(whole, "", texts))
        edge = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.slice(edge[0], edge[-1] - edge[0]).dictionary_encode()
        head = (edge - edge[0])[:-1]
        names, place = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        if uncut := np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            place = place.copy()
            place[head[uncut]] = len(names) + np.arange(len(uncut))
            names += [texts[i].as_py() for i in uncut]
        known = self.known(names)
        size = np.fromiter(map(len, known), np.int32, len(known)) // self.kind.itemsize
        each = size[place]
        if not len(each):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        # the token at each place is taken from one small table of the slice's distinct pieces
        last = np.cumsum(each, dtype=np.int32)
        shift = (np.cumsum(size, dtype=np.int32) - size)[place] - last + each
        tokens = np.frombuffer(b"".join(known), self.kind)[np.repeat(shift, each) + np.arange(last[-1], dtype=np.int32)]
        return tokens, np.add.reduceat(each, head, dtype=np.int64)

    def ids(self, text: str) -> np.ndarray:
        return self.lists(pa.array([text]))[0]

    def batches(self, batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a batch, of about ``slice_bytes`` of text, with the tokens and their number in each row."""
        column = batch.column(text)
        size = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.slice_bytes, "right")))
            part = batch.slice(at, stop - at)
            if stop == at + 1 and size[at] - (size[at - 1] if at else 0) > 2 * SLICE:
                found = [self.lists(pa.array([x]))[0] for x in _long(column[at].as_py())]
                tokens = np.concatenate(found)
                yield part, tokens, np.array([len(tokens)])
            else:
                yield (part, *self.lists(part.column(text)))
            at = stop


_OWN: dict[str, tuple[object, object]] = {}


def let_go() -> None:
    """Give back what this worker process keeps: Spark uses a process again for other steps, which would hold it beside their own."""
    _OWN.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what was freed
        trim(0)


def kept(use: str, mark: object, make: Callable):
    """What a worker process keeps from task to task: one thing, until a task brings another use or mark."""
    if _OWN.get(use, (None,))[0] != mark:
        let_go()
        _OWN[use] = (mark, make())
    return _OWN[use][1]
