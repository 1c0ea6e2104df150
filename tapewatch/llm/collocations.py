"""Phrase collocations by mergeable Misra-Gries summaries.

First pass: hashes of all n-grams are dealt into hash partitions. Tasks count them in batches and send sorted,
packed keys; a partition merges what comes in into one Misra-Gries summary, whose capacity exceeds the
partition's mass divided by the threshold. So all that the summary ever takes off any count is less than the
threshold, and every n-gram as frequent as that survives. The mass is known before the first merge, as tasks send
it ahead. n-grams whose keys collide count together, which may keep more but loses none.

Second pass: n-grams whose key survived are counted exactly, by their words. Survivors reach the tasks as
one bitmap; what it lets through by chance is counted too and falls short of the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, staged

SLICE = 1 << 21
FLUSH = 1 << 21
#: Rows of counts that a task adds up before it sends them.
ROWS = 1 << 18
#: n-grams that a hash partition holds at most, but for the repeats of a frequent one.
MASS = 1 << 21
KEY_BITS = 28
MOST_BITS = 28
_CODEC = pa.Codec("zstd", 1)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: ``names`` are distinct, ``word`` says which one stands at each place, ``piece`` and ``text`` where it is."""

    def __init__(self, texts: pa.Array):
        texts = pc.ascii_lower(texts.fill_null("")).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        heads = inside[1:-1] & ~inside[:-2]
        tails = inside[1:-1] & ~inside[2:]
        cut = edges[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        heads[cut] |= inside[1:-1][cut]
        tails[cut - 1] |= inside[1:-1][cut - 1]
        starts, ends = np.flatnonzero(heads), np.flatnonzero(tails) + 1
        self.text = np.searchsorted(edges, starts, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + self.text if len(starts) else self.text
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype("<i8")
        flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside[1:-1]])])
        coded = flat.dictionary_encode()
        self.names, self.word = coded.dictionary, coded.indices.to_numpy()

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.names.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.names))

    def follows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which of the places begin ``size`` words of one piece?"""
        ok = at + size <= len(self.word)
        return ok & (self.piece[np.minimum(at + size - 1, len(self.word) - 1)] == self.piece[at])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, list[str]]]:
    """Texts of about ``SLICE`` bytes, the language of each by number, and the languages' names. A longer text is a slice of its own."""
    text, lang = batch.column(0), batch.column(1).fill_null("und").dictionary_encode()
    size = np.cumsum(pc.binary_length(text.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield text.slice(at, stop - at), lang.indices.slice(at, stop - at).to_numpy(), lang.dictionary.to_pylist()
        at = stop


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in names], np.uint64)


def _key(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Partition and key within it in one number."""
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(partitions) << np.uint64(32)) | (hashes >> np.uint64(64 - KEY_BITS))


def _zipped(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts over one, in planes of bytes."""
    both = np.concatenate([np.diff(keys, prepend=0), np.minimum(counts, 1 << 31) - 1]).astype("<u4")
    planes = both.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + _CODEC.compress(planes, asbytes=True)


def _unzipped(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    both = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:] + 1


class Summary:
    """A Misra-Gries summary of keys: never more than ``capacity`` counters after a merge; ``less`` is what any count may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.less = capacity, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.less += off
            keys, counts = keys[counts > off], counts[counts > off] - off
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.less >= least]


def _survivors(docs: DataFrame, most_words: int, least: int, partitions: int) -> DataFrame:
    """``mark``: a hash of the partition and key of each n-gram that may occur ``least`` times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            pa.default_memory_pool().release_unused()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            keys, counts = every[first], np.diff(first, append=len(every))
            part = (keys >> np.uint64(32)).astype(np.int64)
            own, at = np.unique(part, return_index=True)
            stops = [*at[1:].tolist(), len(keys)]
            keys = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            mass = np.add.reduceat(counts, at)
            data = [_zipped(keys[a:b], counts[a:b]) for a, b in zip(at.tolist(), stops, strict=True)]
            n = len(own)
            columns = [pa.array(np.tile(own, 2)), pa.array([0] * n + [1] * n, pa.int32()), pa.array(np.concatenate([mass, np.zeros(n, np.int64)])), pa.array([None] * n + data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["p", "after", "mass", "data"])

        for batch in batches:
            for texts, lang, names in _slices(batch):
                words = Words(texts)
                if not len(words.word):
                    continue
                own = words.hashes()[words.word]
                at, now = np.arange(len(own)), mixed(own ^ _seeds(names)[lang][words.text])
                for n in range(1, most_words + 1):
                    if n > 1:
                        ok = words.follows(at, n)
                        at = at[ok]
                        now = mixed(now[ok] * _MULTIPLY + own[at + n - 1])
                    held.append(_key(now, partitions))
                    size += len(now)
                if size >= FLUSH:
                    yield flushed()
                    size = 0
        if size:
            yield flushed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary, keys, counts, size = None, 0, None, [], [], 0

        def taken():
            nonlocal keys, counts, size
            if size:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [], [], 0

        def found() -> pa.RecordBatch:
            if summary is not None:
                taken()
            kept = summary.survivors(least) if summary is not None else np.zeros(0, np.int64)
            marks = mixed((np.uint64(now) << np.uint64(32)) | kept.astype(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64))], names=["mark"])

        for batch in batches:
            for p, after, more, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if p != now:
                    if now is not None:
                        yield found()
                    now, mass, summary = p, 0, None
                if not after:
                    mass += more
                    continue
                if summary is None:
                    summary = Summary(mass // least + 1)
                k, c = _unzipped(data.as_py())
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size >= max(summary.capacity, 1 << 19):
                    taken()
        if now is not None:
            yield found()

    sent = docs.mapInArrow(send, "p long, after int, mass long, data binary")
    return sent.repartition(partitions, "p").sortWithinPartitions("p", "after").mapInArrow(merge, "mark long")


def _bitmap(marks: DataFrame) -> tuple[np.ndarray, int]:
    """One bit for each of 2 to the ``bits`` values of the marks' upper bits; sixteen a mark, up to 2 to the ``MOST_BITS``."""
    bits = min(MOST_BITS, max(16, int(marks.count()).bit_length() + 4))
    place = F.shiftrightunsigned("mark", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(mark, {64 - bits}) & 63 as int))")
    found = marks.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(one).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["set"].to_numpy()
    return out.view(np.uint64), bits


def frequent(docs: DataFrame, most_words: int, least: int, mass: int = MASS) -> DataFrame:
    """``lang, phrase, size, f`` of all n-grams of ``docs`` (``text, lang``) that occur ``least`` times or more, exactly.

    Rows of size 0 have the number of all words of a language, however few.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # words are at most half the bytes, and a word begins one n-gram of each size
    partitions = max(1, -(-(total // 2) * most_words // mass))
    marks = staged(_survivors(docs, most_words, least, partitions), "marks")
    bitmap, bits = _bitmap(marks)
    dropped(marks)
    shared = spark.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in each(batches):
            held.append(part)
            rows += len(part)
            if rows >= ROWS:
                yield from _summed(held)
                held, rows = [], 0
        yield from _summed(held)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def hit(hashes: np.ndarray) -> np.ndarray:
            place = mixed(_key(hashes, partitions)) >> np.uint64(64 - bits)
            return (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for texts, lang, names in _slices(batch):
                words = Words(texts)
                spoken, named = lang[words.text], pa.array(names, pa.string())
                own_n = np.bincount(spoken, minlength=len(names))
                yield _counted(named, pa.array([""] * len(names)), 0, own_n)
                if not len(words.word):
                    continue
                own = words.hashes()[words.word]
                now, at = mixed(own ^ _seeds(names)[spoken]), np.arange(len(own))
                same = spoken.astype(np.int64)
                for n in range(1, most_words + 1):
                    if n > 1:
                        # a frequent phrase is frequent without its first or last word
                        before = np.zeros(len(own) + 1, bool)
                        before[at] = True
                        ok = words.follows(at, n) & before[at + 1]
                        at, now, same = at[ok], now[ok], same[ok]
                        now = mixed(now * _MULTIPLY + own[at + n - 1])
                    ok = hit(now)
                    at, now, same = at[ok], now[ok], same[ok]
                    if not len(at):
                        break
                    # numbers of equal phrases: equal before, and an equal last word
                    _, first, same, times = np.unique((same << 32) | words.word[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                    parts = [words.names.take(pa.array(words.word[at[first] + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
                    yield _counted(named.take(pa.array(spoken[at[first]])), phrase.cast(pa.string()), n, times)

    found = docs.mapInArrow(count, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def _summed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Counts of several slices, added up before they leave the task."""
    if not parts:
        return []
    found = pa.Table.from_batches(parts).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
    parts.clear()
    pa.default_memory_pool().release_unused()
    return found.select(["lang", "phrase", "size", "f"]).combine_chunks().to_batches(max_chunksize=1 << 16)


def _counted(lang: pa.Array, phrase: pa.Array, size: int, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(times), size, np.int32)), pa.array(times.astype(np.int64))], names=["lang", "phrase", "size", "f"])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 4, least: int = 30, inside: int = 80, top: int = 2000, mass: int = MASS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``most_words`` words that occur ``least`` times or more.

    A phrase scores by its weakest cut into two: a million times twice its count over the sum of its parts' counts. It goes where a
    longer one of the same language holds it and occurs at least ``inside`` hundredths as often. Null texts are empty,
    a null language is ``und``. Words are as they stand, with A-Z in lower case. An empty table gives an empty result.
    """
    given = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counts = staged(frequent(given, most_words, least, mass), "counts")
    known = counts.where("size > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias("_f"))
    words = F.split("phrase", " ")
    several = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    # numbers of a phrase's cuts: first and rest; of its inner phrases: from and length
    cuts = several.select("lang", "phrase", "a", "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    left = cuts.join(known, (cuts["lang"] == known["_lang"]) & (cuts["first"] == known["_phrase"])).select(*cuts.columns, F.col("_f").alias("l"))
    both = left.join(known, (left["lang"] == known["_lang"]) & (left["rest"] == known["_phrase"])).select(*left.columns, F.col("_f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    weakest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = several.where("size > 2").select("lang", "w", "size", F.col("a").alias("f"), F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> struct(i, n))))")).alias("x"))
    inner = inner.select(F.col("lang").alias("_lang"), F.array_join(F.slice("w", F.col("x.i"), F.col("x.n")), " ").alias("_phrase"), "f").groupBy("_lang", "_phrase").agg(F.max("f").alias("longer"))
    scored = weakest.join(inner, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    kept = scored.where(f"longer is null or cast(longer as decimal(22, 0)) * 100 < cast(a as decimal(22, 0)) * {inside}")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", "cut", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY 1
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), several AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM several
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score, c.k
  FROM (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest FROM cuts) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), sizes AS (
  SELECT lang, w, a, unnest(range(2, len(w))) AS m FROM several WHERE len(w) > 2
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM sizes)) GROUP BY 1, 2
), ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, score
  FROM weakest w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
