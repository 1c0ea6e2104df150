"""Language identification with every counted word, in tables of any size.

The same scores as :mod:`language_id` gives, without a model that must fit into a task: words and n-grams stay in tables with
their counts. Frequent words are sent to all tasks as a cache, whose size has a bound; it changes no score. The
rest of a text's words is joined to the table of words, and words that no language has to the table of n-grams, longest first.

A count's log frequency is kept as what it is over that of an unseen word in its language, so only the languages that have a
word or n-gram take room.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dropped, staged
from .language_id import FLOOR, LENGTHS, NONE, _word_counts, letters
from .pieces import kept

#: Log frequencies that the cache of frequent words holds at most: words times languages; and words at most, each of which is an object in a task.
CACHE = 4_000_000
WORDS = 300_000
_AT_ONCE = 1 << 16


@dataclass
class Counts:
    """``words`` (``word, has``) and ``grams`` (``length, gram, has``); has: (language's number, log frequency over an unseen one's).

    ``floors[k]`` has the log frequency of what a language never showed: of words (0) and of n-grams of each length.
    """

    languages: list[str]
    words: DataFrame
    grams: DataFrame
    floors: dict[int, list[float]]
    total: int


def _cut(length: int):
    """All n-grams of a length of ``word`` between blanks; a shorter word is one itself."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length("word") + 3 - length, F.lit(1)))
    return F.transform(starts, lambda i: padded.substr(i, F.lit(length)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Counts:
    """Counts of all rows with a text and a language: all their words, and the n-grams of their words between blanks."""
    counts = staged(_word_counts(docs, text_col, lang_col), "words")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sums)
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1 if languages else F.lit(0)

    def told(length: int):
        return F.transform(_cut(length), lambda g: F.struct(F.lit(length).alias("length"), g.alias("gram")))

    grams = counts.select("lang", "n", F.explode(F.concat(*map(told, LENGTHS))).alias("g")).groupBy("lang", "g.length", "g.gram").agg(F.sum("n").alias("n"))
    grams = staged(grams, "grams")
    gram_sums = {(r["lang"], r["length"]): r["n"] for r in grams.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    total = {0: [sums[x] for x in languages]} | {k: [gram_sums.get((x, k), 0) for x in languages] for k in LENGTHS}
    floors = {k: [math.log(FLOOR / (n + FLOOR)) for n in v] for k, v in total.items()}
    # log(n / (total + FLOOR)) over log(FLOOR / (total + FLOOR)) is log(n / FLOOR), whatever the language
    has = F.collect_list(F.struct(number.cast("int").alias("lang"), F.log(F.col("n") / FLOOR).alias("over"))).alias("has")
    words = staged(counts.groupBy("word").agg(has, F.sum("n").alias("n")), "by_word")
    found = Counts(languages, words, staged(grams.groupBy("length", "gram").agg(has), "by_gram"), floors, sum(sums.values()))
    dropped(counts)
    dropped(grams)
    return found


def _cached(counts: Counts) -> tuple[list[str], np.ndarray]:
    """The most frequent words, as many as ``CACHE`` and ``WORDS`` let in, and their logs in each language.

    Words are let in by steps of their count, sixteen to a doubling, so that one small table of steps tells where to stop.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    room, least = min(WORDS, CACHE / max(1, len(counts.languages))), None
    for s, n in sorted(map(tuple, counts.words.groupBy(step.alias("step")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = s
    rows = counts.words.where(F.lit(False) if least is None else step >= least).select("word", "has").toArrow()
    names = rows["word"].to_pylist()
    logs = np.tile(np.array(counts.floors[0]), (len(names), 1))
    each = rows["has"].combine_chunks()
    if len(names):
        place = np.repeat(np.arange(len(names)), np.diff(each.offsets.to_numpy()))
        flat = each.flatten()
        logs[place, flat.field("lang").to_numpy()] += flat.field("over").to_numpy()
    return names, logs


def _split(docs: DataFrame, counts: Counts, text_col: str, id_col: str) -> DataFrame:
    """A row for each document (``key, id, n_words, sums``: of its cached words) and one for each other word of it (``key, word, n``)."""
    names, logs = _cached(counts)
    shared = docs.sparkSession.sparkContext.broadcast((names, logs.astype(np.float32)))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = kept("languages", id(shared), lambda: (dict(zip(shared.value[0], range(len(shared.value[0])), strict=True)), shared.value[1]))
        key, get, many = TaskContext.get().partitionId() << 33, place.get, rows.shape[1]
        for batch in batches:
            sums, sizes, keys, rest, times = [], [], [], [], []
            for text in batch.column(1):
                words = letters(text.as_py() or "")
                total, other = np.zeros(many), Counter()
                for at in range(0, len(words), _AT_ONCE):
                    some = words[at : at + _AT_ONCE]
                    found = np.fromiter(map(get, some, repeat(-1)), np.int64, len(some))
                    total += rows[found[found >= 0]].sum(0, dtype=float)
                    other.update(some[i] for i in np.flatnonzero(found < 0).tolist())
                sums.append(total)
                sizes.append(len(words))
                keys += [key + len(sums) - 1] * len(other)
                rest += other.keys()
                times += other.values()
            n, m = len(batch), len(rest)
            flat = pa.array(np.concatenate(sums) if many and n else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * many), flat)
            none = lambda kind, k: pa.nulls(k, kind)
            names = schema.names
            yield pa.RecordBatch.from_arrays([pa.array(key + np.arange(n)), batch.column(0), pa.array(np.array(sizes, np.int64)), lists, none(pa.string(), n), none(pa.int64(), n)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)), none(batch.column(0).type, m), none(pa.int64(), m), none(lists.type, m), pa.array(rest, pa.string()), pa.array(np.array(times, np.int64))], names=names)
            key += n

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _backed_off(words: DataFrame, counts: Counts) -> DataFrame:
    """``word, kind, has``: of the longest n-grams of which any is known, the mean of what they have. Words without any are left out."""
    out, rest = None, words
    for length in LENGTHS:
        cut = rest.select("word", F.explode(_cut(length)).alias("gram")).groupBy("word", "gram").agg(F.count("*").alias("times"))
        met = cut.join(counts.grams.where(F.col("length") == length).select("gram", "has"), "gram")
        known = met.groupBy("word").agg(F.sum("times").alias("known"), F.collect_list(F.struct("times", "has")).alias("all"))
        # as long as the word and the languages that its n-grams have
        each = F.flatten(F.transform("all", lambda a: F.transform(a["has"], lambda h: F.struct(h["lang"].alias("lang"), (a["times"] * h["over"]).alias("over")))))
        own = staged(known.select("word", F.lit(length).alias("kind"), F.transform(each, lambda h: F.struct(h["lang"].alias("lang"), (h["over"] / F.col("known")).alias("over"))).alias("has")), f"grams{length}")
        out = own if out is None else out.unionByName(own)
        rest = rest.join(own.select("word"), "word", "left_anti")
    return out


def identify(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of each row's whole text.

    A text's score for a language is the sum over its words of their log frequencies there; a word that no language has
    takes the mean of its longest known n-grams. The language of the highest score is told (ties to the first by name), with its
    share among all languages' likelihoods. A null text, one without a letter, or counts without a language: ``und``
    with score 0. Rows stay, with null and repeated ids; no other column is read.
    """
    parts = staged(_split(docs, counts, text_col, id_col), "parts")
    texts, rest = parts.where("word is null").select("key", "id", "n_words", "sums"), parts.where("word is not null").select("key", "word", "n")
    asked = staged(rest.select("word").distinct(), "asked")
    seen = asked.join(counts.words.select("word", "has"), "word").select("word", F.lit(0).alias("kind"), "has")
    unseen = asked.join(counts.words.select("word"), "word", "left_anti")
    logs = seen.unionByName(_backed_off(unseen, counts))
    met = rest.join(logs, "word")
    # a word's floor counts once for its kind, what it has over it for each language that has it
    each = F.explode(F.concat(F.array(F.struct((-1 - F.col("kind")).alias("slot"), F.lit(1.0).alias("value"))), F.transform("has", lambda h: F.struct(h["lang"].alias("slot"), h["over"].alias("value")))))
    sums = met.select("key", "n", each.alias("x")).groupBy("key", F.col("x.slot").alias("slot")).agg(F.sum(F.col("x.value") * F.col("n")).alias("value"))
    lists = sums.groupBy("key").agg(F.collect_list(F.struct("slot", "value")).alias("more"))
    languages, floors = counts.languages, {k: np.array(v) for k, v in counts.floors.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, scores = [], []
            for n, base, more in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if not n or not languages:
                    told.append(NONE)
                    scores.append(0.0)
                    continue
                total = np.array(base)
                for x in more or ():
                    if x["slot"] < 0:
                        total += x["value"] * floors[-1 - x["slot"]]
                    else:
                        total[x["slot"]] += x["value"]
                share = np.exp(total - total.max())
                best = int(np.argmax(total))
                told.append(languages[best])
                scores.append(float(share[best] / share.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return texts.join(lists, "key", "left").select("id", "n_words", "sums", "more").mapInArrow(run, schema)
