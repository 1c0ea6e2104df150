"""Language identification: known words first, shorter and shorter character n-grams for the rest.

The model holds log frequencies of words for each language, and of character n-grams of each length
in unseen-word contexts. A text's score for a language is the sum over its words: a known word adds
its log frequency in that language; an unseen one backs off to its n-grams of the longest length of
which any is known, averaged, down to single characters.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import packed, staged
from .pieces import kept

NONE = "und"
LENGTHS = (4, 3, 2, 1)
FLOOR = 0.5  # a count of this much stands for words and n-grams that a language never showed
KNOWN_SHARE = 1e-6  # of a language's words: more seldom ones are unseen there
GRAM_SHARE = 1e-5  # of a language's n-grams of one length
#: Letters under U+0250, in lower case; beyond them Unicode's letters, with the marks on them.
_LATIN = re.compile("[a-zªµºß-öø-ɏ]+")
_BEYOND = re.compile("[\u0250-\u1fff\u2070-\U0010ffff]")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
REMEMBERED = 120_000  # unseen words that a worker holds


@dataclass
class Table:
    """Texts and, for each, one log frequency for each language; few large objects, so that copies stay small."""

    texts: str = ""
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))

    def names(self) -> list[str]:
        return self.texts.split("\n") if len(self.logs) else []


@dataclass
class Model:
    """``words`` and ``grams[length]`` for ``languages``."""

    languages: list[str]
    words: Table = field(default_factory=Table)
    grams: dict[int, Table] = field(default_factory=dict)
    totals: list[int] = field(default_factory=list)
    mark: str = ""


def letters(text: str) -> list[str]:
    """Lower-case runs of letters and the marks after them."""
    text = text.lower()
    return (_WORD if _BEYOND.search(text) else _LATIN).findall(text)


def _word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, word, n`` over whole texts. Words are counted in each batch before they are shuffled."""

    def run(batches):
        from collections import Counter

        counts: dict[str, Counter] = {}

        def out():
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(letters(text.as_py()))
                if sum(map(len, counts.values())) > 400_000:
                    yield out()
        if counts:
            yield out()

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    return known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", known_share: float = KNOWN_SHARE, gram_share: float = GRAM_SHARE) -> Model:
    """Counts come from all rows with a text and a language.

    A word is known if it makes up ``known_share`` of some language's words, an n-gram if it makes up
    ``gram_share`` of some language's n-grams of its length: at any size of the input at most one over that
    share for each language, so the model's size has a bound. A known text has its count in every language.
    """
    counts = staged(_word_counts(docs, text_col, lang_col), "words")

    def known(rows: DataFrame, by: list[str], key: str, sums: DataFrame, share: float):
        """All rows of each text that makes up ``share`` of some group."""
        same = [key, *(c for c in by if c != "lang")]
        texts = rows.join(sums, by).where(F.col("n") >= share * F.col("total")).select(*same).distinct()
        return rows.join(F.broadcast(staged(texts, "texts")), same).toPandas()

    sums = staged(counts.groupBy("lang").agg(F.sum("n").alias("total")), "sums")
    total = {r["lang"]: r["total"] for r in sums.collect()}
    languages = sorted(total)
    model = Model(languages, totals=[total[lang] for lang in languages])
    if not languages:
        return model
    at = {lang: k for k, lang in enumerate(languages)}

    def table(rows, key: str, totals: dict[str, int]) -> Table:
        floors = np.array([math.log(FLOOR / (totals.get(lang, 0) + FLOOR)) for lang in languages])
        logs = np.log(rows["n"].to_numpy(float)) - np.log(rows["lang"].map(totals).to_numpy(float) + FLOOR)
        texts, place = np.unique(rows[key].to_numpy(str), return_inverse=True)
        every = np.tile(floors, (len(texts), 1))
        every[place, rows["lang"].map(at).to_numpy()] = logs
        return Table("\n".join(texts.tolist()), every.astype(np.float32))

    model.words = table(known(counts, ["lang"], "word", sums, known_share), "word", total)
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def cut(length: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length("word") + 3 - length, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), padded.substr(i, F.lit(length)).alias("gram")))

    every = counts.select("lang", "n", F.explode(F.concat(*map(cut, LENGTHS))).alias("g")).groupBy("lang", "g.length", "g.gram").agg(F.sum("n").alias("n"))
    grams = staged(every, "grams")
    sums = staged(grams.groupBy("lang", "length").agg(F.sum("n").alias("total")), "gram_sums")
    every = {(r["lang"], r["length"]): r["total"] for r in sums.collect()}
    found = known(grams, ["lang", "length"], "gram", sums, gram_share)
    for length in LENGTHS:
        totals = {lang: n for (lang, k), n in every.items() if k == length}
        model.grams[length] = table(found[found["length"] == length], "gram", totals)
    model.mark = uuid.uuid4().hex
    return model


class Scorer:
    """Rows of ``self.rows`` are log frequencies; ``self.place`` finds a word's row. Rows after the
    model's own hold up to ``REMEMBERED`` unseen words and are filled again from their start when full."""

    def __init__(self, model: Model):
        words = model.words.names()
        self.languages, self.known, self.totals = model.languages, len(words), model.totals
        self.rows = np.zeros((self.known + REMEMBERED, max(1, len(model.languages))), np.float32)
        self.rows[: self.known] = model.words.logs
        self.place = dict(zip(words, range(self.known), strict=True))
        self.grams = {k: (dict(zip(t.names(), range(len(t.logs)), strict=True)), t.logs) for k, t in model.grams.items()}
        self.unseen: list[str] = []

    def total(self, words: list[str]) -> np.ndarray:
        """Sum over at most ``REMEMBERED`` words."""
        return self.rows[self.places(words)].sum(0, dtype=float)

    def places(self, words: list[str]) -> list[int]:
        """Rows of at most ``REMEMBERED`` words."""
        found = [*map(self.place.get, words)]
        if None in found:
            new = {w for w, f in zip(words, found, strict=True) if f is None}
            if len(self.unseen) + len(new) > REMEMBERED:
                for w in self.unseen:
                    del self.place[w]
                self.unseen = []
                return self.places(words)
            for w in new:
                at = self.known + len(self.unseen)
                self.rows[at] = self._backed_off(w)
                self.place[w] = at
                self.unseen.append(w)
            found = [*map(self.place.get, words)]
        return found

    def _backed_off(self, word: str) -> np.ndarray:
        padded = f" {word} "
        for length in LENGTHS:
            place, logs = self.grams.get(length, ({}, None))
            known = [g for i in range(max(1, len(padded) - length + 1)) if (g := place.get(padded[i : i + length])) is not None]
            if known:
                return logs[known].mean(0)
        return np.zeros(len(self.languages))

    def text(self, text: str | None) -> tuple[str, float]:
        """Language and its share among all languages' likelihoods; ties go to the first by name."""
        words = letters(text or "")
        if not words or not self.languages:
            return NONE, 0.0
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), 4096):
            total += self.total(words[at : at + 4096])
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())


    def told(self, text: str | None, label: str | None = None) -> tuple[str, float, float]:
        """Language, its share, and how many of the words the language has counted in other texts, as a share of all words.

        ``label`` is the language under which the model counted this very text, if it did.
        """
        words = letters(text or "")
        if not words or not self.languages:
            return NONE, 0.0, 0.0
        total, seen = np.zeros(len(self.languages)), []
        for at in range(0, len(words), 4096):
            found = np.array(self.places(words[at : at + 4096]))
            total += self.rows[found].sum(0, dtype=float)
            seen.append(found[found < self.known])
        share, best = np.exp(total - total.max()), int(np.argmax(total))
        place, own = np.unique(np.concatenate(seen), return_counts=True)
        counted = np.exp(self.rows[place, best].astype(float)) * (self.totals[best] + FLOOR)
        elsewhere = counted - (own if label == self.languages[best] else 0) > (1 + FLOOR) / 2
        return self.languages[best], float(share[best] / share.sum()), float(own[elsewhere].sum() / len(words))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of each row's whole text.

    A null text, one without a letter, or a model that never saw a language: ``und`` with score 0.
    Rows stay, with null and repeated ids; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = kept("language", shared.value.mark, lambda: Scorer(shared.value))
        for batch in batches:
            said = [scorer.text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def told(docs: DataFrame, model: Model, learned, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``row, lang, score, known, learned``: each row whole, and what :meth:`Scorer.told` says of it.

    ``learned`` is a condition that tells the rows the model learned from. Nothing is shuffled: each batch
    gets its rows back with the answers. See :func:`identify`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inside = learned & docs[text_col].isNotNull() & docs[lang_col].isNotNull()
    plain = packed(docs, text=docs[text_col], label=F.when(inside, docs[lang_col].cast("string")))
    schema = T.StructType([plain.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType()), T.StructField("learned", T.BooleanType())])

    def run(batches):
        scorer = kept("language", shared.value.mark, lambda: Scorer(shared.value))
        for batch in batches:
            said = [scorer.told(x.as_py(), label) for x, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            answers = [pa.array([s[k] for s in said], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *answers, batch.column(2).is_valid()], names=schema.names)

    return plain.mapInArrow(run, schema)
