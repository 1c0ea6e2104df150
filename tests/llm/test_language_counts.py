"""Language identification with all counts against a plain scorer."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from tapewatch.llm import language_counts, language_id

SF = "/root/testdata/sf0.001"


class Plain:
    """Dictionaries of all counts, and one text after another."""

    def __init__(self, rows):
        self.words, self.grams = {}, {}
        for text, lang in rows:
            if text is not None and lang is not None:
                self.words.setdefault(lang, Counter()).update(language_id.letters(text))
        self.languages = sorted(x for x, c in self.words.items() if c)
        for lang, c in self.words.items():
            for w, n in c.items():
                for k in (1, 2, 3, 4):
                    for i in range(max(1, len(w) + 3 - k)):
                        self.grams.setdefault((lang, k), Counter())[f" {w} "[i : i + k]] += n
        self.known = set().union(*self.words.values()) if self.words else set()

    def log(self, counts, key):
        return math.log((counts.get(key, 0) or 0.5) / (sum(counts.values()) + 0.5))

    def score(self, word):
        if word in self.known:
            return np.array([self.log(self.words[x], word) for x in self.languages])
        for k in (4, 3, 2, 1):
            cut = [f" {word} "[i : i + k] for i in range(max(1, len(word) + 3 - k))]
            if cut := [g for g in cut if any(g in self.grams[x, k] for x in self.languages)]:
                return np.mean([[self.log(self.grams[x, k], g) for x in self.languages] for g in cut], 0)
        return np.zeros(len(self.languages))

    def text(self, text):
        words = Counter(language_id.letters(text or ""))
        if not words or not self.languages:
            return "und", 0.0
        total = sum(n * self.score(w) for w, n in words.items())
        share = np.exp(total - total.max())
        return self.languages[int(np.argmax(total))], share.max() / share.sum()


@pytest.mark.parametrize("cache", [0.5, 300, 4_000_000])
def test_equals_a_plain_scorer_whatever_the_cache(spark, monkeypatch, cache):
    monkeypatch.setattr(language_counts, "CACHE", cache)
    docs = duckdb.sql(f"select text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()
    rows = docs[:120] + [(None, "en"), ("", "de"), ("alone", None), ("½ ²", "fr")]
    asked = [t for t, _ in docs[100:]] + ["zzqx unheard wörds", "½ ²", "x", None, "", "日本 語", "qqqqqqqq", "the the the der der"]
    plain = Plain(rows)
    train = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as word", "2 as has", "3 as n")
    table = spark.createDataFrame([(i % 7, t) for i, t in enumerate(asked)] + [(None, "the end")], "doc_id long, text string").selectExpr("*", "1 as key", "2 as sums", "3 as word")
    got = language_counts.identify(table, language_counts.learn(train)).collect()
    want = Counter((i % 7, plain.text(t)[0]) for i, t in enumerate(asked)) + Counter([(None, plain.text("the end")[0])])
    assert Counter((r["id"], r["lang_pred"]) for r in got) == want
    scores = sorted(plain.text(t)[1] for t in [*asked, "the end"])
    assert np.allclose(sorted(r["score"] for r in got), scores, atol=1e-4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    assert language_counts.identify(none, language_counts.learn(some)).count() == 0
    assert [tuple(r) for r in language_counts.identify(some, language_counts.learn(none)).collect()] == [(1, "und", 0.0)]


def test_every_seen_word_counts(spark):
    """A word seen once among very many others is known, however rare."""
    rows = [("aaa " * 50_000 + "needle", "en"), ("bbb " * 50_000, "de")]
    train, asked = spark.createDataFrame(rows, "text string, lang string"), spark.createDataFrame([(1, "needle")], "doc_id long, text string")
    plain = Plain(rows)
    got = language_counts.identify(asked, language_counts.learn(train)).first()
    assert got["lang_pred"] == "en" and got["score"] == pytest.approx(plain.text("needle")[1])


def test_the_cache_is_filled(spark, monkeypatch):
    """Words of one count share are let in until the cache is full, not only those above a fixed share of all."""
    rows = [(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)} " * (300 - i) for i in range(300)), "en")]
    counts = language_counts.learn(spark.createDataFrame(rows, "text string, lang string"))
    for room, least in ((300, 300), (200, 150), (20, 1), (0.5, 0)):
        monkeypatch.setattr(language_counts, "CACHE", room)
        names, logs = language_counts._cached(counts)
        assert least <= len(names) == len(logs) <= room
