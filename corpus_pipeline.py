"""Corpus preparation in five stages, each over all that the one before it kept.

1. language: documents whose language can't be told go (no letter, an even score, or words that the language doesn't know).
2. lines: boilerplate lines that stand on many sources leave every place but their first.
3. near_duplicates: one document of each group of near copies stays: found by fingerprints of five-word shingles, compared by the shingles.
4. mix: documents are chosen so that domains, languages and sources come near their target weights.
5. tokens: byte-level BPE ids of each document, decoded again and compared by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import bpe, language_id, line_dedup, mixing, queries, simhash
from tapewatch.llm._common import crc_mod, staged, table

#: The language told needs this many times the share that each of the learned languages would have if all were alike.
SURE = 1.2

#: One learned row in so many may know fewer of its words from other texts than the bound that all rows must reach.
FEW = 0.001

#: Documents are near copies from a Jaccard similarity of 0.8 of their distinct five-word shingles. A pair at 0.8
#: differs in about 39 of 256 bits (0.153), give or take 6; unrelated ones in 128, give or take 8. It is a candidate
#: at 60 bits or fewer, and shares one of the drawn patterns with a chance of 0.999. Candidates are compared exactly.
NEAR = simhash.SimHash(words=5, bits=256, distance=60, differ=0.153, ties=True, similar=80)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told: the score is ``SURE`` even shares or more, and the language knows enough of the words.

    The model learns from rows of ``docs`` that have a language, but for a quarter held out by id; the
    language becomes what was told. The share of words that other texts of the language have must be over 0
    and reach the value that all learned rows of the language but one in a thousand (``FEW``) reach.
    """
    learned = F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True))
    model = language_id.learn(docs.where(learned))
    found = staged(language_id.told(docs, model, learned).where(F.col("lang") != language_id.NONE), "told")
    least = found.where("learned").groupBy("lang").agg(F.percentile_approx("known", F.lit(FEW), F.lit(100_000)).alias("least"))
    clear = (F.col("score") >= min(1.0, SURE / max(1, len(model.languages)))) & (F.col("known") > 0) & (F.col("known") >= F.coalesce("least", F.lit(0.0)))
    return found.join(F.broadcast(least), "lang", "left").where(clear).select(*(F.col("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; boilerplate lines are cut from their texts and ``n_chars`` counts what is left."""
    cut = line_dedup.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id."""
    return simhash.drop_near_duplicates(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that one epoch takes for nine tenths of the tokens, at the weights of the query ``op7``."""
    levels = {"domain": queries.domain(), "lang": docs["lang"], "source": docs["source"]}
    return mixing.keep_selected(docs, queries.mix(share=0.9, epochs=1), "doc_id", queries.estimated_tokens(), levels)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, tokens`` of every row's whole text."""
    encoder = queries.byte_bpe()
    return bpe.round_trip(docs, encoder, keep_tokens=True).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Hashes, models and seeded choices have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
