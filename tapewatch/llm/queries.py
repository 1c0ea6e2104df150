"""The queries ``opN_<name>``: each applies its operator to whole tables with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversation_repair, embedding_dedup, language_counts, line_dedup, mixing, quality_model, quality_rules, rans, sequence_packing, sharding, simhash
from ._common import crc_mod, staged, table


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in one of 24 shards; equal texts stay together, sizes are near equal."""
    found = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of documents."""
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), simhash.SimHash(words=4, bits=64, distance=4))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def byte_bpe(name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Encoder:
    """The encoder of a public vocabulary file."""
    import public_tokenizers

    return bpe.Encoder(bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of documents."""
    encoder = byte_bpe()
    return bpe.round_trip(table(spark, sf_dir, "documents"), encoder).withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, removed_lines, text`` for every row of documents."""
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), removed_col="removed_lines")
    return found.select("doc_id", "removed_lines", "text")


def domain():
    """Domain of a source: its number modulo four."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long") % 4, F.lit(0)))


def estimated_tokens():
    """Four bytes of text to a token, rounded up; null texts have none."""
    return F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)


def mix(share: float, epochs: int) -> mixing.Mix:
    """Domains four to one, the first heaviest; languages by their weight in each; sources alike."""
    weights: dict[tuple, float] = {}
    for k, w in enumerate((4.0, 3.0, 2.0, 1.0)):
        weights[(f"domain{k}",)] = w
        weights |= {(f"domain{k}", lang): x for lang, x in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))}
    return mixing.Mix(("domain", "lang", "source"), weights, share=share, epochs=epochs)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, epoch``: a row for each time that a document is taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", domain().alias("domain"), estimated_tokens().alias("tokens"))
    return mixing.select(docs, mix(share=0.8, epochs=2), "doc_id", "tokens").withColumnRenamed("id", "doc_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for every row of documents, from the files read back."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    folder = rans.new_folder(spark)
    rans.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2, vocabulary=50_257)
    found = rans.read_tokens(spark, folder)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9).withColumnRenamed("id", "vec_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of documents; learns from rows not held out."""
    docs = table(spark, sf_dir, "documents")
    out = crc_mod("doc_id", 4) == 2
    counts = language_counts.learn(docs.where(F.coalesce(~out, F.lit(True))))
    found = language_counts.identify(docs, counts).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of documents; learns from rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"), train_on=crc_mod("id", 5) != 0)
    found = quality_model.score(docs, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row of documents."""
    measured = staged(quality_rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality_rules.learn_rules(measured, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(measured, rules).withColumnRenamed("id", "doc_id")


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row of documents."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return sequence_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer, end_id=1).drop("tokens").withColumnRenamed("id", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best 2,000 phrases of each language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair, audit and hash of every damaged conversation."""
    given = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damaged(given), given.select(F.col("conv_id").alias("conv")))
    return found.withColumnsRenamed({"conv": "conv_id", "sha": "repaired_sha256"})


QUERIES = {f.__name__: f for f in (op1_shards, op2_simhash_near_dedup, op3_byte_bpe, op4_line_dedup, op5_token_files, op6_embedding_near_dedup, op7_source_mix, op8_language_id, op9_quality_model, op10_quality_rules, op11_sequence_packing, op12_collocations, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op4_line_dedup": line_dedup.SQL, "op12_collocations": collocations.SQL, "op13_conversation_repair": conversation_repair.SQL}
