"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words and pairs of words are hashed into 2^bits weights. Training takes one labelled text after
another (FTRL-proximal with per-weight rates and L1, which keeps most weights at zero); a score is the
logistic function of a sparse dot product.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import staged

BITS = 18
PIECE = 1 << 16


@dataclass
class Model:
    """Weights of 2^bits features; the last one is the constant."""

    weights: np.ndarray
    bits: int = BITS


def _word_marks(words: list[bytes], remembered: dict[bytes, int]) -> np.ndarray:
    """A 32-bit hash of each word."""
    found = [*map(remembered.get, words)]
    if None in found:
        if len(remembered) > 500_000:
            remembered.clear()
        for w in {w for w, f in zip(words, found, strict=True) if f is None}:
            remembered[w] = zlib.crc32(w)
        found = [remembered[w] if w in remembered else zlib.crc32(w) for w in words]
    return np.array(found, np.uint64)


def _bucket(marks: np.ndarray, bits: int) -> np.ndarray:
    return ((marks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS, remembered: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their values: (1 + log count) over the length of that vector.

    Words are runs without white space, in pieces: the word, its shape (case, digits and signs), and
    each pair of neighbours. An empty or null text has the constant alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    remembered = {} if remembered is None else remembered
    constant = (1 << bits) - 1
    if not words:
        return np.array([constant]), np.ones(1)
    all_at, all_n = [], []
    for at in range(0, len(words), PIECE):
        marks = _word_marks(words[at : at + PIECE + 1], remembered)
        shapes = np.array([(w.isupper() << 3) | (w.isdigit() << 2) | (not w.isalpha() and not w[:-1].isalpha()) << 1 | w[:1].isupper() for w in words[at : at + PIECE]], np.uint64)
        own = marks[:PIECE]
        tails = np.array([w[-1] for w in words[at : at + PIECE]], np.uint64)
        pairs = marks[:-1] * np.uint64(31) + marks[1:] + np.uint64(1 << 40)
        repeat = (marks[:-1] == marks[1:]).astype(np.uint64) + np.uint64(1 << 44)
        raw = np.concatenate([own, pairs, shapes + np.uint64(1 << 42), tails + np.uint64(1 << 43), repeat])
        found, n = np.unique(_bucket(raw, bits), return_counts=True)
        all_at.append(found)
        all_n.append(n)
    at, where = np.unique(np.concatenate(all_at), return_inverse=True)
    n = np.bincount(where, np.concatenate(all_n))
    value = 1 + np.log(n)
    value /= math.sqrt(float(value @ value))
    size = _bucket(np.array([(1 << 41) + min(15, len(words).bit_length())], np.uint64), bits)
    return np.concatenate([at, size, [constant]]), np.concatenate([value, [0.3, 1.0]])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.02) -> Model:
    """FTRL-proximal over the rows in the given order; no rows give all-zero weights."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at):
        zs = z[at]
        w = (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(passes):
        for at, value, label in rows:
            w = weights(at)
            step = (_sigmoid(float(w @ value)) - label) * value
            root = np.sqrt(n[at])
            more = n[at] + step * step
            z[at] += step - (np.sqrt(more) - root) / alpha * w
            n[at] = more
    return Model(weights(np.arange(1 << bits)), bits)


def learn(docs: DataFrame, labels: DataFrame, train_on, most_rows: int = 8_000, most_bytes: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS) -> Model:
    """Train on rows for which ``train_on`` (a Column over ``id``) holds.

    ``most_rows`` bounds the labelled rows, taken in order of a hash of the id; of each class half at
    most, while there are enough of both. Their hashed features reach the driver, not their texts, and
    ``most_bytes`` bounds these: rows after that bound are left out. The constant is then moved by the
    log odds of label 1 in all labelled rows against those in the sample, so that scores are likelihoods.
    Rows with a null id or label are left out; an id that repeats counts once, with its least text.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & train_on)
    known = staged(known, "known")
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("id"), F.lit(9))
    chosen = known.where("label = 0").orderBy(order).limit(most_rows // 2).unionAll(known.where("label = 1").orderBy(order).limit(most_rows // 2))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        remembered: dict = {}
        for batch in batches:
            for k in range(len(batch)):
                at, value = features(batch.column(1)[k].as_py(), bits, remembered)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([at.astype("<i4").tobytes()]), pa.array([value.astype("<f4").tobytes()])], names=["id", "label", "at", "value"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])
    got = texts.select("id", "label", "text").select("id", "text", "label").mapInArrow(run, schema)
    got = staged(got.groupBy("id").agg(F.min(F.struct("at", "value", "label")).alias("x")).select("id", "x.*").withColumn("turn", F.xxhash64(F.col("id"), F.lit(10))), "features")
    sizes = got.select("id", "turn", (F.octet_length("at") + F.octet_length("value")).alias("size")).orderBy("turn", "id").toPandas()
    fits = sizes["size"].cumsum() <= most_bytes
    if not fits.all():
        got = got.where(F.col("id").isin(sizes["id"][fits].tolist()))
    got = got.orderBy("turn", "id").toPandas()
    rows = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), int(y)) for a, v, y in zip(got["at"], got["value"], got["label"], strict=True)]
    model = train(rows, bits)
    taken = {y: sum(r[2] == y for r in rows) for y in (0, 1)}
    if taken[0] and taken[1]:
        model.weights[-1] += math.log(share[1] / share[0]) - math.log(taken[1] / taken[0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of each row's whole text; null and empty texts get the constant's score.

    Rows stay, with null and repeated ids; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        own, remembered = shared.value, {}
        for batch in batches:
            found = []
            for x in batch.column(1):
                at, value = features(x.as_py(), own.bits, remembered)
                found.append(_sigmoid(float(own.weights[at] @ value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
