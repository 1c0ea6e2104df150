"""Cases that earlier versions of the operators got wrong."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapewatch.llm import embedding_dedup, line_dedup, pieces

DOCS = "doc_id long, text string, source string"


def test_lines_of_documents_with_a_column_of_the_same_name(spark):
    rows = [(i, f"all say this\nonly {i} says this", f"s{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 as removed_lines", "1 as cut", "2 as lines", "3 as row", "4 as pos")
    got = line_dedup.drop_boilerplate(docs, removed_col="removed_lines").orderBy("doc_id").collect()
    assert [(r["text"], r["removed_lines"], r["cut"], r["lines"], r["row"], r["pos"]) for r in got] == [(rows[0][1], 0, 1, 2, 3, 4)] + [(f"only {i} says this", 1, 1, 2, 3, 4) for i in range(1, 20)]


def test_many_boilerplate_lines_take_linear_time(spark):
    text = "\n".join(f"line {i}" for i in range(100_000))
    docs = spark.createDataFrame([(i, f"{text}\nown {i}", f"s{i}") for i in range(13)], DOCS)
    began = time.time()
    got = line_dedup.drop_boilerplate(docs, removed_col="gone").agg(F.sum("gone"), F.sum(F.length("text"))).first()
    assert got[0] == 12 * 100_000 and time.time() - began < 120


def test_vectors_of_each_length_are_compared_among_themselves(spark):
    r = np.random.default_rng(2)
    base = {n: r.normal(size=(30, n)) for n in (1, 3, 8, 16)}
    rows = [(k, v.tolist()) for k, v in enumerate([x for n in (16, 3, 8) for x in np.concatenate([base[n], base[n][:5] + 0.01 * r.normal(size=(5, n)), base[n][:2]])] + [np.array([2.0]), np.array([5.0]), np.array([-1.0])])]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16)]
    got = {x["id"]: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if k < 900}
    for k, u in unit.items():
        assert got[k]["n_links"] == sum(j != k and len(w) == len(u) and w @ u >= 0.9 for j, w in unit.items())
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in (900, 901, 902, 903))


def test_a_worker_lets_go_of_what_an_earlier_step_kept():
    pieces.kept("earlier", 1, lambda: "large")
    pieces.let_go()
    assert not pieces._OWN


def test_a_worker_remembers_no_more_pieces_than_its_bound():
    memory = pieces.Memory(lambda parts: [[len(p), ord(p[-1])] for p in parts], "<i4", most=5)
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)] * 2
    got = []
    for _, tokens, sizes in memory.batches(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), 0):
        assert len(memory.young) <= 5 and len(memory.old) <= 5  # one slice alone brings more
        got += np.split(tokens, np.cumsum(sizes)[:-1])
    want = [[x for p in pieces.cut(pa.array([t]))[0].as_py() for x in (len(p), ord(p[-1]))] for t in texts]
    assert [g.tolist() for g in got] == want
