"""Names in the questions of listings."""

from pyspark.sql import functions as F

from tapewatch.functions import text
from tapewatch.plans import catalog
from tapewatch.sources import driver


def test_equal_questions_are_read_once(spark, monkeypatch):
    """listings without a question keep their row, and names are looked for in different questions alone."""
    rows = spark.createDataFrame([(k, "Will Iran strike OFAC?" if k % 3 else None) for k in range(300)], "market long, question string")
    monkeypatch.setattr(driver, "listings", lambda *_: rows)
    asked = []
    entities = text.entities
    monkeypatch.setattr(text, "entities", lambda q: asked.append(str(q)) or entities(q))
    found = catalog.entities(spark, "").groupBy("entities").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in found) == [100, 200] and "question" not in {a.split("'")[1] for a in asked}
