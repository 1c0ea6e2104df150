"""Line deduplication by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites that show it; sketches merge by aggregation.
Lines whose estimate is clearly over the threshold are boilerplate, clearly under it are not; lines
near it get an exact distinct count. Boilerplate lines leave every place but their first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import packed, staged

SITES = 12
PRECISION = 10
DEVIATIONS = 5


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``id, doc, site, pos, key`` of each line with something but blanks in it."""
    text = F.col(text_col)
    # texts are hashed before they are exploded, or each line would hash its whole text
    apart = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"), F.col(site_col).cast("string").alias("site"), F.split(text, "\n").alias("lines"))
    rows = apart.select("id", "doc", "site", F.posexplode("lines").alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''").select("id", "doc", "site", "pos", F.xxhash64("line").alias("key"))


def boilerplate(docs: DataFrame, id_col: str, text_col: str, site_col: str, sites: int = SITES) -> DataFrame:
    """``key, first`` of lines on ``sites`` sites or more; first is (id, doc, pos) of the place that stays."""
    lines = _lines(docs, id_col, text_col, site_col)
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", PRECISION).alias("sketch"), F.min(F.struct("id", "doc", "pos")).alias("first"))
    error = DEVIATIONS * 1.04 / 2 ** (PRECISION / 2)
    guess = staged(sketched.select("key", "first", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= sites * (1 - error) - 1), "guess")
    near = guess.where(F.col("n") <= sites * (1 + error) + 1)
    counted = lines.join(near.select("key"), "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("key").agg(F.count("site").alias("exact")).where(F.col("exact") >= sites).select("key")
    sure = guess.where(F.col("n") > sites * (1 + error) + 1).select("key", "first")
    return sure.unionAll(near.join(exact, "key").select("key", "first"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, removed_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text; every row and column stays.

    Lines are compared without blanks at their ends; blank lines are left alone. Of a boilerplate line
    the place with the least (id, hash of text, position) stays. A null site is no site. Null and
    empty texts stay as they are; a text of nothing but boilerplate becomes empty. Rows that repeat id
    and text are cut alike. ``removed_col`` adds the number of lines cut, in place of a column of that name.
    """
    found = staged(boilerplate(docs, id_col, text_col, site_col, sites), "boilerplate")
    place = F.struct("id", "doc", "pos")
    cut = _lines(docs, id_col, text_col, site_col).join(found, "key").where(~place.eqNullSafe(F.col("first")))
    lists = staged(cut.groupBy("id", "doc").agg(F.collect_set("pos").alias("cut")), "cut")
    rows = packed(docs, row_id=docs[id_col], row_text=docs[text_col])
    joined = rows.join(lists, F.col("row_id").eqNullSafe(F.col("id")) & (F.xxhash64("row_text") == F.col("doc")), "left")
    # lines come out of an explode as a column of their own: inside a lambda the text would be split anew for each line
    apart = joined.withColumn("lines", F.explode(F.array(F.split("row_text", "\n"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    rest = F.when(F.col("cut").isNull(), F.col("row_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = [rest.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c != removed_col]
    gone = F.size(F.coalesce(F.col("cut"), F.array().cast("array<int>"))).cast("long")
    return apart.select(*out, *([gone.alias(removed_col)] if removed_col else []))


SQL = f"""
WITH parts AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), places AS (
  SELECT doc_id, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM parts
), spread AS (
  SELECT trim(line) AS line FROM places WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}
), marked AS (
  SELECT p.doc_id, p.pos, p.line,
         s.line IS NOT NULL AND row_number() OVER (PARTITION BY trim(p.line) ORDER BY p.doc_id, p.pos) > 1 AS gone
  FROM places p LEFT JOIN spread s ON trim(p.line) = s.line
), rebuilt AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS removed_lines,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.removed_lines, 0) AS removed_lines, CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
