"""Queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import near, substrings, suffixes
from strataframe.llm.cluster import Scratch
from strataframe.llm.queries_text import table
from strataframe.llm.spread import NO_ID


def own_id(col: str = "id"):
    return F.when(F.col(col) != NO_ID, F.col(col)).alias("doc_id")


def op3_ngram_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op3")
    found = near.components(docs, scratch=scratch)
    component = F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id")
    return scratch.result(found.select(own_id(), "n_shingles", component))


def op6_substring_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op6")
    return scratch.result(substrings.remove(docs, keep_text=False, scratch=scratch).select(own_id(), "n_words", "n_removed", "kept_sha256"))


def op9_suffix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op9")
    return scratch.result(suffixes.remove(docs, keep_bytes=False, scratch=scratch).select(own_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), least AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN least USING (g) WHERE m < doc_id
), word AS (
  SELECT doc_id, k, w[k] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)
), kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY k) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op3_ngram_rtree": op3_ngram_rtree, "op6_substring_cover": op6_substring_cover, "op9_suffix_doubling": op9_suffix_doubling}
SQL = {"op3_ngram_rtree": OP3_SQL, "op6_substring_cover": OP6_SQL}
