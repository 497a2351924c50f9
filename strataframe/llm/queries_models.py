"""Queries of periodic runs, language-model scores and hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import hmm, negatives, runs
from strataframe.llm.cluster import Scratch
from strataframe.llm.queries_text import table

WORD = r"[^\x20\x09-\x0D]+"


def repeating(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document (by checksum of its id) with its words from one on replaced by repeats of the first of them."""
    h, w = F.crc32(doc_id.cast("string").cast("binary")), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    g, n = F.floor(h / 10), F.size(w).cast("long")
    a = g % n
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    a, rest = a.cast("int"), (n - a).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & F.coalesce(F.size(w) > 0, F.lit(False)), F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find(docs).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return own.select(
        "doc_id", "n_runs", (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"),
        F.floor(1000 * F.col("r.length") / -F.col("r.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "op12")
    found = hmm.score(docs, ~held, scratch=scratch)
    return scratch.result(found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scratch = Scratch(spark, "op13")
    return scratch.result(negatives.mine(rows, F.col("id") % 100 == 0, label, scratch=scratch))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(s[k // 9 + 1])::BIGINT) ELSE xor(c >> 1, (c & 1) * 3988292384) END FROM crc WHERE k < 9 * length(s)
), g AS (
  SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS h FROM crc WHERE k = 9 * length(s)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents LEFT JOIN g USING (doc_id)
), part AS (
  SELECT r, doc_id, w, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts, coalesce(h % 10 = 0, false) AND len(w) > 0 AS again FROM d
), turned AS (
  SELECT r, doc_id, n, w, a, again, 1 + (n - a) // parts AS p FROM part
), word AS (
  SELECT r, i, CASE WHEN again AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM turned)
), three AS (
  SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS x FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
), pair AS (
  SELECT a.r, a.i, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS island
  FROM three a JOIN three b ON a.r = b.r AND a.x = b.x AND b.i > a.i JOIN turned t ON t.r = a.r WHERE 4 * (b.i - a.i) <= t.n
), stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q + 2 AS length FROM pair GROUP BY r, q, island HAVING count(*) + q + 2 >= greatest(6, 4 * q)
), run AS (
  SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length
), digest AS (
  SELECT r, count(*) AS n_runs, max({'l': length, 's': -start, 'p': -period}) AS m, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS list FROM run GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -m.s AS start, m.l AS length, -m.p AS period, 1000 * m.l // -m.p AS exponent_milli,
       sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM turned LEFT JOIN digest USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor, a.label AS own, r.vec_id AS id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor, id, score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 10
"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs, "op12_hidden_markov": op12_hidden_markov, "op13_residue_negatives": op13_residue_negatives}
SQL = {"op11_periodic_runs": OP11_SQL, "op13_residue_negatives": OP13_SQL}
