"""Queries of the operators that use DataFrame functions only: chat, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import chat, mixing, sharding
from strataframe.llm.queries_text import table


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
  FROM conversations
), p AS (
  SELECT conv_id, pos, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w AS prefix,
         lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT prefix, pos AS n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE last GROUP BY 1, 2
), top AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.last AND p.pos = whole.n_turns AND p.prefix = whole.prefix)
)
SELECT top.conv_id, n_turns, n_copies,
       string_agg('<|im_start|>' || replace(replace(role, '<|', '< |'), '|>', '| >') || chr(10)
                  || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM top JOIN t USING (conv_id) GROUP BY ALL
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), level AS (
  SELECT 0 AS n, CAST(0.0 AS DOUBLE) AS x
  UNION ALL
  SELECT n + 1, ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3.0 * source_size), 0) FROM s WHERE w * level.x > 3.0 * source_size))
                / (SELECT sum(w) FROM s WHERE w * level.x <= 3.0 * source_size)
  FROM level WHERE n < 40 AND (SELECT sum(w) FROM s WHERE w * level.x <= 3.0 * source_size) > 0
), t AS (
  SELECT source, source_size, least(w * (SELECT max(x) FROM level), 3.0 * source_size) AS target FROM s
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, greatest(CAST(round(f.target) AS BIGINT) - f.whole * f.source_size, 0) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken
FROM r
"""

QUERIES = {"op1_chat_snapshots": op1_chat_snapshots, "op4_source_mixing": op4_source_mixing, "op7_jump_sharding": op7_jump_sharding}
SQL = {"op1_chat_snapshots": OP1_SQL, "op4_source_mixing": OP4_SQL}
