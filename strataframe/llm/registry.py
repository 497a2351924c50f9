"""All queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from strataframe.llm import queries_dedup, queries_models, queries_native, queries_text

QUERIES = {**queries_text.QUERIES, **queries_native.QUERIES, **queries_dedup.QUERIES, **queries_models.QUERIES}
SQL = {**queries_text.SQL, **queries_native.SQL, **queries_dedup.SQL, **queries_models.SQL}
