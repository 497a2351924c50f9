"""Registration of queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.sources.views import VIEWS

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable:
    """Register a function under its name; ``sql`` may use the views of :mod:`strataframe.sources.views`."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = (VIEWS + "\n" if views else "") + sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    """Doubles rounded, so that results of two engines compare; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) + 0.0 for c in cols})
