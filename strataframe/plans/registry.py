"""All registered queries and their DuckDB SQL."""

from strataframe.plans import changes, fields, further, more, named, rest, spaces  # noqa: F401  importing registers their queries
from strataframe.plans.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
