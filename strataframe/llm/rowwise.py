"""Apply an Arrow-batch function to the rows of a DataFrame and append what it returns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], fn: Callable, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``fields`` appended and without the columns ``drop``; a column of ``df`` with the name of a new one is replaced.

    ``fn`` gets one Arrow array per input column and returns one array per new field.
    No shuffle: rows stay where they are.
    """
    names = [f.name for f in fields]
    at = [df.columns.index(c) for c in inputs]
    keep = [i for i, c in enumerate(df.columns) if c not in names and c not in drop]
    schema = T.StructType([df.schema.fields[i] for i in keep] + fields)

    def run(batches):
        for batch in batches:
            new = fn(*[batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(new), names=schema.names)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever the case."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]
