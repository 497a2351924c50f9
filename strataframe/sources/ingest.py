"""Sources and sinks: raw binary arrays, aliased variables, partitioned output."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_AXES = {"t": "t", "z": "k", "y": "j", "x": "i"}


def read_binary(spark: SparkSession, path: str, dims: str, sizes: dict[str, int], value: str = "value", bits: int = 32, big_endian: bool = True) -> DataFrame:
    """Long rows (file, indices, value) of headerless arrays whose axes are named in ``dims``, such as ``tyx``.

    Each file is decoded by one task, files in parallel; -9999 becomes null. A
    file whose length is no multiple of its slab raises; the first axis may have
    any length.
    """
    if bits not in (32, 64) or not dims or any(d not in _AXES for d in dims):
        raise ValueError("bits must be 32 or 64, dims of the letters t, z, y, x")
    kind, shape = np.dtype(f"{'>' if big_endian else '<'}f{bits // 8}"), [sizes[d] for d in dims[1:]]
    slab = int(np.prod(shape)) if shape else 1

    def decode(frames):
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data = np.frombuffer(raw, kind)
                if data.size % slab:
                    raise ValueError(f"{name}: {data.size} numbers are no multiple of {slab}")
                for n in range(0, data.size // slab, max(1, 200_000 // slab)):
                    part = data[n * slab : (n + max(1, 200_000 // slab)) * slab].astype(float)
                    index = np.unravel_index(np.arange(part.size), [part.size // slab, *shape])
                    cols = {_AXES[d]: (ix + (n if k == 0 else 0)).astype("int32") for k, (d, ix) in enumerate(zip(dims, index, strict=True))}
                    yield pd.DataFrame({"file": name, **cols, value: np.where(part == -9999, np.nan, part)})

    fields = ", ".join(f"{_AXES[d]} int" for d in dims)
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    out = rows.mapInPandas(decode, f"file string, {fields}, {value} double")
    return out.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def write_field(df: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """Partitioned Parquet, one shuffle by the partition columns so that a partition has few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def with_aliases(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Variables under their standard names: the first alias that is not null; null if no alias is a column."""
    out = {std: F.coalesce(*[F.col(a) for a in aliases if a in df.columns]) if any(a in df.columns for a in aliases) else F.lit(None).cast("double") for std, aliases in names.items()}
    rest = [c for c in df.columns if not any(c in a for a in names.values())]
    return df.select(*rest, *[c.alias(n) for n, c in out.items()])


def unpivot(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, name, value): wide variables as rows, without nulls."""
    return df.unpivot(keys, values, "name", "value").where("value IS NOT NULL")


def read_points(spark: SparkSession, path: str, names: list[str], sep: str = " ") -> DataFrame:
    """Observations as separated text, numbers in the order of ``names``."""
    return spark.read.schema(", ".join(f"{n} double" for n in names)).option("sep", sep).csv(path)


def points_to_grid(points: DataFrame, cut: Callable[[DataFrame], DataFrame], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with ``i`` and ``j``, their places among the distinct longitudes and latitudes.

    Coordinates are sorted by ranges and numbered within each; a range's offset
    is the number of coordinates in those before it. So scattered points, with
    as many coordinates as rows, are sorted by all tasks.
    """
    out = points
    for coord, index in ((lon, "i"), (lat, "j")):
        axis = cut(points.select(coord).where(F.col(coord).isNotNull()).distinct().repartitionByRange(coord).sortWithinPartitions(coord).withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33)
        counts = axis.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per range
        offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = axis.withColumn("_part", part).join(counts.select("_part", offset.alias("_before")), "_part")
        out = out.join(numbered.select(coord, (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).cast("int").alias(index)), coord)
    return out


def segments(written: DataFrame, segment: str, time: str) -> DataFrame:
    """(segment, first, last, n_times, files, place): the segments of a run in chronological order, and how many files each has."""
    own = written.select(segment, time, F.col("_metadata.file_path").alias("_file"))
    out = own.groupBy(segment).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(time).alias("n_times"), F.count_distinct("_file").alias("files"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("first", segment)))  # one row per segment


def record_ranges(df: DataFrame, run: list[str], time: str = "t") -> DataFrame:
    """(run, year, first_record, last_record): where the years of every run stand among its records, from 0."""
    own = df.withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(time)) - 1)
    return own.groupBy(*run, F.year(time).alias("year")).agg(F.min("_n").alias("first_record"), F.max("_n").alias("last_record"))
