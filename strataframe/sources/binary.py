"""Headerless arrays as a Spark data source: byte ranges are read in parallel, whole records are written and committed.

A file holds records of the leading axis, each a slab of the other axes in
order. A file that is named by a number starts with that record, as written
ones do; any other starts with record 0. Paths may be of any file system that
Arrow reaches (``file://``, ``hdfs://``, ``s3://`` ...).
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

AXES = {"t": "t", "z": "k", "y": "j", "x": "i"}
MISSING = -9999.0
SPLIT_BYTES = 64 << 20
_NUMBERS = 1 << 17  # of a batch


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


@dataclass
class Layout:
    """Axes as letters, the leading one first; lengths of the others; numbers of 32 or 64 bits in either byte order."""

    dims: str
    sizes: dict[str, int]
    value: str = "value"
    bits: int = 32
    big_endian: bool = True

    def __post_init__(self) -> None:
        if self.bits not in (32, 64) or not self.dims or len(set(self.dims)) < len(self.dims) or any(d not in AXES for d in self.dims) or any(d not in self.sizes for d in self.dims[1:]):
            raise ValueError("bits must be 32 or 64, dims different letters of t, z, y, x with a size for all but the first")

    @classmethod
    def of(cls, options: dict[str, str]) -> Layout:
        return cls(**json.loads(options["layout"]))

    def option(self) -> str:
        return json.dumps(self.__dict__)

    @property
    def shape(self) -> list[int]:
        return [int(self.sizes[d]) for d in self.dims[1:]]

    @property
    def slab(self) -> int:
        return int(np.prod(self.shape)) if self.shape else 1

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"{'>' if self.big_endian else '<'}f{self.bits // 8}")

    @property
    def keys(self) -> list[str]:
        return [AXES[d] for d in self.dims]


@dataclass
class Range(InputPartition):
    path: str
    first: int  # record of the first number
    offset: int
    numbers: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.layout, self.path, self.split = Layout.of(options), options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        files, root = place(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root))
        record, out = self.layout.slab * self.layout.kind.itemsize, []
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.size % record:
                raise ValueError(f"{f.path}: {f.size} bytes are no multiple of {record}")
            stem = f.base_name.partition(".")[0]
            first, step = int(stem) if stem.isdigit() else 0, max(1, self.split // record)
            out += [Range(f.path, first + n, n * record, min(step, f.size // record - n) * self.layout.slab) for n in range(0, f.size // record, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.numbers:
            return
        files, _ = place(self.path)
        kind, shape, slab = self.layout.kind, self.layout.shape, self.layout.slab
        with files.open_input_file(partition.path) as f:
            f.seek(partition.offset)
            for at in range(0, partition.numbers, _NUMBERS):
                n = min(_NUMBERS, partition.numbers - at)
                data = np.frombuffer(f.read(n * kind.itemsize), kind).astype(float)
                number = np.arange(at, at + n)
                inside = np.unravel_index(number % slab, shape) if shape else ()
                index = [partition.first + number // slab, *inside]
                cols = [pa.array([partition.path] * n), *[pa.array(x.astype(np.int32)) for x in index], pa.array(data, mask=(data == MISSING) | np.isnan(data))]
                yield pa.RecordBatch.from_arrays(cols, names=["file", *self.layout.keys, self.layout.value])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Rows (record, number, value), all those of a file together; files appear under their names only when all tasks are done."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.layout, self.path, self.records = Layout.of(options), options["path"], int(options["records"])
        self.overwrite, self.run = overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = place(self.path)
        files.create_dir(root, recursive=True)
        out, slab = [], self.layout.slab
        name, data, last = -1, np.zeros(0), 0

        def flush():
            if name >= 0:
                there = posixpath.join(root, f"_{self.run}-{uuid.uuid4().hex}")
                with files.open_output_stream(there) as f:
                    f.write(data[: (last + 1) * slab].astype(self.layout.kind).tobytes())
                out.append((there, posixpath.join(root, f"{name * self.records:012d}.bin")))

        for batch in batches:
            record, number, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            block = record // self.records
            for a, b in zip(np.append(0, np.flatnonzero(np.diff(block)) + 1), np.append(np.flatnonzero(np.diff(block)) + 1, len(block)), strict=True):
                if a == b:
                    continue
                if block[a] != name:
                    flush()
                    name, data, last = int(block[a]), np.full(self.records * slab, np.nan), 0
                at = (record[a:b] - name * self.records) * slab + number[a:b]
                if len(np.unique(at)) < len(at) or not np.isnan(data[at]).all():
                    raise ValueError(f"several values of one cell in record {int(record[a])} or later")
                data[at] = np.where(np.isnan(value[a:b]), MISSING, value[a:b])
                last = max(last, int((record[a:b] - name * self.records).max()))
        if name >= 0:
            data[np.isnan(data)] = MISSING
        flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = place(self.path)
        done = [pair for m in messages if m for pair in m.files]
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".bin"):
                    files.delete_file(f.path)
        for old, new in done:
            files.move(old, new)
        self._sweep(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*place(self.path))

    def _sweep(self, files: fs.FileSystem, root: str) -> None:
        """What tasks of this run have left that failed or ran twice."""
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                files.delete_file(f.path)


class RawArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_arrays"

    def schema(self) -> str:
        layout = Layout.of(self.options)
        return ", ".join(["file string", *[f"{k} int" for k in layout.keys], f"{layout.value} double"])

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), overwrite)


def read_arrays(spark: SparkSession, path: str, layout: Layout, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows (file, indices, value) of all files at ``path``, ``split_bytes`` of a file to a task; -9999 and NaN become null.

    A file whose length is no multiple of a record is an error; an empty folder gives no rows.
    """
    spark.dataSource.register(RawArrays)
    return spark.read.format("raw_arrays").option("layout", layout.option()).option("splitbytes", split_bytes).load(path)


def write_arrays(df: DataFrame, path: str, layout: Layout, records_per_file: int, overwrite: bool = False) -> None:
    """Whole records, ``records_per_file`` to a file that is named by its first one; cells without a row or a value become -9999.

    Tasks write under names of their own, so a failed or repeated task leaves
    nothing. A file is one task's memory. Two rows of one cell, and indices outside the sizes, are errors.
    """
    df.sparkSession.dataSource.register(RawArrays)
    first, number, inside = layout.keys[0], F.lit(0), F.col(layout.keys[0]) >= 0
    for d, n in zip(layout.dims[1:], layout.shape, strict=True):
        number, inside = number * n + F.col(AXES[d]), inside & F.col(AXES[d]).between(0, n - 1)
    own = df.select(F.when(inside, F.col(first)).otherwise(F.raise_error(F.lit("an index is outside the sizes"))).cast("long").alias("record"), number.cast("long").alias("number"), F.col(layout.value).cast("double").alias("value"))
    own = own.withColumn("block", F.floor(F.col("record") / records_per_file)).repartition("block").sortWithinPartitions("block", "record").drop("block")
    own.write.format("raw_arrays").option("layout", layout.option()).option("records", records_per_file).mode("overwrite" if overwrite else "append").save(path)
