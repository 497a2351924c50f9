"""Incremental precomputation: partial sums that arrive are added once; whole segments are overwritten; windowed means of a stream.

Sums are kept by batch: ``<path>/batch=<id>`` has what a batch adds, and a
batch that comes again replaces its own. What a key has is added up over all
committed batches, so the cells of one segment and time may come in any number
of files and batches. ``compact`` adds up batches that are done.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def append_batch(partial: DataFrame, path: str, batch: int) -> None:
    """What a batch adds, written over what the same batch has added before."""
    partial.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def committed(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The folders that count, and the greatest batch: the last compaction that is whole, and all whole batches after it."""
    p, fs = _files(spark, path)
    found = {m[0]: (m[1], int(m[2])) for f in (fs.listStatus(p) if fs.exists(p) else []) if (m := re.fullmatch(r"(batch|upto)=(\d+)", f.getPath().getName()))}
    whole = {name: x for name, x in found.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))}
    base = max((n for kind, n in whole.values() if kind == "upto"), default=-1)
    use = [(n, name) for name, (kind, n) in whole.items() if kind == "upto" and n == base or kind == "batch" and n > base]
    return [f"{path}/{name}" for _, name in sorted(use)], max((n for n, _ in use), default=-1)


def merged(spark: SparkSession, path: str, keys: list[str], sums: list[str], greatest: list[str] = (), least: list[str] = ()) -> DataFrame:
    """(keys, sums, greatest, least) over all committed batches."""
    folders, _ = committed(spark, path)
    if not folders:
        raise FileNotFoundError(f"nothing is committed at {path}")
    every = spark.read.parquet(*folders)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in greatest], *[F.min(c).alias(c) for c in least])


def compact(spark: SparkSession, path: str, keys: list[str], sums: list[str], greatest: list[str] = (), least: list[str] = ()) -> None:
    """One folder for all committed batches so far; their own folders go once it is whole.

    No batch may be under way: what comes again afterwards with a number that
    is compacted is left out.
    """
    folders, last = committed(spark, path)
    if len(folders) < 2:
        return
    merged(spark, path, keys, sums, greatest, least).write.mode("overwrite").parquet(f"{path}/upto={last}")
    for folder in folders:
        p, fs = _files(spark, folder)
        fs.delete(p, True)


def append_segment(batch: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], by: str = "segment") -> None:
    """The results of a batch, written over the partitions of its segments: a replay changes nothing."""
    out = batch.sparkSession
    rows = compute(batch)
    old = out.conf.get("spark.sql.sources.partitionOverwriteMode")
    out.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy(by).parquet(path)
    finally:
        out.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is output at a path of any file system that Spark reaches."""
    p, fs = _files(spark, path)
    return fs.exists(p)


def append_guarded(batch: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], segments: list | None = None, axis: list[str] | None = None, by: str = "segment") -> None:
    """``append_segment`` that adds to existing output only the ``segments`` that are named.

    Without names it refuses, lest segments are added unawares. With ``axis``,
    columns that describe an axis (of density bins, say), the new rows must
    have just the axis that is there. Results are computed once.
    """
    there = exists(batch.sparkSession, path)
    if there and segments is None:
        raise FileExistsError(f"{path} exists: name the segments to add")
    rows = compute(batch if segments is None else batch.where(F.col(by).isin(segments))).persist()
    try:
        if there and axis and not rows.isEmpty():
            old, new = batch.sparkSession.read.parquet(path).select(*axis).distinct(), rows.select(*axis).distinct()
            if not new.subtract(old).isEmpty() or not old.subtract(new).isEmpty():
                raise ValueError(f"the axis {axis} is not that of {path}")
        append_segment(rows, path, lambda df: df, by)
    finally:
        rows.unpersist()


def follow(spark: SparkSession, source: str, schema, path: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame], files: int = 1000) -> StreamingQuery:
    """Add up files as they arrive, ``files`` to a batch; the checkpoint knows which were seen. Stops when all are done.

    ``partial`` gives what a batch adds, by keys; :func:`merged` adds it up.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, batch: append_batch(partial(df), path, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_mean(stream: DataFrame, time: str, keys: list[str], value: str, weight: str | None = None, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, keys, mean, n) of tumbling windows; the state of a key is two sums. Rows later than ``late`` are dropped.

    Works on a stream and, without lateness, on a table.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = own.groupBy(F.window(time, width).alias("_w"), *keys).agg((F.sum(F.col(value) * w) / F.sum(F.when(F.col(value).isNotNull(), w))).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("_w.start").alias("start"), *keys, "mean", "n")
