"""Shared-folder tables that cut lineage, and the session settings they need."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a query's shuffle files when the query ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every machine must reach; without it there is no place to cut lineage."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and re.match(r"local(\[|$)", spark.sparkContext.master):
        found = "file://" + tempfile.mkdtemp(prefix="spark-")  # one machine only: its own disk is shared
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


class Scratch:
    """Intermediate tables of one operator call, in the shared folder.

    ``cut`` writes a DataFrame as Parquet and reads it back: later plans start
    from the files, so a lost executor costs only a re-read, and the shuffles
    before them are deleted. ``release`` deletes tables from which nothing is
    read any more. Whoever is done with a result calls ``close``, which deletes
    all tables; ``result`` writes a result to a place of its own and closes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.live: list[str] = []

    def _written(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def cut(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = self._written()
        with setting(self.spark, CLEANUP, "true"):
            df.write.option("compression", codec).parquet(path)
        self.live.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, files: int) -> DataFrame:
        """``df`` written in ``files`` buckets by ``key``: later groupings by it need no shuffle.

        Only a table can be bucketed; it leaves the catalog as soon as it is
        read, and its files stay until ``close``.
        """
        name, path = f"scratch_{uuid.uuid4().hex}", self._written()
        try:
            with setting(self.spark, CLEANUP, "true"):
                df.repartition(files, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(files, key).saveAsTable(name)
            out = self.spark.table(name)
            out.schema  # noqa: B018  the plan has the files and their buckets from here on
            return out
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def so_far(self) -> list[str]:
        """The tables that ``cut`` has written and that are still there."""
        return list(self.live)

    def release(self, paths: list[str]) -> None:
        """Delete tables; only when whatever is read from them has been written."""
        for path in paths:
            self._delete(path)
            self.live.remove(path)

    def close(self) -> None:
        """Delete all tables of this call; nothing may be read from them afterwards."""
        self._delete(self.root)
        self.live = []

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` from a table of its own, which alone stays."""
        own = Scratch(self.spark, "result")
        out = own.cut(df)
        self.close()
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
