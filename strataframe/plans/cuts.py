"""How queries cut lineage in loops: a table in the shared folder, as a reliable checkpoint."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, of the session or the context; without one, only a single machine may use its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cutter(spark: SparkSession):
    root = f"{shared_dir(spark)}/loops/{uuid.uuid4().hex}"
    count = iter(range(1_000_000))

    def cut(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(count)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut
