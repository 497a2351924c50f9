"""Running totals inside groups of any size, in two levels.

A window over a whole group would put a hot group into one task. Rows are
dealt to buckets by the high bits of their order key instead: bucket totals
are a small aggregate, offsets are running sums of those, and only rows of one
(group, bucket) meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60


def order_key(seed: int, *cols: Column) -> Column:
    """A seeded 60-bit number from the columns' strings; null counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def bucket_bits(rows: int, per_bucket: int = 4000) -> int:
    """Bits so that a group of all rows has about ``per_bucket`` rows in a bucket."""
    return max(4, min(24, (max(1, rows) // per_bucket).bit_length()))


def bucket(key: str | Column, bits: int) -> Column:
    return F.shiftright(F.col(key) if isinstance(key, str) else key, KEY_BITS - bits).cast("int")


def bucket_offsets(totals: DataFrame, group: list[str], value: str) -> DataFrame:
    """``totals`` (one row per group and ``_bucket``) with ``_offset``, the sum of ``value`` over earlier buckets."""
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_offset", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
