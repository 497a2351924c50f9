"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Only DataFrame functions. The level is found by re-sharing the excess of capped
sources until none is above its cap; every round is one distributed aggregate
that returns one row. Fractional repetitions are taken in a seeded order, cut
by two-level running sums, so a hot source never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.cluster import Scratch
from strataframe.llm.ordering import bucket, bucket_bits, bucket_offsets, order_key
from strataframe.llm.rowwise import fresh

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` with ``weight``: the given ones repeating over ``source`` by code point, null last.

    Ranks come from a range partitioning plus partition offsets (one small row
    per partition), so any number of sources is fine.
    """
    ranged = scratch.cut(
        sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id())
    )
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    rank = F.pmod(F.col("_ahead") + inside - 1, F.lit(len(weights)))
    return (
        ranged.join(offsets, "_part").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")))
        .drop("_part", "_ahead")
    )


def fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """(source, weight, source_size) with ``target``: min(weight * level, max_epochs * size), summing to all sizes."""
    cap, level = max_epochs * F.col("source_size"), 0.0
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped_before = -1
    while True:  # ends: the capped set only grows
        over = F.col("weight") * F.lit(level) > cap
        held, free, n = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over)
        ).first()
        if n == capped_before or not free:
            break
        capped_before, level = n, (total - held) / free
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def mix(docs: DataFrame, size: str | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 17,
        source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words of the document in the mix).

    Every document is taken ``floor(target / source_size)`` whole times; the
    fraction that remains goes to the first documents of its source in a seeded
    order, the last of them in part, so a source's taken words equal its rounded
    target. Null sources are one source, null texts have no words, equal rows
    are rows of their own, an empty table gives an empty one. ``size`` may name
    a column to use as the size. Columns of ``docs`` with the new names are
    replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    bits = bucket_bits(docs.count())
    measured = F.col(size).cast("long") if size else n_words(text_col)
    new = {"size", "source_size", "target", "taken"}
    src, order, part, own, edge, left, whole = fresh(docs, "source", "order", "part", "own", "edge", "left", "whole")
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], measured.alias("size"), F.col(source_col).cast("string").alias(src), order_key(seed, F.col(id_col)).alias(order)
    ).withColumn(part, bucket(order, bits))
    totals = scratch.cut(rows.groupBy(F.col(src).alias("source"), F.col(part).alias("_bucket")).agg(F.sum("size").alias("bucket_size")))
    sources = totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    filled = scratch.cut(fill(scratch.cut(cycle_weights(sources, scratch, weights)), max_epochs))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.round("target").cast("long") - F.col("times") * F.col("source_size"), F.lit(0))
    filled = filled.withColumn("times", F.least(times, F.lit(int(max_epochs)))).withColumn("rest", rest)
    cut = (
        bucket_offsets(totals, ["source"], "bucket_size").join(filled.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("_offset") < F.col("rest")) & (F.col("rest") <= F.col("_offset") + F.col("bucket_size")))
        .select("s", F.col("_bucket").alias("cut"), (F.col("rest") - F.col("_offset")).alias("remains"))
    )
    plan = filled.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias(own), "source_size", "target", F.col("times").alias(whole), F.coalesce("cut", F.lit(-1)).alias(edge), F.coalesce("remains", F.lit(0)).alias(left)
    )
    dealt = rows.join(scratch.cut(plan), F.col(src).eqNullSafe(F.col(own)))
    sure = dealt.where(F.col(part) != F.col(edge)).withColumn("taken", F.col(whole) * F.col("size") + F.when(F.col(part) < F.col(edge), F.col("size")).otherwise(0))
    crc = F.crc32(F.col(text_col).cast("string")) if text_col in docs.columns else F.lit(0)
    before = Window.partitionBy(src, part).orderBy(order, F.col(id_col), "size", crc)
    ahead = F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = dealt.where(F.col(part) == F.col(edge)).withColumn(
        "taken", F.col(whole) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col(left) - ahead))
    )
    out = sure.unionByName(split)
    return out.select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def materialise(mixed: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mix as rows: each document as often as it is taken whole, and once more cut after its last words taken.

    A part keeps the first words with the white space before them. Documents
    that are not taken give no row; those without words are kept once.
    """
    (take,) = fresh(mixed, "take")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("long")
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col(take).cast("int")), "")
    text = F.when(F.col(take) < 0, F.col(text_col)).otherwise(head)
    return mixed.withColumn(take, F.explode(times)).withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in columns])
