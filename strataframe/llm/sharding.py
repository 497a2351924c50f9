"""Sharding by jump consistent hashing (Lamping and Veach 2014), with DataFrame functions only.

The keyed generator is Spark's xxhash64 of (key, jump number); without a ring
table, appending one shard moves only the rows that go into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.cluster import Scratch
from strataframe.llm.ordering import bucket, bucket_bits, bucket_offsets, order_key
from strataframe.llm.rowwise import fresh


USUAL_JUMPS = 8


def jumps(key: Column, shards: int) -> Column:
    """(at, next): the last jump before ``shards`` and the one that passes it. A null key is a key of its own.

    The number of jumps grows with the logarithm of the shards. Most keys end
    within ``USUAL_JUMPS``; only the others go on, each jump going at least one
    shard on.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(acc, i):
        unit = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1) / F.lit(float(1 << 31))
        nxt = F.floor((acc["next"] + 1) / unit).cast("long")
        return F.when(acc["next"] < shards, F.struct(acc["next"].alias("at"), nxt.alias("next"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, USUAL_JUMPS))), start, step)
    if shards <= USUAL_JUMPS:
        return usual
    rest = lambda acc: F.aggregate(F.sequence(F.lit(USUAL_JUMPS + 1), F.lit(shards)), acc, step)
    ended = lambda acc: F.when(acc["next"] >= shards, acc).otherwise(rest(acc))
    return F.get(F.transform(F.array(usual), ended), 0)  # the fold is written once


def jump(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a key."""
    return jumps(key, shards)["at"].cast("int")


def grown(state: Column, shards: int) -> Column:
    """The shard of the same key with one shard more: a jump that lands on the new shard goes into it."""
    return F.when(state["next"] == shards, F.lit(shards)).otherwise(state["at"]).cast("int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. ``shard`` depends on
    the id and the number of shards only; ``grown_shard`` is the one with one
    shard more. ``slot`` numbers a shard's rows from 0 without gaps, in a seeded
    order of ids and text checksums found by two-level counts, so rows of one id
    are dealt to many tasks unless they are equal. A null text has the checksum of no bytes. Columns of
    ``docs`` with the new names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    bits = bucket_bits(docs.count() // shards)
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    size, crc, state, at, order, part, ahead, inside, own, own_part = fresh(docs, "size", "crc", "state", "at", "order", "part", "ahead", "inside", "own", "own_part")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        (F.octet_length(text) + 8).cast("long").alias(size), F.crc32(text.cast("binary")).alias(crc), jumps(key, shards).alias(state), order_key(seed, key, F.crc32(text.cast("binary"))).alias(order),
    ).withColumn(part, bucket(order, bits)).withColumn(at, F.col(state)["at"].cast("int"))
    totals = rows.groupBy(F.col(at).alias("shard"), F.col(part).alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    offsets = scratch.cut(bucket_offsets(totals, ["shard"], "n").select(F.col("shard").alias(own), F.col("_bucket").alias(own_part), F.col("_offset").alias(ahead)))
    place = F.row_number().over(Window.partitionBy(at, part).orderBy(order, key, crc, size))
    numbered = rows.withColumn(inside, place).join(offsets, (F.col(at) == F.col(own)) & (F.col(part) == F.col(own_part)))
    return numbered.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in new],
        F.col(size).alias("size"), F.col(crc).cast("long").alias("text_crc32"), F.lit("key").alias("law"), F.col(at).alias("shard"),
        (F.col(ahead) + F.col(inside) - 1).cast("long").alias("slot"), grown(F.col(state), shards).alias("grown_shard"),
    )
