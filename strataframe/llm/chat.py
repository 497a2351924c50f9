"""Chat formatting: cumulative snapshots of logged conversations collapse to the maximal ones, which are rendered.

Logs often hold every state of a conversation. A conversation that is a prefix
of a longer one is found by rolling turn-prefix hashes: the hash of the first p
turns is the running XOR of hashes of (position, role, text). An anti-join
against all proper prefixes keeps the maximal ones. Equal conversations and
equal prefixes are aggregated before they are shuffled, so a conversation or a
first turn that a third of the logs share is one row in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turns(conv: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conv.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("pos", F.row_number().over(order))
    part = [F.xxhash64(F.lit(s), "pos", "role", "text") for s in (11, 29)]
    return rows.withColumn("a", part[0]).withColumn("b", part[1])


def maximal(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies): one row per distinct conversation that is no proper prefix of another.

    ``conv`` is the smallest id of its copies (null, the id of rows without
    one, counts as larger than all), ``n_copies`` how many ids have it.
    """
    return _maximal(_turns(conv, id_col, turn_col, role_col, text_col))


def _maximal(turns: DataFrame) -> DataFrame:
    running = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.select(
        "conv", "pos", F.expr("bit_xor(a)").over(running).alias("a"), F.expr("bit_xor(b)").over(running).alias("b"),
        F.lead("pos").over(Window.partitionBy("conv").orderBy("pos")).isNull().alias("last"),
    )
    whole = (
        rolled.where("last").groupBy(F.col("pos").alias("n_turns"), "a", "b")
        .agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    )
    prefixes = rolled.where(~F.col("last")).select(F.col("pos").alias("n_turns"), "a", "b").distinct()
    return whole.join(prefixes, ["n_turns", "a", "b"], "left_anti").select("conv", F.col("n_turns").cast("long"), "n_copies")


def control_free(text: Column) -> Column:
    """Text that cannot be read as a control token of the template."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def render(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_copies, rendered) of every maximal conversation, as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.

    Turns stand in order of (turn, role, text), null turns last; equal rows are
    turns of their own. Null roles are ``unknown``, null texts empty. A
    conversation becomes one row, so it must fit into one.
    """
    turns = _turns(conv, id_col, turn_col, role_col, text_col)
    keep = _maximal(turns)
    line = F.concat(F.lit("<|im_start|>"), control_free(F.col("role")), F.lit("\n"), control_free(F.col("text")), F.lit("<|im_end|>\n"))
    chosen = turns.select(F.col("conv").alias("c"), "pos", line.alias("line")).join(keep, F.col("c").eqNullSafe(F.col("conv")))
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return (
        chosen.groupBy("conv", "n_turns", "n_copies").agg(F.concat_ws("", F.transform(lines, lambda x: x["line"])).alias("rendered"))
        .withColumnRenamed("conv", id_col)
    )
