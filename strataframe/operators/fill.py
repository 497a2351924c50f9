"""Gap filling and connectivity: loops of joins to a fixed point, with lineage cut by a given function."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.graph import connected_components
from strataframe.operators.stencil import at_offset


def dense(field: DataFrame, grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every grid column at every key of the field; missing cells have a null value."""
    all_keys = field.select(*keys).distinct()
    return all_keys.join(grid.select("j", "i")).join(field.select(*keys, "j", "i", value), [*keys, "j", "i"], "left")


def extend_once(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Null cells take the mean of their valid horizontal neighbours."""
    own, sides = df, ("_w", "_e", "_s", "_n")
    for name, axis, other, d in (("_w", "i", "j", -1), ("_e", "i", "j", 1), ("_s", "j", "i", -1), ("_n", "j", "i", 1)):
        own = own.withColumn(name, at_offset(value, [*keys, other], axis, d))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sides), F.lit(0.0))
    n = sum((F.col(s).isNotNull().cast("int") for s in sides), F.lit(0))
    return own.withColumn(value, F.coalesce(value, F.when(n > 0, total / n))).drop(*sides)


def extend(df: DataFrame, keys: list[str], value: str, rounds: int, cut: Callable[[DataFrame], DataFrame], every: int = 3) -> DataFrame:
    """``rounds`` rounds of :func:`extend_once`, lineage cut now and then."""
    for k in range(rounds):
        df = extend_once(df, keys, value)
        if k % every == every - 1:
            df = cut(df)
    return df


def fill_all(df: DataFrame, keys: list[str], value: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rounds of :func:`extend_once` until no cell is null; raises if a round fills none while cells are left.

    A round looks only at the cells beside those that the round before has
    filled: a null cell's valid neighbours are all of that round, else it had
    been filled before. So the work follows the frontier, not the field.
    """
    key = [*keys, "j", "i"]
    last = df.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"))
    holes, filled = cut(df.where(F.col(value).isNull()).select(*key)), None
    sides = [("_w", 0, 1), ("_e", 0, -1), ("_s", 1, 0), ("_n", -1, 0)]  # what a cell is to the neighbour at (j + dj, i + di)
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("s"), F.lit(dj).alias("dj"), F.lit(di).alias("di")) for n, dj, di in sides]))
    left = holes.count()
    while left:
        near = last.withColumn("_o", steps).select(*keys, (F.col("j") + F.col("_o.dj")).alias("j"), (F.col("i") + F.col("_o.di")).alias("i"), F.col("_o.s").alias("_side"), "_v").join(holes, key)
        four = near.groupBy(*key).agg(*[F.max(F.when(F.col("_side") == n, F.col("_v"))).alias(n) for n, _, _ in sides])
        total = sum((F.coalesce(n, F.lit(0.0)) for n, _, _ in sides), F.lit(0.0))
        last = cut(four.select(*key, (total / sum((F.col(n).isNotNull().cast("int") for n, _, _ in sides), F.lit(0))).alias("_v")))
        got = last.count()
        if not got:
            raise ValueError(f"{left} cells cannot be reached from valid ones")
        filled = last if filled is None else filled.unionByName(last)
        holes, left = cut(holes.join(last.select(*key), key, "left_anti")), left - got
    return df if filled is None else df.join(filled, key, "left").withColumn(value, F.coalesce(value, "_v")).drop("_v")


def nearest_weighted(df: DataFrame, keys: list[str], value: str, k: int, radius: int | None, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Null cells take the inverse-distance mean of their k nearest valid cells (ties at the k-th distance all count).

    Cells meet in rings of index steps that widen for those not yet done, up to
    ``radius``; a cell without k valid ones in that circle stays null. Without a
    radius they widen to the whole plane, and where it has fewer than k valid
    cells all of them count; ``cut`` then writes what a ring leaves.
    """
    valid = df.where(F.col(value).isNotNull()).select(*keys, F.col("j").alias("_j"), F.col("i").alias("_i"), F.col(value).alias("_v"))
    holes, filled = df.where(F.col(value).isNull()).select(*keys, "j", "i"), None
    if radius is None:
        wide = df.agg(F.max("j") - F.min("j"), F.max("i") - F.min("i")).first()
        far = math.ceil(math.hypot(wide[0] or 0, wide[1] or 0)) + 1
    else:
        far = radius
    ring = min(far, 2)
    while True:  # most holes end in the first ring; k cells within a ring are the nearest of all
        steps = [(a, b) for a in range(-ring, ring + 1) for b in range(-ring, ring + 1) if 0 < a * a + b * b <= ring * ring]
        offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in steps])) if len(steps) < 500 else _circle(ring)
        near = holes.withColumn("_o", offsets).withColumns({"_j": F.col("j") + F.col("_o.dj"), "_i": F.col("i") + F.col("_o.di")})
        near = near.withColumn("_d", F.sqrt((F.col("_o.dj") ** 2 + F.col("_o.di") ** 2).cast("double"))).join(valid, [*keys, "_j", "_i"])
        near = near.withColumn("_r", F.rank().over(Window.partitionBy(*keys, "j", "i").orderBy("_d"))).where(F.col("_r") <= k)
        got = near.groupBy(*keys, "j", "i").agg((F.sum(F.col("_v") / F.col("_d")) / F.sum(1 / F.col("_d"))).alias("_fill"), F.count(F.lit(1)).alias("_n"))
        got = (got if radius is None and ring == far else got.where(F.col("_n") >= k)).drop("_n")
        got = cut(got) if cut else got
        filled = got if filled is None else filled.unionByName(got)
        if ring == far:
            break
        holes, ring = holes.join(got, [*keys, "j", "i"], "left_anti"), min(far, 2 * ring)
        if cut:
            holes = cut(holes)
            if radius is None and holes.isEmpty():
                break
    return df.join(filled, [*keys, "j", "i"], "left").withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def _circle(ring: int):
    """The steps of a wide circle, made on the executors."""
    side = F.sequence(F.lit(-ring), F.lit(ring))
    pairs = F.flatten(F.transform(side, lambda a: F.transform(side, lambda b: F.struct(a.alias("dj"), b.alias("di")))))
    return F.explode(F.filter(pairs, lambda p: (p["dj"] * p["dj"] + p["di"] * p["di"] <= ring * ring) & ((p["dj"] != 0) | (p["di"] != 0))))


def along(df: DataFrame, keys: list[str], value: str, axis: str) -> DataFrame:
    """Null values take the last valid one before them along an axis, else the first one after."""
    w = Window.partitionBy(*keys).orderBy(axis)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after))


def whole(df: DataFrame, value: str) -> DataFrame:
    """``df``, where a null value fails the job: nothing may be missing here."""
    return df.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit(f"{value} is missing"))).otherwise(F.col(value)))


def components(mask: DataFrame, n_i: int, cut: Callable[[DataFrame], DataFrame], axes: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """``mask`` (one row per wet cell) with ``component``: the least cell number of its connected cells.

    Cells are numbered row by row (``j * n_i + i``); neighbours share a face.
    """
    number = F.col("j").cast("long") * n_i + F.col("i")
    own = mask.select("j", "i").distinct().withColumn("node", number)
    right = own.select(F.col("j"), (F.col("i") - 1).alias("i"), F.col("node").alias("dst"))
    up = own.select((F.col("j") - 1).alias("j"), F.col("i"), F.col("node").alias("dst"))
    edges = own.join(right, list(axes)).select(F.col("node").alias("src"), "dst").union(own.join(up, list(axes)).select(F.col("node").alias("src"), "dst"))
    labels = connected_components(edges, cut)
    return own.join(labels, "node", "left").select("j", "i", F.coalesce("component", "node").alias("component"))


def connected_to(mask: DataFrame, seed: tuple[int, int], n_i: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cells connected to a seed (j, i)."""
    own = components(mask, n_i, cut)
    at = own.where((F.col("j") == seed[0]) & (F.col("i") == seed[1])).select(F.col("component").alias("_c"))
    return own.join(F.broadcast(at), F.col("component") == F.col("_c"), "left_semi").select("j", "i")
