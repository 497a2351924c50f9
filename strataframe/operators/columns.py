"""Depth-column operators: each groups or windows by the horizontal key and orders by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.constants import GRAVITY


def end_level(df: DataFrame, keys: list[str], value: str, level: str = "k", which: str = "top") -> DataFrame:
    """The value at the first (``top``) or last (``bottom``) level where it is not null."""
    pick = F.min_by if which == "top" else F.max_by
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(pick(value, level).alias(value))


def depth_of_max(df: DataFrame, keys: list[str], value: str, z: str = "z", level: str = "k") -> DataFrame:
    """Depth of the column maximum, the shallowest of equals."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(z, F.struct((-F.col(value)).alias("v"), F.col(level))).alias("depth"))


def isoline_depth(df: DataFrame, keys: list[str], value: str, at: float, below: float = 0.0, z: str = "z", level: str = "k", null_if_colder: bool = False) -> DataFrame:
    """Depth at which the value first crosses ``at`` below ``below``, by linear interpolation.

    A column that stays lower gives its deepest z (null with ``null_if_colder``),
    one that stays higher gives null, as does one that ends above ``below``.
    """
    w = Window.partitionBy(*keys).orderBy(level)
    own = df.where(F.col(value).isNotNull())
    own = own.withColumn("_v", F.lead(value).over(w)).withColumn("_z", F.lead(z).over(w))
    v, nxt = F.col(value), F.col("_v")
    crosses = (F.col(z) <= below) & (((v < at) & (nxt >= at)) | ((v >= at) & (nxt < at)))
    depth = (F.col(z) - F.col("_z")) / (v - nxt) * (at - v) + F.col(z)
    low = F.col(z) <= below
    out = own.groupBy(*keys).agg(
        F.min_by(F.when(crosses, depth), F.when(crosses, F.col(level))).alias("_cross"), F.min(z).alias("_floor"),
        F.max(F.when(low, v)).alias("_max"), F.min(F.when(low, v)).alias("_min"),
    )
    depth = F.when(F.col("_floor") > below, None).when(F.col("_max") < at, None if null_if_colder else F.col("_floor")).when(F.col("_min") > at, None).otherwise(F.col("_cross"))
    return out.select(*keys, depth.cast("double").alias("depth"))


def at_depth(df: DataFrame, levels: DataFrame, keys: list[str], value: str, z0: float, level: str = "k") -> DataFrame:
    """The value interpolated to ``z0`` between the two levels around it (the nearest one beyond the ends)."""
    above = levels.where(F.col("z") >= z0).agg(F.max_by(F.struct(F.col(level).alias("k"), "z"), -F.col("z")).alias("a"))
    under = levels.where(F.col("z") <= z0).agg(F.max_by(F.struct(F.col(level).alias("k"), "z"), F.col("z")).alias("b"))
    both = above.join(under).select(  # one row each
        F.coalesce("a.k", "b.k").alias("_ka"), F.coalesce("b.k", "a.k").alias("_kb"),
        F.when(F.col("a.z").isNull() | F.col("b.z").isNull() | (F.col("a.z") == F.col("b.z")), 1.0)
        .otherwise((F.lit(z0) - F.col("b.z")) / (F.col("a.z") - F.col("b.z"))).alias("_wa"),
    )
    own = df.where(F.col(value).isNotNull()).join(F.broadcast(both), (F.col(level) == F.col("_ka")) | (F.col(level) == F.col("_kb")))
    w = F.when(F.col(level) == F.col("_ka"), F.col("_wa")).otherwise(0.0) + F.when((F.col(level) == F.col("_kb")) & (F.col("_ka") != F.col("_kb")), 1 - F.col("_wa")).otherwise(0.0)
    n = F.when(F.first("_ka") == F.first("_kb"), 1).otherwise(2)
    out = own.groupBy(*keys).agg(F.sum(F.col(value) * w).alias("_s"), F.count(F.lit(1)).alias("_n"), n.alias("_need"))
    return out.where(F.col("_n") == F.col("_need")).select(*keys, F.col("_s").alias(value))


def thermocline(df: DataFrame, keys: list[str], value: str, z: str = "z", level: str = "k") -> DataFrame:
    """Depth of the steepest increase downwards; the top level has no gradient."""
    w = Window.partitionBy(*keys).orderBy(level)
    own = df.where(F.col(value).isNotNull()).withColumn("_g", (F.col(value) - F.lag(value).over(w)) / F.abs(F.col(z) - F.lag(z).over(w)))
    return depth_of_max(own.where("_g IS NOT NULL"), keys, "_g", z, level)


def refine(df: DataFrame, keys: list[str], value: str, step: float, z: str = "z", level: str = "k") -> DataFrame:
    """(keys, depth, value) every ``step`` metres between neighbouring levels; nothing beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(level)
    own = df.where(F.col(value).isNotNull()).withColumn("_v", F.lead(value).over(w)).withColumn("_z", F.lead(z).over(w)).withColumn("_last", F.lead(level, 2).over(w).isNull())
    own = own.where("_v IS NOT NULL")
    first, last = F.ceil(-F.col(z) / step), F.when(F.col("_last"), F.floor(-F.col("_z") / step)).otherwise(F.ceil(-F.col("_z") / step) - 1)
    out = own.where(last >= first).withColumn("_n", F.explode(F.sequence(first, last))).withColumn("depth", F.col("_n") * F.lit(float(step)))
    return out.select(*keys, "depth", (F.col(value) + (F.col("_v") - F.col(value)) * (-F.col("depth") - F.col(z)) / (F.col("_z") - F.col(z))).alias(value))


def winter_water_core(df: DataFrame, keys: list[str], temp: str, depth: str, share: float = 2 / 3) -> DataFrame:
    """(keys, core_depth, core_temp): the coldest point in the upper part of the column, the shallowest of equals."""
    deepest = F.max(depth).over(Window.partitionBy(*keys))
    own = df.where(F.col(temp).isNotNull()).withColumn("_d", deepest).where(F.col(depth) <= F.col("_d") * share)
    best = F.min_by(F.struct(depth, temp), F.struct(temp, depth))
    return own.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{depth}").alias("core_depth"), F.col(f"_b.{temp}").alias("core_temp"))


def thermocline_base(df: DataFrame, keys: list[str], temp: str, depth: str, threshold: float, share: float = 0.8) -> DataFrame:
    """The deepest gradient above a threshold below the cold core and above ``share`` of the column.

    The threshold is halved until some gradient exceeds it, in closed form; a
    column without positive gradient there gives null.
    """
    w = Window.partitionBy(*keys).orderBy(depth)
    core = winter_water_core(df, keys, temp, depth)
    own = df.where(F.col(temp).isNotNull()).withColumn("_g", (F.col(temp) - F.lag(temp).over(w)) / (F.col(depth) - F.lag(depth).over(w)))
    own = own.withColumn("_d", F.max(depth).over(Window.partitionBy(*keys))).join(core, keys)
    own = own.where((F.col(depth) > F.col("core_depth")) & (F.col(depth) < F.col("_d") * share) & F.col("_g").isNotNull())
    own = own.withColumn("_top", F.max("_g").over(Window.partitionBy(*keys)))
    halvings = F.greatest(F.lit(0), F.floor(F.log2(threshold / F.col("_top"))) + 1)
    return own.groupBy(*keys).agg(F.max(F.when((F.col("_top") > 0) & (F.col("_g") > threshold / F.pow(F.lit(2.0), halvings)), F.col(depth))).alias("base_depth"))


def baroclinic(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``df`` with ``value`` minus its column mean, in ``baroclinic``."""
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).over(w)
    return df.withColumn("baroclinic", F.col(value) - mean)


def mixed_layer(df: DataFrame, keys: list[str], density: str, excess: float = 0.1, z: str = "z", level: str = "k") -> DataFrame:
    """Depth of the deepest level above which density stays below surface + ``excess``."""
    w = Window.partitionBy(*keys).orderBy(level)
    own = df.where(F.col(density).isNotNull()).withColumn("_d", F.col(density) < F.first(density).over(w) + excess)
    own = own.withColumn("_all", F.min("_d").over(w))
    return own.where("_all").groupBy(*keys).agg(F.max_by(z, level).alias("depth"))


def load_anomaly(df: DataFrame, keys: list[str], density: str, dz: str, rho0: float, level: str = "k") -> DataFrame:
    """``df`` with ``load``: the running integral of (density - rho0) g dz down the column."""
    w = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("load", F.sum((F.col(density) - rho0) * GRAVITY * F.col(dz)).over(w))


def spread_flux(flux: DataFrame, levels: DataFrame, value: str, depth: float = 300.0) -> DataFrame:
    """``flux`` shared over the levels down to ``depth`` by the thickness inside it; ``value`` sums to what it was."""
    inside = F.greatest(F.lit(0.0), F.least(F.col("z_top"), F.lit(0.0)) - F.greatest(F.col("z_bot"), F.lit(-depth)))
    part = levels.withColumn("_in", inside).where("_in > 0")
    total = part.agg(F.sum("_in").alias("_total"))
    share = part.join(F.broadcast(total)).select("k", (F.col("_in") / F.col("_total")).alias("_share"))
    return flux.join(share).select(*[c for c in flux.columns if c != value], "k", (F.col(value) * F.col("_share")).alias(value))


def fill_downwards(df: DataFrame, keys: list[str], value: str, level: str = "k") -> DataFrame:
    """As-of along depth: null values take the last one above."""
    w = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


