"""Joins of runs, points, bins and observations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.constants import EARTH_RADIUS


def trim_and_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    """Value of ``b`` minus ``a`` at equal step numbers, cut to the shorter run; times are those of ``a``."""
    w = Window.partitionBy(*keys).orderBy(time)
    one = a.select(*keys, time, value, F.row_number().over(w).alias("step"))
    two = b.select(*keys, F.col(value).alias("_v"), F.row_number().over(w).alias("step"))
    return one.join(two, [*keys, "step"]).select(*keys, "step", time, (F.col("_v") - F.col(value)).alias("difference"))


def common_last(df: DataFrame, run: str, time: str = "t") -> DataFrame:
    """The rows of every run at the last step that all runs have."""
    w = Window.partitionBy(run).orderBy(time)
    own = df.withColumn("_step", F.row_number().over(w))
    least = own.groupBy(run).agg(F.max("_step").alias("_n")).agg(F.min("_n").alias("_least"))
    return own.join(F.broadcast(least), F.col("_step") == F.col("_least")).drop("_step", "_least")


LEAF = 32  # targets in a leaf of the tree


class _Plane:
    """Distances in degrees, longitudes not wrapped: of two points, and the least and greatest from a point to what a box holds."""

    def exact(self) -> Column:
        return F.hypot(F.col("lon") - F.col("_lon"), F.col("lat") - F.col("_lat"))

    def gaps(self) -> tuple[Column, Column, Column, Column]:
        lon, lat = F.col("lon"), F.col("lat")
        near = lambda c, lo, hi: F.greatest(F.col(lo) - c, c - F.col(hi), F.lit(0.0))
        far = lambda c, lo, hi: F.greatest(F.abs(F.col(lo) - c), F.abs(F.col(hi) - c))
        return near(lon, "_x0", "_x1"), near(lat, "_y0", "_y1"), far(lon, "_x0", "_x1"), far(lat, "_y0", "_y1")

    def bounds(self) -> tuple[Column, Column]:
        x, y, xx, yy = self.gaps()
        return F.hypot(x, y), F.hypot(xx, yy)


class _Flat(_Plane):
    """Metres, as the flat distance at the mean latitude has them."""

    def exact(self) -> Column:
        from strataframe.functions.expr import flat_distance

        return flat_distance("lon", "lat", "_lon", "_lat")

    def bounds(self) -> tuple[Column, Column]:
        x, y, xx, yy = self.gaps()
        ends = [F.cos(F.radians((F.col("lat") + F.col(c)) / 2)) for c in ("_y0", "_y1")]
        most = F.when((F.col("lat") + F.col("_y0") <= 0) & (F.col("lat") + F.col("_y1") >= 0), 1.0).otherwise(F.greatest(*ends))
        metres = lambda c, dx, dy: EARTH_RADIUS * F.hypot(c * F.radians(dx), F.radians(dy))
        return metres(F.least(*ends), x, y), metres(most, xx, yy)


def nearest_pairs(points: DataFrame, targets: DataFrame, metric: _Plane, cut: Callable[[DataFrame], DataFrame], leaf: int = LEAF) -> DataFrame:
    """Points beside the targets (``_lon``, ``_lat`` and more) among which their nearest ones are, all of the equally near.

    The targets' counts make a quadtree whose leaves hold ``leaf`` targets or
    so, whatever their density. All points go down it level by level: of the
    nodes a point has reached, those stay that are not farther than the
    farthest corner of another one. What a point meets in the end are a few
    leaves. Points and targets without coordinates meet nothing.
    """
    own = cut(targets.where("_lon IS NOT NULL AND _lat IS NOT NULL"))
    n, x0, x1, y0, y1 = own.agg(F.count("*"), F.min("_lon"), F.max("_lon"), F.min("_lat"), F.max("_lat")).first()
    some = points.where("lon IS NOT NULL AND lat IS NOT NULL")
    if not n:
        return some.join(own, F.lit(False))
    depth = min(20, max(0, math.ceil(math.log(max(1, n / leaf), 4))) + 3) if n > leaf else 0
    at = lambda c, low, size, level: F.least(F.floor((F.col(c) - low) / (size or 1.0) * 2**level), F.lit(2**level - 1)).cast("long")
    tile = lambda level: {"_tx": at("_lon", x0, x1 - x0, level), "_ty": at("_lat", y0, y1 - y0, level)}
    box = [F.count(F.lit(1)).alias("_n"), *[f(c).alias(k) for k, f, c in (("_x0", F.min, "_lon"), ("_x1", F.max, "_lon"), ("_y0", F.min, "_lat"), ("_y1", F.max, "_lat"))]]
    nodes = cut(own.withColumns(tile(depth)).groupBy("_tx", "_ty").agg(*box).withColumn("_level", F.lit(depth)))
    levels = {depth: nodes}
    for level in range(depth - 1, -1, -1):  # from the finest up: a level has a quarter of the nodes
        up = levels[level + 1].withColumns({"_tx": F.shiftright("_tx", 1), "_ty": F.shiftright("_ty", 1)}).groupBy("_tx", "_ty")
        levels[level] = cut(up.agg(F.sum("_n").alias("_n"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1")).withColumn("_level", F.lit(level)))
    node = ["_level", "_tx", "_ty", "_n"]
    keys, (low, high) = points.columns, metric.bounds()
    by_point = Window.partitionBy(*keys)
    front = some.distinct().crossJoin(F.broadcast(levels[0])).withColumn("_low", low).select(*keys, *node, "_low", F.lit(0.0).alias("_high"))  # one row
    for level in range(depth):
        open_ = front.where((F.col("_level") == level) & (F.col("_n") > leaf)).select(*keys, F.col("_tx").alias("_px"), F.col("_ty").alias("_py"))
        below = levels[level + 1].withColumns({"_px": F.shiftright("_tx", 1), "_py": F.shiftright("_ty", 1)})
        children = open_.join(below, ["_px", "_py"]).withColumns({"_low": low, "_high": high}).select(*keys, *node, "_low", "_high")
        both = front.where((F.col("_level") < level) | (F.col("_n") <= leaf)).unionByName(children)
        front = cut(both.withColumn("_least", F.min("_high").over(by_point)).where(F.col("_low") <= F.col("_least") * (1 + 1e-12)).drop("_least"))
    held = None
    for level in range(depth + 1):  # every target in its leaf
        leaves = levels[level].where(F.col("_n") <= leaf) if level < depth else levels[level]
        if level:
            parents = levels[level - 1].where(F.col("_n") > leaf).select(F.col("_tx").alias("_px"), F.col("_ty").alias("_py"))
            leaves = leaves.withColumns({"_px": F.shiftright("_tx", 1), "_py": F.shiftright("_ty", 1)}).join(parents, ["_px", "_py"], "left_semi")
        part = own.withColumns(tile(level)).join(leaves.select("_tx", "_ty"), ["_tx", "_ty"], "left_semi").withColumn("_level", F.lit(level))
        held = part if held is None else held.unionByName(part)
    return front.select(*keys, "_level", "_tx", "_ty").join(held, ["_level", "_tx", "_ty"]).drop("_level", "_tx", "_ty")


def nearest_cell(points: DataFrame, grid: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(points, j, i): the nearest grid column in degrees, of equals the one with the least (j, i)."""
    g, metric = grid.select("j", "i", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), _Plane()
    own = points.toDF(*[f"_own_{c}" if c in ("j", "i") else c for c in points.columns])
    best = F.min_by(F.struct("j", "i"), F.struct(metric.exact().alias("d"), "j", "i"))
    out = nearest_pairs(own, g, metric, cut).groupBy(*own.columns).agg(best.alias("_best"))
    return out.select(*[F.col(c).alias(n) for c, n in zip(own.columns, points.columns, strict=True) if n not in ("j", "i")], F.col("_best.j").alias("j"), F.col("_best.i").alias("i"))


def nearest_value(points: DataFrame, scattered: DataFrame, value: str, ident: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(points, value): that of the nearest scattered point in degrees, of equals the one with the least ``ident``."""
    own, metric = scattered.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col(value).alias("_v"), F.col(ident).alias("_n_of")), _Plane()
    dx, dy = F.col("lon") - F.col("_lon"), F.col("lat") - F.col("_lat")
    best = F.min_by("_v", F.struct((dx * dx + dy * dy).alias("d"), "_n_of"))
    return nearest_pairs(points, own, metric, cut).groupBy(*points.columns).agg(best.alias(value))


def distance_to_set(points: DataFrame, targets: DataFrame, keys: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, distance): kilometres to the nearest of the targets, as the flat distance has it (longitudes do not wrap)."""
    own, metric = points.select(*keys, "lon", "lat").distinct(), _Flat()
    t = targets.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    return nearest_pairs(own, t, metric, cut).groupBy(*keys).agg((F.min(metric.exact()) / 1000).alias("distance"))


def level_of(df: DataFrame, levels: DataFrame, depth: str, edge: str = "top") -> DataFrame:
    """``df`` with the level k that contains ``depth`` (negative down); a shared edge belongs to the level it is the ``top`` or ``bottom`` of."""
    z = F.col(depth)
    inside = (z <= F.col("z_top")) & (z > F.col("z_bot")) if edge == "top" else (z < F.col("z_top")) & (z >= F.col("z_bot"))
    return df.join(levels.select("k", "z_top", "z_bot"), inside, "left").drop("z_top", "z_bot")


def against_observations(model: DataFrame, casts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, model, observed, bias): means of both sides by equal keys."""
    m = model.groupBy(*keys).agg(F.avg(value).alias("model"))
    o = casts.groupBy(*keys).agg(F.avg(value).alias("observed"))
    return m.join(o, keys).withColumn("bias", F.col("model") - F.col("observed"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Members that both experiments have, with both values."""
    return a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys)
