"""Regridding by weight tables: weights are built once from axes, applied by join and weighted sum."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(targets: DataFrame, axis: DataFrame, target: str, coord: str, index: str, period: float | None = None) -> DataFrame:
    """(targets, index, w): one or two axis points around each target; an exact hit has weight 1.

    ``axis`` (index, coord) is a dimension table. With ``period`` the axis
    wraps; without, targets outside get no row. Segments of the axis and
    targets meet by equal bins of the axis, as many as it has points.
    """
    pts = axis.select(F.col(index).cast("int").alias("_i"), F.col(coord).cast("double").alias("_c"))
    w = Window.orderBy("_c")  # an axis is small: one row per index
    seg = pts.withColumn("_i2", F.lead("_i").over(w)).withColumn("_c2", F.lead("_c").over(w))
    ends = pts.agg(F.min_by("_i", "_c").alias("_fi"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.count(F.lit(1)).alias("_n"))  # one row
    far = F.lit(float(period)) if period is not None else F.col("_hi") - F.col("_lo")
    ends = F.broadcast(ends.withColumn("_bin", F.greatest(far / F.col("_n"), F.lit(1e-12))))
    bin_of = lambda c: F.floor((c - F.col("_lo")) / F.col("_bin"))
    if period is not None:
        seg = seg.join(ends.select("_fi", "_lo")).withColumn("_i2", F.coalesce("_i2", "_fi")).withColumn("_c2", F.coalesce("_c2", F.col("_lo") + period)).drop("_fi", "_lo")
    seg = seg.withColumn("_hit", F.lit(False)).unionByName(pts.select("_i", "_c", F.col("_i").alias("_i2"), F.col("_c").alias("_c2"), F.lit(True).alias("_hit")))
    seg = seg.where("_c2 IS NOT NULL").join(ends.select("_lo", "_bin")).withColumn("_at", F.explode(F.sequence(bin_of(F.col("_c")), bin_of(F.col("_c2"))))).drop("_lo", "_bin")
    x = F.col(target).cast("double")
    if period is not None:
        x = F.col("_lo") + F.pmod(x - F.col("_lo"), F.lit(float(period)))
    keep = targets.columns
    own = targets.join(ends.select("_lo", "_bin")).withColumn("_x", x).withColumn("_at", bin_of(F.col("_x")))
    inside = (F.col("_hit") & (F.col("_x") == F.col("_c"))) | (~F.col("_hit") & (F.col("_x") > F.col("_c")) & (F.col("_x") < F.col("_c2")))
    hit = own.join(seg, "_at").where(inside)
    right = (F.col("_x") - F.col("_c")) / (F.col("_c2") - F.col("_c"))
    pair = F.when(F.col("_hit"), F.array(F.struct(F.col("_i").alias("i"), F.lit(1.0).alias("w")))).otherwise(
        F.array(F.struct(F.col("_i").alias("i"), (1 - right).alias("w")), F.struct(F.col("_i2").alias("i"), right.alias("w")))
    )
    return hit.select(*keep, F.explode(pair).alias("_p")).select(*keep, F.col("_p.i").alias(index), F.col("_p.w").alias("w"))


def bilinear_weights(targets: DataFrame, grid: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat", period: float | None = None) -> DataFrame:
    """(keys, j, i, w) for targets on a regular grid with columns j, i, lon, lat; one axis after the other, so that no target is joined with itself."""
    along = bracket(targets.select(*keys, lon, lat), grid.select("i", F.col("lon").alias("_g")).distinct(), lon, "_g", "i", period).withColumnRenamed("w", "_wi")
    both = bracket(along, grid.select("j", F.col("lat").alias("_g")).distinct(), lat, "_g", "j")
    return both.select(*keys, "j", "i", (F.col("_wi") * F.col("w")).alias("w"))


def gather(field: DataFrame, weights: DataFrame, target: list[str], source: list[str], values: list[str], over: list[str]) -> DataFrame:
    """(over, target, _w, _hit): the weights of a target, and the rows of the field at its sources as structs (_n, values), ``_n`` being the place in ``_w``.

    Weights are grouped by target before they meet the field, and the field is
    gathered once for each set of sources, however many targets share it. So
    the join makes the rows of the result and none of them are aggregated;
    :func:`sums` works inside a row. The sources of one target must fit into a
    row, and so must the field's rows there at one key of ``over``.
    """
    known = functools.reduce(lambda a, c: a & F.col(c).isNotNull(), target, F.col("w") > 0)
    own = weights.where(known).groupBy(*target).agg(F.array_sort(F.collect_list(F.struct(*source, "w"))).alias("_s"))
    own = own.select(*target, F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in source])).alias("_at"), F.transform("_s", lambda s: s["w"]).alias("_w"))
    at = own.select("_at").distinct().select("_at", F.posexplode("_at").alias("_n", "_c")).select("_at", "_n", "_c.*")
    there = at.join(field.select(*over, *source, *values), source).groupBy("_at", *over).agg(F.array_sort(F.collect_list(F.struct("_n", *values))).alias("_hit"))
    return own.join(there, "_at").select(*over, *target, "_w", "_hit")


def sums(gathered: DataFrame, keep: list[str | Column], terms: dict[str, Callable[[Column, Column], Column]], kind: str = "double") -> DataFrame:
    """``keep`` and the sums of ``term(hit, its weight)`` over the hits of :func:`gather`; like SQL's they skip nulls and are null without others.

    ``inline`` keeps later filters from computing the sums again.
    """

    def add(a: Column, h: Column) -> Column:
        w = F.get("_w", h["_n"])
        one = {name: term(h, w).cast(kind) for name, term in terms.items()}
        return F.struct(*[F.coalesce((a[name] + x).cast(kind), a[name], x).alias(name) for name, x in one.items()])

    start = F.struct(*[F.lit(None).cast(kind).alias(name) for name in terms])
    return gathered.select(*keep, F.inline(F.array(F.aggregate("_hit", start, add))))


def apply_weights(field: DataFrame, weights: DataFrame, target: list[str], source: list[str], values: list[str], over: list[str], whole: bool = True) -> DataFrame:
    """Weighted sums by (over, target). ``whole``: null unless all sources with weight are there; else a mean of those that are."""
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w).alias("_all")
    terms = {}
    for v in values:
        terms |= {v: lambda h, w, v=v: h[v] * w, f"_w_{v}": lambda h, w, v=v: F.when(h[v].isNotNull(), w)}
    hit = sums(gather(field, weights, target, source, values, over), [*over, *target, total], terms)
    return hit.select(*over, *target, *[(F.when(F.abs(F.col(f"_w_{v}") - F.col("_all")) < 1e-9, F.col(v)) if whole else F.col(v) / F.col(f"_w_{v}")).alias(v) for v in values])


def coarsen(field: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """Fine cells averaged into coarse ones of ``size`` x ``size``."""
    return field.groupBy(*keys, F.floor(F.col("j") / size).cast("int").alias("cj"), F.floor(F.col("i") / size).cast("int").alias("ci")).agg(F.avg(value).alias(value))


def sub_points(grid: DataFrame, n: int, width: float, height: float) -> DataFrame:
    """``grid`` with n x n evenly spread points (``sub``, ``lon``, ``lat``) for each column, for averages inside cells.

    Sampled bilinearly afterwards; a spline surface would differ.
    """
    at = [(a * n + b, (a + 0.5) / n - 0.5, (b + 0.5) / n - 0.5) for a in range(n) for b in range(n)]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in at]))
    own = grid.withColumn("_s", steps).withColumn("sub", F.col("_s.n"))
    return own.withColumn("lon", F.col("lon") + F.col("_s.x") * width).withColumn("lat", F.col("lat") + F.col("_s.y") * height).drop("_s")


def crossing_weights(grid: DataFrame, keys: list[str], axis: str, coord: str, at: float) -> DataFrame:
    """(keys, axis, w): in every line of a curvilinear grid the two neighbours between which ``coord`` passes ``at``.

    Of several crossings the first counts; an exact hit has weight 1, a line that never crosses gives no row.
    """
    w = Window.partitionBy(*keys).orderBy(axis)
    own = grid.select(*keys, F.col(axis).alias("_a"), F.col(coord).alias("_c"), F.lead(axis).over(w).alias("_b"), F.lead(coord).over(w).alias("_d"))
    over = ((F.col("_c") <= at) & (F.col("_d") > at)) | ((F.col("_c") >= at) & (F.col("_d") < at)) | (F.col("_d").isNull() & (F.col("_c") == at))
    first = own.where(over).groupBy(*keys).agg(F.min_by(F.struct("_a", "_b", "_c", "_d"), "_a").alias("_x"))
    right = F.coalesce((at - F.col("_x._c")) / (F.col("_x._d") - F.col("_x._c")), F.lit(0.0))
    pair = F.array(F.struct(F.col("_x._a").alias("a"), (1 - right).alias("w")), F.struct(F.col("_x._b").alias("a"), right.alias("w")))
    return first.select(*keys, F.explode(pair).alias("_p")).select(*keys, F.col("_p.a").alias(axis), F.col("_p.w").alias("w")).where("w > 0")


def point_open_fraction(weights: DataFrame, hfac: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hfac): bilinear open fraction, 0 where a corner is dry."""
    own = weights.where("w > 0").join(hfac.select("j", "i", "hfac"), ["j", "i"], "left")
    dry = F.max((F.coalesce("hfac", F.lit(0.0)) <= 0).cast("int")) == 1
    return own.groupBy(*keys).agg(F.when(dry, 0.0).otherwise(F.sum(F.col("hfac") * F.col("w"))).alias("hfac"))


def in_triangles(points: DataFrame, triangles: DataFrame, keys: list[str], tile: float) -> DataFrame:
    """(keys, triangle, w1, w2, w3): barycentric weights of points in mesh triangles (of several the least number).

    ``triangles``: triangle, x1, y1, x2, y2, x3, y3. Points and bounding boxes
    meet by tiles, so this is an equi-join with an exact residual test.
    """
    at = lambda c: F.floor(c / tile).cast("int")
    xs, ys = [F.col(f"x{k}") for k in (1, 2, 3)], [F.col(f"y{k}") for k in (1, 2, 3)]
    boxed = triangles.withColumn("_tx", F.explode(F.sequence(at(F.least(*xs)), at(F.greatest(*xs))))).withColumn("_ty", F.explode(F.sequence(at(F.least(*ys)), at(F.greatest(*ys)))))
    own = points.withColumn("_tx", at(F.col("x"))).withColumn("_ty", at(F.col("y"))).join(boxed, ["_tx", "_ty"])
    det = (F.col("y2") - F.col("y3")) * (F.col("x1") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y1") - F.col("y3"))
    w1 = ((F.col("y2") - F.col("y3")) * (F.col("x") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y") - F.col("y3"))) / det
    w2 = ((F.col("y3") - F.col("y1")) * (F.col("x") - F.col("x3")) + (F.col("x1") - F.col("x3")) * (F.col("y") - F.col("y3"))) / det
    hit = own.where(det != 0).withColumn("w1", w1).withColumn("w2", w2).withColumn("w3", 1 - F.col("w1") - F.col("w2"))
    hit = hit.where((F.col("w1") >= -1e-12) & (F.col("w2") >= -1e-12) & (F.col("w3") >= -1e-12))
    best = F.min_by(F.struct("triangle", "w1", "w2", "w3"), "triangle")
    return hit.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.triangle", "_b.w1", "_b.w2", "_b.w3")


def transect(grid: DataFrame, start: tuple[float, float], end: tuple[float, float], width: float, height: float) -> DataFrame:
    """(j, i, enter, leave, n): the cells that a segment crosses, with distances (in degrees) along it, numbered in order.

    Entry and exit come from clipping the segment at the four edges of each
    cell; a cell that is only touched is not crossed.
    """
    (x0, y0), (x1, y1) = start, end
    dx, dy = x1 - x0, y1 - y0
    length = (dx * dx + dy * dy) ** 0.5
    if length == 0:
        raise ValueError("the ends of a transect must differ")
    own, lows, highs = grid.select("j", "i", "lon", "lat"), [F.lit(0.0)], [F.lit(1.0)]
    for c, a, d, size in (("lon", x0, dx, width), ("lat", y0, dy, height)):
        if d == 0:
            own = own.where((F.col(c) - size / 2 <= a) & (F.lit(a) < F.col(c) + size / 2))
        else:
            p, q = (F.col(c) - size / 2 - a) / d, (F.col(c) + size / 2 - a) / d
            lows.append(F.least(p, q))
            highs.append(F.greatest(p, q))
    enter = F.greatest(*lows) if len(lows) > 1 else lows[0]
    leave = F.least(*highs) if len(highs) > 1 else highs[0]
    hit = own.withColumn("enter", enter * length).withColumn("leave", leave * length).where(F.col("leave") > F.col("enter"))
    return hit.select("j", "i", "enter", "leave", F.row_number().over(Window.orderBy("enter", "j", "i")).alias("n"))  # a line's cells


