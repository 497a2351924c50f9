"""Masks and regions: boxes, isobaths, depth bounds, lines, calendar selection, boundary classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.expr import _c


def in_box(lon, lat, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    return _c(lon).between(xmin, xmax) & _c(lat).between(ymin, ymax)


def set_inside(value, lon, lat, box: tuple[float, float, float, float], new) -> Column:
    return F.when(in_box(lon, lat, *box), _c(new)).otherwise(_c(value))


def beside_line(lon, lat, start: tuple[float, float], end: tuple[float, float], above: bool = True) -> Column:
    """Points above (or below) a segment, within its span of longitudes."""
    (x0, y0), (x1, y1) = sorted((start, end))
    line = (y1 - y0) / (x1 - x0) * (_c(lon) - x0) + y0
    return _c(lon).between(x0, x1) & ((_c(lat) >= line) if above else (_c(lat) <= line))


def restrict(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """Grid columns in the boxes of each region: ``grid`` with ``region``; columns in several parts come once.

    A range join: both tables are dimension tables. Spark broadcasts the
    smaller one when its size allows.
    """
    r = regions.select(F.col("name").alias("region"), "xmin", "xmax", "ymin", "ymax")
    hit = grid.join(r, F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax")))
    return hit.select("region", *grid.columns).distinct()


def region_mask(grid: DataFrame, regions: DataFrame, cavity: bool = False) -> DataFrame:
    """Open-ocean (or cavity) columns of each region within its isobaths."""
    bounds = regions.groupBy(F.col("name").alias("_name")).agg(F.min("bathy_deep").alias("_deep"), F.max("bathy_shallow").alias("_shallow"))
    own = restrict(grid, regions).join(bounds, F.col("region") == F.col("_name"))
    kind = F.col("is_ice") if cavity else ~F.col("is_ice")
    return own.where(~F.col("is_land") & kind & F.col("bathy").between(F.col("_deep"), F.col("_shallow"))).select("region", *grid.columns)


def to_levels(mask: DataFrame, levels: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, k, j, i) of the mask's columns: wet levels inside the region's depth bounds."""
    z = regions.groupBy(F.col("name").alias("_name")).agg(F.min("z_deep").alias("_deep"), F.max("z_shallow").alias("_shallow"))
    own = mask.join(z, F.col("region") == F.col("_name")).join(levels, F.col("z").between(F.col("_deep"), F.col("_shallow")) & (F.col("z") > F.col("bathy")))
    return own.select("region", "k", "j", "i")


def apply_mask(field: DataFrame, mask: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    """Rows of the field whose keys are (or are not) in the mask; a mask without k or t holds for all of them."""
    return field.join(mask.select(*keys).distinct(), keys, "left_semi" if keep else "left_anti")


def neighbour_count(grid: DataFrame, condition: Column) -> DataFrame:
    """``grid`` with ``n_near``: the horizontal neighbours that meet the condition.

    At the edge of the domain a column counts as its own neighbour.
    """
    own = grid.withColumn("_ok", condition.cast("int"))
    flags = own.select(F.col("j").alias("_j"), F.col("i").alias("_i"), F.col("_ok").alias("_near"))
    size = own.agg(F.min("j").alias("_j0"), F.max("j").alias("_j1"), F.min("i").alias("_i0"), F.max("i").alias("_i1"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    out = own.join(F.broadcast(size)).withColumn("_s", step)  # one row of bounds
    out = out.withColumn("_nj", F.least(F.greatest(F.col("j") + F.col("_s.dj"), F.col("_j0")), F.col("_j1")))
    out = out.withColumn("_ni", F.least(F.greatest(F.col("i") + F.col("_s.di"), F.col("_i0")), F.col("_i1")))
    near = out.join(flags, (F.col("_nj") == F.col("_j")) & (F.col("_ni") == F.col("_i")), "left")
    return near.groupBy(*grid.columns).agg(F.coalesce(F.sum("_near"), F.lit(0)).cast("int").alias("n_near"))


def ice_front(grid: DataFrame) -> DataFrame:
    """Ice columns beside open ocean."""
    return neighbour_count(grid, ~F.col("is_ice") & ~F.col("is_land")).where(F.col("is_ice") & ~F.col("is_land") & (F.col("n_near") > 0))


def coast(grid: DataFrame) -> DataFrame:
    """Open-ocean columns beside land or ice."""
    return neighbour_count(grid, F.col("is_ice") | F.col("is_land")).where(~F.col("is_ice") & ~F.col("is_land") & (F.col("n_near") > 0))


def grounding_line(grid: DataFrame) -> DataFrame:
    """Ice columns beside land."""
    return neighbour_count(grid, F.col("is_land")).where(F.col("is_ice") & ~F.col("is_land") & (F.col("n_near") > 0))


def boundary_class(grid: DataFrame, region: str) -> DataFrame:
    """(j, i, boundary) of a region's edge columns: ``ice_front`` before ``open_ocean``; ``region`` is a boolean column."""
    shelf = neighbour_count(grid, F.col("is_ice") & ~F.col("is_land")).select("j", "i", F.col("n_near").alias("near_ice"))
    out = neighbour_count(grid, ~F.col(region) & ~F.col("is_ice") & ~F.col("is_land")).withColumnRenamed("n_near", "near_open")
    kind = F.when(F.col("near_ice") > 0, "ice_front").when(F.col("near_open") > 0, "open_ocean")
    return out.where(F.col(region)).join(shelf, ["j", "i"]).select("j", "i", kind.alias("boundary")).where("boundary IS NOT NULL")


def named_masks(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, j, i) of every region's open ocean, of its ice as ``<region>_cavity`` and of its ice front as ``<region>_front``."""
    cavity = region_mask(grid, regions, cavity=True)
    front = cavity.join(ice_front(grid).select("j", "i"), ["j", "i"], "left_semi")
    rows = lambda df, end: df.select(F.concat("region", F.lit(end)).alias("region"), "j", "i")
    return rows(region_mask(grid, regions), "").unionByName(rows(cavity, "_cavity")).unionByName(rows(front, "_front"))


def region_boundaries(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, boundary, j, i): columns of a region beside ice or land (``icefront``), what is too deep (``openocean``), too far
    east (``upstream``) or too far north (``downstream``); of several the first. Each region lies within its own bounds."""
    bounds = regions.groupBy(F.col("name").alias("region")).agg(F.min("bathy_deep").alias("_deep"), F.max("xmax").alias("_east"), F.max("ymax").alias("_north"))
    near = grid.join(bounds).select("region", "j", "i", (F.col("is_ice") | F.col("is_land")).alias("_ice"), (F.col("bathy") < F.col("_deep")).alias("_sea"), (F.col("lon") >= F.col("_east")).alias("_up"), (F.col("lat") >= F.col("_north")).alias("_down"))
    size = grid.agg(F.min("j").alias("_j0"), F.max("j").alias("_j1"), F.min("i").alias("_i0"), F.max("i").alias("_i1"))  # one row
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    own = region_mask(grid, regions).select("region", "j", "i").join(F.broadcast(size)).withColumn("_s", step)
    own = own.select("region", F.col("j").alias("_j"), F.col("i").alias("_i"), F.least(F.greatest(F.col("j") + F.col("_s.dj"), "_j0"), "_j1").alias("j"), F.least(F.greatest(F.col("i") + F.col("_s.di"), "_i0"), "_i1").alias("i"))
    kinds = {"icefront": "_ice", "openocean": "_sea", "upstream": "_up", "downstream": "_down"}
    hit = own.join(near, ["region", "j", "i"]).groupBy("region", F.col("_j").alias("j"), F.col("_i").alias("i")).agg(*[F.max(c).alias(c) for c in kinds.values()])
    first = F.coalesce(*[F.when(F.col(c), F.lit(k)) for k, c in kinds.items()])
    return hit.select("region", first.alias("boundary"), "j", "i").where("boundary IS NOT NULL")


def years(df: DataFrame, first: int, last: int, time: str = "t") -> DataFrame:
    return df.where(F.year(time).between(first, last))


def first_crossing(df: DataFrame, keys: list[str], value: str, threshold: float, time: str = "t") -> DataFrame:
    """The first time a series exceeds a threshold; null if never."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) > threshold, F.col(time))).alias("first_time"))
