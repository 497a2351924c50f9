"""Domain boundaries, transports and budgets; bias correction; merges; grid checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.expr import wrap_angle
from strataframe.operators.stencil import at_offset


def edge(df: DataFrame, side: str) -> DataFrame:
    """The rows at the ``west``, ``east``, ``south`` or ``north`` end of the domain."""
    axis, f = {"west": ("i", F.min), "east": ("i", F.max), "south": ("j", F.min), "north": ("j", F.max)}[side]
    end = df.agg(f(axis).alias("_edge"))
    return df.join(F.broadcast(end), F.col(axis) == F.col("_edge")).drop("_edge")  # one row


def transport(df: DataFrame, keys: list[str], normal: str, area: str) -> DataFrame:
    """(keys, onshore, offshore, net) in Sv: sums of the negative and the positive flux."""
    flux = F.col(normal) * F.col(area) * 1e-6
    return df.groupBy(*keys).agg(F.sum(F.least(flux, F.lit(0.0))).alias("onshore"), F.sum(F.greatest(flux, F.lit(0.0))).alias("offshore"), F.sum(flux).alias("net"))


def inflow(df: DataFrame, keys: list[str], u: str, v: str, inside: str) -> DataFrame:
    """(keys, inflow): net flux into a region through its faces; u, v stand on western and southern faces.

    A face counts where exactly one of its two cells is ``inside`` (boolean);
    faces of missing cells do not.
    """
    own = df.withColumn("_w", at_offset(inside, [*keys, "j"], "i", -1)).withColumn("_s", at_offset(inside, [*keys, "i"], "j", -1))
    sign = lambda other: F.when(F.col(inside) & ~F.col(other), 1.0).when(~F.col(inside) & F.col(other), -1.0).otherwise(0.0)
    return own.groupBy(*keys).agg(F.sum(F.coalesce(sign("_w"), F.lit(0.0)) * F.col(u) + F.coalesce(sign("_s"), F.lit(0.0)) * F.col(v)).alias("inflow"))


def balance(faces: DataFrame, keys: list[str], velocity: str, area: str, sign: str, target: float = 0.0, share: float = 1.0) -> DataFrame:
    """``velocity`` with a uniform correction so that the net inflow reaches ``target`` (or by ``share`` of the way).

    ``sign`` is +1 where positive velocity flows in, -1 where it flows out. Net
    flux and area are one row per key, joined back.
    """
    net = faces.groupBy(*keys).agg(F.sum(F.col(velocity) * F.col(area) * F.col(sign)).alias("_net"), F.sum(area).alias("_area"))
    own = faces.join(net, keys) if keys else faces.join(F.broadcast(net))
    return own.withColumn(velocity, F.col(velocity) - share * (F.col("_net") - target) / F.col("_area") * F.col(sign)).drop("_net", "_area")


def offset_correction(model: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, offset): reference climatology minus model climatology."""
    m, r = model.groupBy(*keys).agg(F.avg(value).alias("_m")), reference.groupBy(*keys).agg(F.avg(value).alias("_r"))
    return m.join(r, keys).select(*keys, (F.col("_r") - F.col("_m")).alias("offset"))


def transplant(model: DataFrame, reference: DataFrame, keys: list[str], value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The model's anomalies on the reference's climatology, kept inside physical bounds."""
    out = F.col(value) + F.col("offset")
    out = F.greatest(out, F.lit(low)) if low is not None else out
    out = F.least(out, F.lit(high)) if high is not None else out
    return model.join(offset_correction(model, reference, keys, value), keys).withColumn(value, out).drop("offset")


def polar_correction(model: DataFrame, reference: DataFrame, keys: list[str], u: str, v: str, most: float = 3.0) -> DataFrame:
    """(keys, scale, turn): ratio of mean speeds, capped, and wrapped difference of mean directions."""
    m = model.groupBy(*keys).agg(F.avg(u).alias("_mu"), F.avg(v).alias("_mv"))
    r = reference.groupBy(*keys).agg(F.avg(u).alias("_ru"), F.avg(v).alias("_rv"))
    speed = F.hypot("_mu", "_mv")
    scale = F.when(speed > 0, F.least(F.hypot("_ru", "_rv") / speed, F.lit(most)))
    return m.join(r, keys).select(*keys, scale.alias("scale"), wrap_angle(F.atan2("_rv", "_ru") - F.atan2("_mv", "_mu")).alias("turn"))


def rescale(model: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Model values mapped from their own range to that of the reference (its least value where the model is constant)."""
    ends = lambda df, p: df.groupBy(*keys).agg(F.min(value).alias(f"_{p}0"), F.max(value).alias(f"_{p}1"))
    own = model.join(ends(model, "m"), keys).join(ends(reference, "r"), keys)
    part = F.when(F.col("_m1") > F.col("_m0"), (F.col(value) - F.col("_m0")) / (F.col("_m1") - F.col("_m0"))).otherwise(0.0)
    return own.withColumn(value, F.col("_r0") + part * (F.col("_r1") - F.col("_r0"))).drop("_m0", "_m1", "_r0", "_r1")


def taper(distance: str | Column, reach: float) -> Column:
    """1 at the coast, 0 from ``reach`` on, cosine between."""
    import math

    d = F.col(distance) if isinstance(distance, str) else distance
    return F.when(d >= reach, 0.0).otherwise(0.5 + 0.5 * F.cos(d * (math.pi / reach)))


def merge_where(deep: DataFrame, shelf: DataFrame, keys: list[str], values: list[str], use_shelf: Column) -> DataFrame:
    """Two fields as one: ``shelf`` where the condition on the keys holds, else ``deep``."""
    s = shelf.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in values])
    own = deep.join(s, keys, "full")
    return own.select(*keys, *[F.when(use_shelf, F.col(f"_s_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def merge_edits(original: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, conflict): edited copies (rows keyed alike) against an original; two different changes are a conflict."""
    o = original.select(*keys, F.col(value).alias("_o"))
    changed = edits.join(o, keys).where(~F.col(value).eqNullSafe(F.col("_o")))
    new = changed.groupBy(*keys).agg(F.min(value).alias("_new"), (F.count_distinct(value) > 1).alias("_clash"))
    out = o.join(new, keys, "left")
    return out.select(*keys, F.coalesce("_new", "_o").alias(value), F.coalesce("_clash", F.lit(False)).alias("conflict"))


def isolated_bottom(cells: DataFrame, keys: list[str], wet: str, level: str = "k") -> DataFrame:
    """(keys, j, i, k): bottom cells none of whose horizontal neighbours is wet at that level."""
    own = cells
    for name, axis, other, d in (("_w", "i", "j", -1), ("_e", "i", "j", 1), ("_s", "j", "i", -1), ("_n", "j", "i", 1)):
        own = own.withColumn(name, at_offset(wet, [*keys, level, other], axis, d))
    deepest = F.max(F.when(F.col(wet), F.col(level))).over(Window.partitionBy(*keys, "j", "i"))
    beside = F.coalesce("_w", F.lit(False)) | F.coalesce("_e", F.lit(False)) | F.coalesce("_s", F.lit(False)) | F.coalesce("_n", F.lit(False))
    return own.withColumn("_deep", deepest).where(F.col(wet) & (F.col(level) == F.col("_deep")) & ~beside).select(*keys, "j", "i", level)


def fill_isolated(bottoms: DataFrame, depth: str = "bathy") -> DataFrame:
    """Bathymetry raised to its deepest neighbour where it is deeper than all of them (an edge has fewer neighbours)."""
    own = bottoms
    for name, axis, other, d in (("_w", "i", "j", -1), ("_e", "i", "j", 1), ("_s", "j", "i", -1), ("_n", "j", "i", 1)):
        own = own.withColumn(name, at_offset(depth, [other], axis, d))
    near = F.least("_w", "_e", "_s", "_n")
    return own.withColumn(depth, F.greatest(F.col(depth), F.coalesce(near, F.col(depth)))).drop("_w", "_e", "_s", "_n")


def zap_thin(grid: DataFrame, least: float, draft: str = "draft", grow: bool = False) -> DataFrame:
    """Ice thinner than ``least`` is removed, or thickened to it with ``grow``."""
    thin = (F.col(draft) < 0) & (F.col(draft) > -least)
    return grid.withColumn(draft, F.when(thin, -least if grow else 0.0).otherwise(F.col(draft)))


def dig(grid: DataFrame, least: float, bathy: str = "bathy", draft: str = "draft") -> DataFrame:
    """Columns deepened so that each ice column and its neighbours share at least ``least`` metres of water."""
    own = grid
    for name, axis, other, d in (("_w", "i", "j", -1), ("_e", "i", "j", 1), ("_s", "j", "i", -1), ("_n", "j", "i", 1)):
        own = own.withColumn(name, at_offset(draft, [other], axis, d))
    lowest = F.least(draft, *[F.coalesce(s, F.lit(0.0)) for s in ("_w", "_e", "_s", "_n")])
    return own.withColumn(bathy, F.when(lowest < 0, F.least(F.col(bathy), lowest - least)).otherwise(F.col(bathy))).drop("_w", "_e", "_s", "_n")


def model_surface(grid: DataFrame, levels: DataFrame, surface: str, least: float = 0.1, least_dz: float = 20.0) -> DataFrame:
    """``grid`` with ``surface`` (a sea floor) as partial cells can hold it.

    In its level the open part below a minimum is closed or opened to the
    minimum, whichever is nearer; what lies below all levels ends at the last.
    """
    at = grid.join(levels.select("z_top", "z_bot", "dz"), (F.col(surface) < F.col("z_top")) & (F.col(surface) >= F.col("z_bot")), "left")
    floor = levels.agg(F.min("z_bot").alias("_floor"))  # one row
    limit = F.greatest(F.lit(least), F.least(least_dz / F.col("dz"), F.lit(1.0)))
    part = (F.col("z_top") - F.col(surface)) / F.col("dz")
    kept = F.when(part < limit / 2, 0.0).when(part < limit, limit).otherwise(part)
    out = F.when(F.col("z_top").isNotNull(), F.col("z_top") - kept * F.col("dz")).otherwise(F.greatest(F.col(surface), F.col("_floor")))
    return at.join(F.broadcast(floor)).withColumn(surface, out).select(*grid.columns)


def repair(grid: DataFrame, water: float, ice: float) -> DataFrame:
    """Isolated bottoms raised, columns dug, thin ice thickened, in this order: ``grid`` with the old surfaces in ``bathy_before`` and
    ``draft_before`` and which step changed a column in ``raised``, ``dug`` and ``thickened``."""
    own = fill_isolated(grid.withColumns({"bathy_before": F.col("bathy"), "draft_before": F.col("draft")}))
    own = dig(own.withColumn("raised", F.col("bathy") != F.col("bathy_before")).withColumn("_b", F.col("bathy")), water)
    own = zap_thin(own.withColumn("dug", F.col("bathy") != F.col("_b")).drop("_b"), ice, grow=True)
    return own.withColumn("thickened", F.col("draft") != F.col("draft_before"))
