"""Named diagnostics: names parsed on the driver, grouped by kernel, computed together and returned as (time, name, value).

One aggregate over the field serves all kernels of cells, one over the surface
all kernels of columns' surface values; kernels that need a whole column, a
neighbour, a point or a line call their operator. Results are
``kernel * factor + offset``, in the units of the name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as made
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import constants as K
from strataframe.functions import expr as X
from strataframe.operators import columns, regrid, stencil
from strataframe.operators.agg import water_mass_percent, wavg

ALL = "all"  # the region of all columns
DEEPEST = -1e9


@dataclass(frozen=True)
class Diagnostic:
    """A name's parameters; results are ``kernel * factor + offset``."""

    name: str
    region: str
    variable: str
    kernel: str
    shallow: float = 0.0
    deep: float = DEEPEST
    threshold: float | None = None
    factor: float = 1.0
    offset: float = 0.0
    units: str = ""
    place: tuple = ()  # a box, two points, bounds of a water mass, or the sign of a transport
    boundary: str = ""


_HEAT = 1e-9 * K.HEAT_SEA * K.RHO_SEA
_MASS = K.RHO_ICE / K.KG_PER_GT

#: Endings of names after a region, with kernel, variable, factor, offset and units.
ENDINGS = (
    ("mass_balance", "melt_balance", "melt", _MASS, 0.0, "Gt/y"),
    ("massloss", "melt_integral", "melt", _MASS, 0.0, "Gt/y"),
    ("melting", "melt_average", "melt", 1.0, 0.0, "m/y"),
    ("temp", "average", "temp", 1.0, 0.0, "degC"),
    ("salt", "average", "salt", 1.0, 0.0, "psu"),
    ("density", "average", "density", 1.0, 0.0, "kg/m3"),
    ("age", "average", "age", 1.0, 0.0, "years"),
    ("tminustf", "average", "temp_above_surface_freezing", 1.0, 0.0, "degC"),
    ("temp_bottom", "bottom_average", "temp", 1.0, 0.0, "degC"),
    ("salt_bottom", "bottom_average", "salt", 1.0, 0.0, "psu"),
    ("density_bottom", "bottom_average", "density", 1.0, 0.0, "kg/m3"),
    ("atemp_avg", "surface_average", "air_temp", 1.0, -K.KELVIN, "degC"),
    ("wind_avg", "surface_average", "wind", 1.0, 0.0, "m/s"),
    ("uwind_avg", "surface_average", "wind_u", 1.0, 0.0, "m/s"),
    ("vwind_avg", "surface_average", "wind_v", 1.0, 0.0, "m/s"),
    ("aqh_avg", "surface_average", "humidity", 1e3, 0.0, "1e-3 kg/kg"),
    ("precip_avg", "surface_average", "precipitation", 1e9, 0.0, "1e-9 m/s"),
    ("sst_avg", "surface_average", "top_temp", 1.0, 0.0, "degC"),
    ("sss_avg", "surface_average", "top_salt", 1.0, 0.0, "psu"),
    ("hice_avg", "surface_average", "ice_thickness", 1.0, 0.0, "m"),
    ("iceprod", "surface_integral", "ice_production", 1e-3, 0.0, "1e3 m3/s"),
    ("iceshelf_area", "cavity_area", "one", 1e-9, 0.0, "1e3 km2"),
    ("seaice_melt", "surface_integral", "ice_melt", 1e-6, 0.0, "1e3 m3/s"),
    ("seaice_freeze", "surface_integral", "ice_freeze", 1e-6, 0.0, "1e3 m3/s"),
    ("pmepr", "surface_integral", "rain_less_evaporation", 1e-6, 0.0, "1e3 m3/s"),
    ("fwflx", "surface_integral", "fresh_water", 1e-6, 0.0, "1e3 m3/s"),
    ("heatflx", "surface_integral", "heat", 1.0, 0.0, "W"),
    ("salt_adv", "inflow", "salt_advection", 1.0, 0.0, "psu m3/s"),
    ("salt_dif", "inflow", "salt_diffusion", 1.0, 0.0, "psu m3/s"),
    ("salt_sfc", "surface_integral", "salt_flux", 1.0 / K.RHO_SEA, 0.0, "psu m3/s"),
    ("salt_sfc_corr", "surface_integral", "salt_correction", -1.0, 0.0, "psu m3/s"),
    ("salt_tend", "integral", "salt_tendency", 1.0 / 86400.0, 0.0, "psu m3/s"),
    ("res_time", "residence_time", "streamfunction", 1.0, 0.0, "y"),
    ("mean_psi", "surface_average", "absolute_streamfunction", 1e-6, 0.0, "Sv"),
    ("max_psi", "surface_max", "absolute_streamfunction", 1e-6, 0.0, "Sv"),
    ("ustar", "surface_average", "friction_velocity", 1.0, 0.0, "m/s"),
    ("thermal_driving", "surface_average", "thermal_driving", 1.0, 0.0, "degC"),
    ("front_tmax", "front_max", "temp", 1.0, 0.0, "degC"),
    ("thermocline", "thermocline", "temp", 1.0, 0.0, "m"),
    ("seaice_area", "surface_integral", "ice_area", 1e-12, 0.0, "million km2"),
)

#: Names that go on with ``_below_<depth>m`` or ``_btw_<depth>_<depth>m``.
BY_DEPTH = (
    ("mass_balance", "melt_balance", "melt", _MASS, "Gt/y"),
    ("massloss", "melt_integral", "melt", _MASS, "Gt/y"),
    ("melting", "melt_average", "melt", 1.0, "m/y"),
    ("temp", "average", "temp", 1.0, "degC"),
    ("salt", "average", "salt", 1.0, "psu"),
    ("ohc", "integral", "kelvin", _HEAT, "GJ"),
    ("dohc_adv", "inflow", "heat_advection", _HEAT, "GJ/s"),
    ("advection_heat_xy", "inflow", "heat_advection", _HEAT, "GJ/s"),
    ("advection_heat_z", "inflow_down", "heat_advection_down", _HEAT, "GJ/s"),
    ("diffusion_heat_implicit_z", "inflow_down", "heat_diffusion", _HEAT, "GJ/s"),
    ("kpp_heat_z", "inflow_down", "heat_mixing", _HEAT, "GJ/s"),
    ("shortwave_penetration", "shortwave", "shortwave", _HEAT, "GJ/s"),
)

#: Names of one place, with kernel, region, variable, threshold or depth, place, factor and units.
NAMED = (
    ("hice_corner", "surface_max", ALL, "ice_thickness", None, (-62.0, -59.5, -75.5, -74.0), 1.0, "m"),
    ("hice_max", "surface_max", ALL, "ice_thickness", None, (), 1.0, "m"),
    ("mld_ewed", "surface_max", ALL, "mixed_layer", None, (-30.0, 30.0, -69.0, -60.0), 1.0, "m"),
    ("eta_avg", "surface_average", ALL, "surface_height", None, (), 1.0, "m"),
    ("seaice_area", "surface_integral", ALL, "ice_area", None, (), 1e-12, "million km2"),
    ("temp_polynya", "point_average", "polynya", "temp", None, (), 1.0, "degC"),
    ("salt_polynya", "point_average", "polynya", "salt", None, (), 1.0, "psu"),
    ("conv_area", "area_at_least", ALL, "mixed_layer", 2000.0, (), 1e-12, "million km2"),
    ("wed_gyre_trans", "gyre_transport", "wed_gyre", "u", None, (), 1.0, "Sv"),
    ("isw_vol", "water_mass", ALL, "temp", None, (None, -1.9, None, None), 1.0, "% of domain"),
    ("hssw_vol", "water_mass", ALL, "temp", None, (-1.9, -1.8, 34.55, None), 1.0, "% of domain"),
    ("wdw_vol", "water_mass", ALL, "temp", None, (0.0, None, None, None), 1.0, "% of domain"),
    ("mwdw_vol", "water_mass", ALL, "temp", None, (-1.5, 0.0, 34.25, 34.55), 1.0, "% of domain"),
    ("ocean_vol", "volume", ALL, "surface_height", None, (), 1.0, "m3"),
    ("filchner_trans", "transect_transport", "", "u", None, ((-45.0, -78.05), (-34.8, -78.2), -1.0), 1.0, "Sv"),
    ("PITE_trans", "transect_transport", "", "u", None, ((-107.0, -73.0), (-105.0, -73.0), -1.0), 1.0, "Sv"),
    ("atemp_avg", "surface_average", ALL, "air_temp", None, (), 1.0, "degC"),
    ("ft_sill_delta_rho", "density_difference", "", "temp", -600.0, ((-32.0, -75.0), (-32.0, -74.0)), 1.0, "kg/m3"),
    ("ronne_delta_rho", "density_difference", "", "temp", -600.0, ((-60.0, -74.75), (-70.0, -78.0)), 1.0, "kg/m3"),
)

#: What one aggregate over cells computes, what one over columns' surface values does, and what needs an operator of its own.
CELLS = ("average", "integral", "max", "min", "share", "front_max", "water_mass", "shortwave")
SURFACE = ("surface_average", "surface_integral", "surface_max", "area_at_least", "cavity_area", "melt_balance", "melt_integral", "melt_average")
COLUMNS = ("bottom_average", "depth_average", "thermocline", "isoline_depth")

_DEPTHS = r"(?:below_(?P<top>\d+)m|btw_(?P<a>\d+)_(?P<b>\d+)m)$"
_PATTERN = re.compile(r"^(?P<region>\w+?)_(?P<variable>[a-z])_(?P<kernel>avg|int|max|min|above_(?P<above>\d+))(?:_btw_(?P<a>\d+)_(?P<b>\d+)m)?$")
_DEPTH = re.compile(r"^(?P<region>\w+?)_(?P<what>" + "|".join(sorted((r[0] for r in BY_DEPTH), key=len, reverse=True)) + r")_" + _DEPTHS)
_MERIDIONAL = re.compile(r"^(?P<region>\w+?)_adv_heat_ns_(?P<a>\d+)_(?P<b>\d+)m$")
_AT_DEPTH = re.compile(r"^(?P<region>\w+?)_density_(?P<a>\d+)m$")
_BOUNDARY = re.compile(r"^(?P<region>\w+?)_salt_(?P<what>adv|dif)_(?P<boundary>icefront|openocean|upstream|downstream)$")
_ISOTHERM = re.compile(r"^(?P<region>\w+?)_isotherm_(?P<at>-?\d+(?:\.\d+)?)C(?:_below_(?P<top>\d+)m)?$")
_KERNELS = {"avg": "average", "int": "integral", "max": "max", "min": "min"}
_CATALOG: dict[str, Diagnostic] = {}


def register_diagnostic(d: Diagnostic) -> None:
    """Add or replace a name that :func:`parse` knows."""
    _CATALOG[d.name] = d


def parse(name: str) -> Diagnostic:
    """The parameters of a registered name, a name of NAMED, or a region with one of the endings.

    Endings are those of ENDINGS, those of BY_DEPTH with their depths,
    ``_density_<depth>m``, ``_adv_heat_ns_<depth>_<depth>m``,
    ``_salt_adv_<boundary>``, ``_isotherm_<t>C[_below_<depth>m]``, and for
    variables of one letter ``_x_avg``, ``_x_int_btw_100_250m``, ``_x_above_5``.
    The region ``avg`` is the whole domain.
    """
    if name in _CATALOG:
        return _CATALOG[name]
    for own, kernel, region, variable, at, place, factor, units in NAMED:
        if own == name:
            return Diagnostic(name, region, variable, kernel, threshold=at, factor=factor, offset=-K.KELVIN if variable == "air_temp" else 0.0, units=units, place=place)
    if m := _PATTERN.match(name):
        a, b = (float(m["a"]), float(m["b"])) if m["a"] else (0.0, -DEEPEST)
        kernel = "share" if m["above"] else _KERNELS[m["kernel"]]
        return Diagnostic(name, m["region"], m["variable"], kernel, -a, -b, float(m["above"]) if m["above"] else None)
    if m := _DEPTH.match(name):
        _, kernel, variable, factor, units = next(r for r in BY_DEPTH if r[0] == m["what"])
        a, b = (float(m["top"]), -DEEPEST) if m["top"] else (float(m["a"]), float(m["b"]))
        return Diagnostic(name, m["region"], variable, kernel, -a, -b, None, factor, 0.0, units)
    if m := _MERIDIONAL.match(name):
        return Diagnostic(name, m["region"], "heat_advection_north", "integral", -float(m["a"]), -float(m["b"]), units="degC m3/s")
    if m := _AT_DEPTH.match(name):
        return Diagnostic(name, m["region"], "density", "depth_average", threshold=-float(m["a"]), units="kg/m3")
    if m := _BOUNDARY.match(name):
        return Diagnostic(name, m["region"], {"adv": "salt_advection", "dif": "salt_diffusion"}[m["what"]], "inflow_boundary", units="psu m3/s", boundary=m["boundary"])
    if m := _ISOTHERM.match(name):
        return Diagnostic(name, m["region"], "temp", "isoline_depth", -float(m["top"] or 0), threshold=float(m["at"]), units="m")
    for ending, kernel, variable, factor, offset, units in sorted(ENDINGS, key=lambda r: -len(r[0])):
        if name.endswith(f"_{ending}") and len(name) > len(ending) + 1:
            region = name[: -len(ending) - 1]
            return Diagnostic(name, ALL if region == "avg" else region, variable, kernel, factor=factor, offset=offset, units=units)
    raise ValueError(f"unknown diagnostic {name}")


@dataclass
class Inputs:
    """What diagnostics are computed from.

    ``cells``: (time, k, j, i, volume, variables of cells). ``surface``: (time, j,
    i, area, variables of columns). ``grid``: (j, i, lon, lat, draft). ``masks``:
    (region, j, i), with ``<shelf>_cavity`` and ``<shelf>_front`` for shelves.
    ``boundaries``: (region, boundary, j, i). ``variables`` maps the catalogue's
    variables to columns; pairs of components are named ``<variable>_x`` and
    ``<variable>_y``. ``size`` is the width and height of a cell in degrees.
    """

    cells: DataFrame
    masks: DataFrame
    levels: DataFrame
    surface: DataFrame | None = None
    grid: DataFrame | None = None
    boundaries: DataFrame | None = None
    time: str = "t"
    volume: str = "w"
    area: str = "w"
    variables: dict[str, str | Column] = made(default_factory=dict)
    points: dict[str, tuple[float, float]] = made(default_factory=dict)
    size: tuple[float, float] = (1.0, 1.0)
    period: float | None = 360.0

    def of(self, variable: str) -> Column:
        if variable == "one":
            return F.lit(1.0)
        if variable == "kelvin":
            return self.of("temp") + K.KELVIN
        if variable == "temp_above_surface_freezing":
            return self.of("temp") - X.freezing_point(self.of("salt"), F.lit(0.0))
        own = self.variables.get(variable, variable)
        return F.col(own) if isinstance(own, str) else own

    def need(self, what: str, d: Diagnostic) -> DataFrame:
        if (out := getattr(self, what)) is None:
            raise ValueError(f"{d.name} needs {what}")
        return out

    def in_mass(self, d: Diagnostic) -> Column:
        """Whether a cell belongs to a water mass, bounds included."""
        t, s, (a, b, c, e) = self.of("temp"), self.of("salt"), d.place
        return reduce(Column.__and__, [x for x in (t >= a if a is not None else None, t <= b if b is not None else None, s >= c if c is not None else None, s <= e if e is not None else None) if x is not None])

    def region(self, d: Diagnostic) -> str:
        """The mask that a diagnostic looks at; one with a box or with bounds of the draft has a mask of its own."""
        if d.kernel.startswith("melt") and d.deep > DEEPEST or d.kernel.startswith("surface") and d.place:
            return d.name
        if d.kernel.startswith("melt") or d.kernel in ("cavity_area", "residence_time"):
            return d.region if d.region == ALL else f"{d.region}_cavity"
        return f"{d.region}_front" if d.kernel == "front_max" else d.region

    def mask(self, specs: list[Diagnostic]) -> DataFrame:
        """(region, j, i) of all masks that the diagnostics look at."""
        out = [self.masks.where(F.col("region").isin(sorted({self.region(d) for d in specs} - {ALL})))]
        if any(self.region(d) == ALL for d in specs):
            columns_of = self.grid if self.grid is not None else self.cells.select("j", "i").distinct()
            out.append(columns_of.select(F.lit(ALL).alias("region"), "j", "i"))
        for d in specs:
            if self.region(d) == d.name and d.place:
                xmin, xmax, ymin, ymax = d.place
                out.append(self.need("grid", d).where(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax)).select(F.lit(d.name).alias("region"), "j", "i"))
            elif self.region(d) == d.name:
                shelf = self.masks.where(F.col("region") == f"{d.region}_cavity").join(self.need("grid", d).select("j", "i", "draft"), ["j", "i"])
                out.append(shelf.where((F.col("draft") > d.deep) & (F.col("draft") <= d.shallow)).select(F.lit(d.name).alias("region"), "j", "i"))
        return reduce(DataFrame.unionByName, out)


def _long(wide: DataFrame, time: str, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]))
    return wide.select(time, pairs.alias("_p")).select(time, "_p.name", "_p.value")


def _cell(inp: Inputs, d: Diagnostic) -> Column:
    here = (F.col("region") == inp.region(d)) & F.col("z").between(d.deep, d.shallow)
    w = F.when(here, F.col(inp.volume))
    if d.kernel == "water_mass":
        return water_mass_percent(F.when(here, inp.of("temp")), inp.of("salt"), w, *d.place)
    if d.kernel == "shortwave":  # flux at the surface, times what the cell's level absorbs
        return F.sum(F.when(here, F.col("_shortwave") * F.col("_area") * X.shortwave_fraction("z_top", "z_bot"))) / (K.RHO_SEA * K.HEAT_SEA)
    x = F.when(here, inp.of(d.variable))
    return {
        "average": lambda: wavg(x, w), "integral": lambda: F.sum(x * w), "max": lambda: F.max(x), "min": lambda: F.min(x), "front_max": lambda: F.max(x),
        "share": lambda: 100.0 * F.sum(F.when(x >= d.threshold, w).otherwise(F.when(x.isNotNull(), 0.0))) / F.sum(F.when(x.isNotNull(), w)),
    }[d.kernel]()


def _cells(inp: Inputs, specs: list[Diagnostic]) -> list[DataFrame]:
    own = inp.cells
    if short := [d for d in specs if d.kernel == "shortwave"]:
        flux = inp.need("surface", short[0]).select(inp.time, "j", "i", inp.of("shortwave").alias("_shortwave"), F.col(inp.area).alias("_area"))
        own = own.join(flux, [inp.time, "j", "i"], "left")
    own = own.join(F.broadcast(inp.levels), "k").join(inp.mask(specs), ["j", "i"])  # one row per level
    return [_long(own.groupBy(inp.time).agg(*[_cell(inp, d).alias(d.name) for d in specs]), inp.time, [d.name for d in specs])]


def _surface(inp: Inputs, specs: list[Diagnostic]) -> list[DataFrame]:
    """Variables of columns, and those that follow from a column's cells: the top level, and the absolute sum of the stream function."""
    own, derived = inp.need("surface", specs[0]), {}
    for d in specs:
        if d.variable in ("top_temp", "top_salt"):
            x = inp.of(d.variable[4:])
            derived[d.variable] = F.min_by(x, F.when(x.isNotNull(), F.col("k")))
        elif d.variable == "absolute_streamfunction":
            derived[d.variable] = F.abs(F.sum(inp.of("streamfunction")))
    if derived:
        tops = inp.cells.groupBy(inp.time, "j", "i").agg(*[c.alias(f"_{v}") for v, c in derived.items()])
        own = own.join(tops, [inp.time, "j", "i"], "left")
    own, aggregates = own.join(inp.mask(specs), ["j", "i"]), {}
    for d in specs:
        here = F.col("region") == inp.region(d)
        x, a = F.when(here, F.col(f"_{d.variable}") if d.variable in derived else inp.of(d.variable)), F.when(here, F.col(inp.area))
        if d.kernel == "melt_balance":
            aggregates |= {f"{d.name}_melt": F.sum(F.greatest(x, F.lit(0.0)) * a), f"{d.name}_freeze": F.sum(F.least(x, F.lit(0.0)) * a)}
        elif d.kernel in ("surface_average", "melt_average"):
            aggregates[d.name] = wavg(x, a)
        elif d.kernel == "area_at_least":
            aggregates[d.name] = F.sum(F.when(x >= d.threshold, a).otherwise(F.when(x.isNotNull(), 0.0)))
        else:
            aggregates[d.name] = F.max(x) if d.kernel == "surface_max" else F.sum(x * a)
    return [_long(own.groupBy(inp.time).agg(*[c.alias(n) for n, c in aggregates.items()]), inp.time, list(aggregates))]


def _columns(inp: Inputs, specs: list[Diagnostic]) -> list[DataFrame]:
    """A value or depth of every column, then its mean by area."""
    key, parts = [inp.time, "j", "i"], []
    cells = inp.cells.join(F.broadcast(inp.levels.select("k", "z")), "k")  # one row per level
    for d in specs:
        own = cells.select(*key, "k", "z", inp.of(d.variable).alias("v"))
        if d.kernel == "bottom_average":
            out = columns.end_level(own, key, "v", which="bottom")
        elif d.kernel == "depth_average":
            out = columns.at_depth(own, inp.levels, key, "v", d.threshold)
        elif d.kernel == "thermocline":
            out = columns.thermocline(own, key, "v").withColumnRenamed("depth", "v")
        else:
            out = columns.isoline_depth(own, key, "v", d.threshold, d.shallow).withColumnRenamed("depth", "v")
        parts.append(out.select(*key, "v", F.lit(d.name).alias("name"), F.lit(inp.region(d)).alias("region")))
    area = inp.need("surface", specs[0]).select(*key, F.col(inp.area).alias("_area"))
    own = reduce(DataFrame.unionByName, parts).join(inp.mask(specs).distinct(), ["region", "j", "i"]).join(area, key)
    return [own.groupBy(inp.time, "name").agg(wavg("v", "_area").alias("value"))]


def _fluxes(inp: Inputs, specs: list[Diagnostic]) -> list[DataFrame]:
    """Net flux into the cells of a region: through their sides, from above and below, or only through one boundary."""
    out, key = [], [inp.time, "k"]
    for kernel, variable in sorted({(d.kernel, d.variable) for d in specs}):
        mine = [d for d in specs if (d.kernel, d.variable) == (kernel, variable)]
        if kernel == "inflow_down":
            own = inp.cells.select(*key, "j", "i", inp.of(variable).alias("_v"))
            last = F.broadcast(inp.levels.agg(F.max("k").alias("_last")))  # one row
            own = own.join(last).withColumn("_d", F.coalesce(stencil.at_offset("_v", [inp.time, "j", "i"], "k", 1), F.lit(0.0)) - F.col("_v"))
            own = own.withColumn("_d", F.when(F.col("k") == F.col("_last"), 0.0).otherwise(F.col("_d")))
        else:
            own = inp.cells.select(*key, "j", "i", inp.of(f"{variable}_x").alias("_u"), inp.of(f"{variable}_y").alias("_v"))
        if kernel == "inflow":
            own = stencil.flux_divergence(own, "_u", "_v", key, "_d")
        if kernel == "inflow_boundary":
            own = own.withColumn("_e", F.coalesce(stencil.at_offset("_u", [*key, "j"], "i", 1), F.lit(0.0))).withColumn("_n", F.coalesce(stencil.at_offset("_v", [*key, "i"], "j", 1), F.lit(0.0)))
            own = own.join(_faces(inp, mine), ["j", "i"])
            flux = lambda side, x: F.when(F.col(side), F.col(x)).otherwise(0.0)
            own = own.withColumn("_d", flux("west", "_u") - flux("east", "_e") + flux("south", "_v") - flux("north", "_n"))
            out.append(own.groupBy(inp.time, "name").agg(F.sum("_d").alias("value")))
            continue
        own = own.join(F.broadcast(inp.levels.select("k", "z")), "k").join(inp.mask(mine), ["j", "i"])
        sums = [F.sum(F.when((F.col("region") == inp.region(d)) & F.col("z").between(d.deep, d.shallow), F.col("_d"))).alias(d.name) for d in mine]
        out.append(_long(own.groupBy(inp.time).agg(*sums), inp.time, [d.name for d in mine]))
    return out


def _faces(inp: Inputs, specs: list[Diagnostic]) -> DataFrame:
    """(name, j, i, west, east, south, north): which sides of a boundary's columns look out of the region."""
    asked = reduce(DataFrame.unionByName, [
        inp.need("boundaries", d).where((F.col("region") == d.region) & (F.col("boundary") == d.boundary)).select(F.lit(d.name).alias("name"), "region", "j", "i") for d in specs
    ])
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.lit(dj).alias("dj"), F.lit(di).alias("di")) for n, dj, di in (("west", 0, -1), ("east", 0, 1), ("south", -1, 0), ("north", 1, 0))]))
    near = asked.withColumn("_s", sides).select("name", "region", "j", "i", "_s.side", (F.col("j") + F.col("_s.dj")).alias("_j"), (F.col("i") + F.col("_s.di")).alias("_i"))
    there = inp.need("grid", specs[0]).select(F.col("j").alias("_j"), F.col("i").alias("_i"))
    inside = inp.masks.select("region", F.col("j").alias("_j"), F.col("i").alias("_i"))
    outside = near.join(there, ["_j", "_i"]).join(inside, ["region", "_j", "_i"], "left_anti")
    return outside.groupBy("name", "j", "i").agg(*[F.max(F.col("side") == s).alias(s) for s in ("west", "east", "south", "north")])


def _at_points(inp: Inputs, d: Diagnostic, points: list[tuple[str, float, float]], values: dict[str, Column]) -> DataFrame:
    """(time, k, point, values) interpolated to points; null at levels where a corner is missing."""
    some = inp.need("grid", d)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.lit(x).alias("lon"), F.lit(y).alias("lat")) for n, x, y in points]))
    w = regrid.bilinear_weights(some.limit(1).select(each.alias("p")).select("p.*"), some, ["point"], period=inp.period)
    own = inp.cells.select(inp.time, "k", "j", "i", *[c.alias(n) for n, c in values.items()])
    return regrid.apply_weights(own, w, ["point"], ["j", "i"], list(values), [inp.time, "k"])


def _point_average(inp: Inputs, d: Diagnostic) -> DataFrame:
    if d.region not in inp.points:
        raise ValueError(f"{d.name} needs the point {d.region}")
    own = _at_points(inp, d, [(d.region, *inp.points[d.region])], {"v": inp.of(d.variable)}).join(F.broadcast(inp.levels), "k")  # one row per level
    return own.groupBy(inp.time).agg(wavg("v", "dz").alias("value"))


def _density_difference(inp: Inputs, d: Diagnostic) -> DataFrame:
    """Density at one point minus that at the other, at a depth, which is the pressure in dbar."""
    own = _at_points(inp, d, [("a", *d.place[0]), ("b", *d.place[1])], {"temp": inp.of("temp"), "salt": inp.of("salt")})
    key = [inp.time, "point"]
    deep = columns.at_depth(own, inp.levels, key, "temp", d.threshold).join(columns.at_depth(own, inp.levels, key, "salt", d.threshold), key)
    rho = X.density_mdjwf("temp", "salt", F.lit(abs(d.threshold)))
    pick = lambda p: F.max(F.when(F.col("point") == p, rho))
    return deep.groupBy(inp.time).agg((pick("a") - pick("b")).alias("value"))


def _transect_transport(inp: Inputs, d: Diagnostic) -> DataFrame:
    """Normal velocity times the area of each crossed cell, a cell's part of the line being the one inside it."""
    start, end, sign = d.place
    line = regrid.transect(inp.need("grid", d), start, end, *inp.size).select("j", "i", (F.col("leave") - F.col("enter")).alias("_part"))
    mean = math.radians((start[1] + end[1]) / 2)
    metres = K.EARTH_RADIUS * math.hypot(math.cos(mean) * math.radians(end[0] - start[0]), math.radians(end[1] - start[1]))
    length = math.hypot(end[0] - start[0], end[1] - start[1])
    normal, _ = X.rotate(inp.of("u"), inp.of("v"), *start, *end)
    own = inp.cells.join(line, ["j", "i"]).join(F.broadcast(inp.levels.select("k", "dz")), "k")  # one row per level
    return own.groupBy(inp.time).agg((sign * 1e-6 * F.sum(normal * F.col("_part") * (metres / length) * F.col("dz"))).alias("value"))


def _gyre_transport(inp: Inputs, d: Diagnostic) -> DataFrame:
    """The most negative stream function inside the region, from the south on, as a positive number."""
    across = inp.cells.join(F.broadcast(inp.levels.select("k", "dz")), "k").groupBy(inp.time, "j", "i").agg(F.sum(inp.of("u") * F.col("dz")).alias("_u"))
    psi = stencil.running_integral(across, "_u", [inp.time, "i"], "j", K.EARTH_RADIUS * math.radians(inp.size[1]), "_psi")
    return psi.join(inp.mask([d]), ["j", "i"]).groupBy(inp.time).agg((-1e-6 * F.min("_psi")).alias("value"))


def _residence_time(inp: Inputs, d: Diagnostic) -> DataFrame:
    """Volume of a cavity over the mean of its stream function by area, in years."""
    own, area = inp.cells.join(inp.mask([d]), ["j", "i"]), inp.need("surface", d).select(inp.time, "j", "i", F.col(inp.area).alias("_area"))
    column = own.groupBy(inp.time, "j", "i").agg(F.sum(inp.of("streamfunction")).alias("_psi"), F.sum(inp.volume).alias("_volume"))
    return column.join(area, [inp.time, "j", "i"]).groupBy(inp.time).agg((F.sum("_volume") / wavg("_psi", "_area") / K.SECONDS_PER_YEAR).alias("value"))


def _volume(inp: Inputs, d: Diagnostic) -> DataFrame:
    """Volume of all cells and of what the surface height adds."""
    still = inp.cells.groupBy(inp.time).agg(F.sum(inp.volume).alias("_still"))
    moved = inp.need("surface", d).groupBy(inp.time).agg(F.sum(inp.of(d.variable) * F.col(inp.area)).alias("_moved"))
    return still.join(moved, inp.time).select(inp.time, (F.col("_still") + F.col("_moved")).alias("value"))


_GROUPS: tuple[tuple[tuple[str, ...], Callable], ...] = (
    (CELLS, _cells), (SURFACE, _surface), (COLUMNS, _columns), (("inflow", "inflow_down", "inflow_boundary"), _fluxes),
)
_SINGLE: dict[str, Callable[[Inputs, Diagnostic], DataFrame]] = {
    "point_average": _point_average, "density_difference": _density_difference, "transect_transport": _transect_transport,
    "gyre_transport": _gyre_transport, "residence_time": _residence_time, "volume": _volume,
}


def run(inp: Inputs, names: list[str]) -> DataFrame:
    """(time, name, value) of the named diagnostics, scaled; times where a diagnostic has no value have no row.

    A mass balance gives two names, ``<name>_melt`` and ``<name>_freeze``.
    """
    specs = [parse(n) for n in dict.fromkeys(names)]
    parts: list[DataFrame] = []
    for kernels, fn in _GROUPS:
        if mine := [d for d in specs if d.kernel in kernels]:
            parts += fn(inp, mine)
    for d in specs:
        if d.kernel in _SINGLE:
            parts.append(_SINGLE[d.kernel](inp, d).select(inp.time, F.lit(d.name).alias("name"), "value"))
        elif not any(d.kernel in kernels for kernels, _ in _GROUPS):
            raise ValueError(f"{d.name} has an unknown kernel {d.kernel}")
    if not parts:
        raise ValueError("no names")
    scales = {n: (d.factor, d.offset) for d in specs for n in ((f"{d.name}_melt", f"{d.name}_freeze") if d.kernel == "melt_balance" else (d.name,))}
    of = lambda k: F.create_map(*[F.lit(x) for n, s in scales.items() for x in (n, float(s[k]))])[F.col("name")]
    return reduce(DataFrame.unionByName, parts).where("value IS NOT NULL").select(inp.time, "name", (F.col("value") * of(0) + of(1)).alias("value"))


#: What adds up over the cells of a time, whichever files and batches they come in.
ADDING = ("average", "integral", "max", "min", "share", "front_max", "water_mass")


def partial_sums(inp: Inputs, names: list[str]) -> DataFrame:
    """(time, name, part, whole, high, low): what some cells add to the named diagnostics.

    Sums of ``part`` and ``whole``, the greatest ``high`` and the least ``low``
    over all cells give the diagnostics by :func:`from_sums`. Kernels that need
    a whole column, a neighbour, a point or a line do not add up: an error.
    """
    specs = [parse(n) for n in dict.fromkeys(names)]
    if bad := [d.name for d in specs if d.kernel not in ADDING]:
        raise ValueError(f"{bad} do not add up over cells")
    own, sums = inp.cells.join(F.broadcast(inp.levels), "k").join(inp.mask(specs), ["j", "i"]), []  # one row per level
    for n, d in enumerate(specs):
        here = (F.col("region") == inp.region(d)) & F.col("z").between(d.deep, d.shallow)
        x, w = F.when(here, inp.of(d.variable)), F.when(here, F.col(inp.volume))
        share = {"share": lambda: F.when(x >= d.threshold, w).otherwise(F.when(x.isNotNull(), 0.0)), "water_mass": lambda: F.when(inp.in_mass(d), w).otherwise(0.0)}.get(d.kernel, lambda: x * w)()  # noqa: B023
        whole = w if d.kernel == "water_mass" else F.when(x.isNotNull(), w)
        sums += [F.sum(share).alias(f"p{n}"), F.sum(whole).alias(f"w{n}"), F.max(x).alias(f"h{n}"), F.min(x).alias(f"l{n}")]
    wide = own.groupBy(inp.time).agg(*sums)
    rows = [F.struct(F.lit(d.name).alias("name"), *[F.col(f"{c}{n}").cast("double").alias(name) for c, name in (("p", "part"), ("w", "whole"), ("h", "high"), ("l", "low"))]) for n, d in enumerate(specs)]
    return wide.select(inp.time, F.explode(F.array(*rows)).alias("_r")).select(inp.time, "_r.*")


def from_sums(sums: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, name, value) from added-up :func:`partial_sums`."""
    specs, value = [parse(n) for n in dict.fromkeys(names)], None
    kinds = {"integral": F.col("part"), "max": F.col("high"), "front_max": F.col("high"), "min": F.col("low"), "share": 100.0 * F.col("part") / F.col("whole"), "water_mass": 100.0 * F.col("part") / F.col("whole")}
    for d in specs:
        own = kinds.get(d.kernel, F.col("part") / F.col("whole")) * d.factor + d.offset
        value = F.when(F.col("name") == d.name, own) if value is None else value.when(F.col("name") == d.name, own)
    return sums.select(*keys, "name", value.alias("value")).where("value IS NOT NULL")


def compute(field: DataFrame, masks: DataFrame, levels: DataFrame, names: list[str], time: str = "t", weight: str = "w", variables: dict[str, str | Column] | None = None, **more) -> DataFrame:
    """:func:`run` over a field alone, or with the further :class:`Inputs` that a name asks for."""
    return run(Inputs(field, masks, levels, time=time, volume=weight, variables=variables or {}, **more), names)
