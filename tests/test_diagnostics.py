"""Named diagnostics: parameters of names, and closed forms on a small dense field."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataframe.operators import regions
from strataframe.plans import diagnostics
from strataframe.plans.diagnostics import parse

T = dt.date(2000, 1, 1)


@pytest.mark.parametrize(
    ("name", "kernel", "region", "variable", "factor", "offset", "units"),
    [
        ("shelf_massloss", "melt_integral", "shelf", "melt", 917e-12, 0.0, "Gt/y"), ("sea_temp_bottom", "bottom_average", "sea", "temp", 1.0, 0.0, "degC"),
        ("avg_salt", "average", "all", "salt", 1.0, 0.0, "psu"), ("west_atemp_avg", "surface_average", "west", "air_temp", 1.0, -273.15, "degC"),
        ("sea_ohc_below_300m", "integral", "sea", "kelvin", 1e-9 * 4180 * 1028.5, 0.0, "GJ"), ("sea_dohc_adv_below_300m", "inflow", "sea", "heat_advection", 1e-9 * 4180 * 1028.5, 0.0, "GJ/s"),
        ("sea_kpp_heat_z_below_5m", "inflow_down", "sea", "heat_mixing", 1e-9 * 4180 * 1028.5, 0.0, "GJ/s"), ("sea_adv_heat_ns_5_10m", "integral", "sea", "heat_advection_north", 1.0, 0.0, "degC m3/s"),
        ("sea_salt_adv_upstream", "inflow_boundary", "sea", "salt_advection", 1.0, 0.0, "psu m3/s"), ("sea_salt_sfc", "surface_integral", "sea", "salt_flux", 1 / 1028.5, 0.0, "psu m3/s"),
        ("sea_density_450m", "depth_average", "sea", "density", 1.0, 0.0, "kg/m3"), ("conv_area", "area_at_least", "all", "mixed_layer", 1e-12, 0.0, "million km2"),
    ],
)
def test_parameters_of_names(name, kernel, region, variable, factor, offset, units):
    d = parse(name)
    assert (d.kernel, d.region, d.variable, d.offset, d.units) == (kernel, region, variable, offset, units) and d.factor == pytest.approx(factor)


def test_depths_bounds_and_unknown_names():
    assert (parse("a_b_temp_btw_200_700m").region, parse("a_b_temp_btw_200_700m").shallow, parse("a_b_temp_btw_200_700m").deep) == ("a_b", -200, -700)
    assert parse("bay_isotherm_0.5C_below_100m").threshold == 0.5 and parse("bay_isotherm_0.5C_below_100m").shallow == -100
    assert parse("mwdw_vol").place == (-1.5, 0.0, 34.25, 34.55) and parse("conv_area").threshold == 2000
    for bad in ("temp", "no_such_thing", "west_temp_btw_5m"):
        with pytest.raises(ValueError):
            parse(bad)


@pytest.fixture(scope="module")
def inputs(spark):
    """3 levels of 10 m, 4 x 5 columns of area 2; the shelf is the first column of each row, the sea the rest."""
    at = [(k, j, i) for k in (1, 2, 3) for j in range(4) for i in range(5)]
    cells = spark.createDataFrame([(T, k, j, i, 20.0, float(k), 34.0 + i, float(i), float(j)) for k, j, i in at], "t date, k int, j int, i int, w double, temp double, salt double, heat_advection_x double, heat_advection_y double")
    surface = spark.createDataFrame([(T, j, i, 2.0, float(j - 1), 1.0) for j in range(4) for i in range(5)], "t date, j int, i int, w double, melt double, shortwave double")
    grid = spark.createDataFrame([(j, i, float(i), -70.0 + j, -30.0, -5.0 * j if i == 0 else 0.0, i == 0, False) for j in range(4) for i in range(5)], "j int, i int, lon double, lat double, bathy double, draft double, is_ice boolean, is_land boolean")
    boxes = spark.createDataFrame([("sea", 1, -1.0, 9.0, -80.0, -60.0, -100.0, 0.0, -100.0, 0.0)], "name string, part int, xmin double, xmax double, ymin double, ymax double, bathy_deep double, bathy_shallow double, z_deep double, z_shallow double")
    levels = spark.createDataFrame([(k, -10.0 * k + 5, -10.0 * (k - 1), -10.0 * k, 10.0) for k in (1, 2, 3)], "k int, z double, z_top double, z_bot double, dz double")
    return diagnostics.Inputs(cells, regions.named_masks(grid, boxes), levels, surface, grid, regions.region_boundaries(grid, boxes), period=None)


def values(inp, *names):
    return {r.name: r.value for r in diagnostics.run(inp, list(names)).collect()}


def test_closed_forms(inputs):
    heat = 1e-9 * 4180 * 1028.5
    got = values(inputs, "sea_temp", "sea_temp_below_10m", "sea_temp_bottom", "sea_ohc_below_20m", "sea_massloss", "sea_mass_balance", "all_melting", "sea_melting_btw_4_12m", "wdw_vol", "sea_dohc_adv_below_0m")
    assert got["sea_temp"] == 2 and got["sea_temp_below_10m"] == 2.5 and got["sea_temp_bottom"] == 3 and got["wdw_vol"] == 100
    assert got["sea_ohc_below_20m"] == pytest.approx(16 * 20 * (3 + 273.15) * heat)
    assert got["sea_massloss"] == pytest.approx(2 * (-1 + 0 + 1 + 2) * 917e-12)
    assert got["sea_mass_balance_melt"] == pytest.approx(2 * 3 * 917e-12) and got["sea_mass_balance_freeze"] == pytest.approx(-2 * 917e-12)
    assert got["all_melting"] == 0.5 and got["sea_melting_btw_4_12m"] == 0.5  # drafts of 5 and 10 m
    # each cell with both far faces loses 1 to the east and 1 to the north: 3 levels x 3 rows x 3 columns
    assert got["sea_dohc_adv_below_0m"] == pytest.approx(-2 * 3 * 3 * 3 * heat)


def test_a_mass_balance_is_two_names_and_missing_inputs_are_errors(inputs):
    assert set(values(inputs, "sea_mass_balance")) == {"sea_mass_balance_melt", "sea_mass_balance_freeze"}
    short = diagnostics.Inputs(inputs.cells, inputs.masks, inputs.levels)
    with pytest.raises(ValueError, match="needs surface"):
        diagnostics.run(short, ["sea_massloss"])
    with pytest.raises(ValueError, match="point"):
        diagnostics.run(inputs, ["temp_polynya"])
    assert diagnostics.run(short, ["nowhere_temp"]).count() == 0


def test_flux_through_one_boundary(inputs):
    """The sea meets the shelf in the west: its faces there carry the flux at i = 1, on 3 levels x 4 rows."""
    own = diagnostics.Inputs(**{**inputs.__dict__, "variables": {"salt_advection_x": "heat_advection_x", "salt_advection_y": "heat_advection_y"}})
    assert values(own, "sea_salt_adv_icefront")["sea_salt_adv_icefront"] == 12.0
    assert inputs.boundaries.where("boundary = 'icefront'").select("i").distinct().collect()[0].i == 1
    assert inputs.boundaries.where(F.col("boundary") != "icefront").count() == 0
