"""The query of all named diagnostics; its SQL states names, units and factors by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import regions
from strataframe.plans import diagnostics
from strataframe.plans.core import query
from strataframe.plans.cuts import cutter
from strataframe.plans.spaces import _HIT
from strataframe.sources import views as V

#: Columns of the views that play the catalogue's variables of cells and of surfaces.
CELLS = {
    "temp": "x * 0.4 - 2", "salt": "34 + y / 8", "density": "1027 + x / 10", "age": "y", "u": "x - 5", "v": "y - 4", "streamfunction": "x + 1", "salt_tendency": "x - 5",
    "salt_advection_x": "x - 5", "salt_advection_y": "y - 4", "salt_diffusion_x": "y - 4", "salt_diffusion_y": "x - 5", "heat_advection_x": "x - 3", "heat_advection_y": "y - 5",
    "heat_advection_down": "x - 5", "heat_diffusion": "y - 4", "heat_mixing": "x - y", "heat_advection_north": "y - 4",
}
SURFACE = {
    "melt": "x - 5", "air_temp": "250 + x", "wind": "y", "wind_u": "x - 5", "wind_v": "y - 4", "humidity": "y / 1000", "precipitation": "x * 1e-9", "ice_thickness": "y", "ice_production": "x - 3",
    "ice_melt": "x", "ice_freeze": "-y", "rain_less_evaporation": "x - y", "fresh_water": "x - 5", "heat": "y - 4", "salt_flux": "x - 5", "salt_correction": "y - 4", "friction_velocity": "y / 1000",
    "thermal_driving": "x - 5", "ice_area": "y / 8", "surface_height": "x - 5", "mixed_layer": "x * 400", "shortwave": "x",
}

#: What each name is, by hand: name, units, aggregate, rows. ``f`` are cells with ``z`` and variables, ``s`` surfaces, ``m`` masks.
EXPECTED = (
    ("west_mass_balance_melt", "Gt/y", "sum(greatest(melt, 0) * a) * 917 / 1e12", "s JOIN m USING (j, i) WHERE region = 'west_cavity'"),
    ("west_mass_balance_freeze", "Gt/y", "sum(least(melt, 0) * a) * 917 / 1e12", "s JOIN m USING (j, i) WHERE region = 'west_cavity'"),
    ("west_massloss", "Gt/y", "sum(melt * a) * 917 / 1e12", "s JOIN m USING (j, i) WHERE region = 'west_cavity'"),
    ("all_melting", "m/y", "sum(melt * a) / sum(a)", "s"),
    ("east_massloss_btw_20_60m", "Gt/y", "sum(melt * a) * 917 / 1e12", "s JOIN m USING (j, i) JOIN grid USING (j, i) WHERE region = 'east_cavity' AND draft > -60 AND draft <= -20"),
    ("east_melting_btw_0_60m", "m/y", "sum(melt * a) / sum(a)", "s JOIN m USING (j, i) JOIN grid USING (j, i) WHERE region = 'east_cavity' AND draft > -60 AND draft <= 0"),
    ("east_mass_balance_btw_20_60m_melt", "Gt/y", "sum(greatest(melt, 0) * a) * 917 / 1e12", "s JOIN m USING (j, i) JOIN grid USING (j, i) WHERE region = 'east_cavity' AND draft > -60 AND draft <= -20"),
    ("east_mass_balance_btw_20_60m_freeze", "Gt/y", "sum(least(melt, 0) * a) * 917 / 1e12", "s JOIN m USING (j, i) JOIN grid USING (j, i) WHERE region = 'east_cavity' AND draft > -60 AND draft <= -20"),
    ("west_temp", "degC", "sum(temp * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'west'"),
    ("avg_temp", "degC", "sum(temp * w) / sum(w)", "f"),
    ("middle_salt", "psu", "sum(salt * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'middle'"),
    ("east_density", "kg/m3", "sum(density * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'east'"),
    ("west_cavity_age", "years", "sum(age * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'west_cavity'"),
    ("middle_tminustf", "degC", "sum((temp - (-0.0575 * salt + 0.0901)) * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'middle'"),
    ("west_temp_bottom", "degC", "sum(v * a) / sum(a)", "(SELECT t, j, i, max_by(temp, k) AS v FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'west'"),
    ("east_salt_bottom", "psu", "sum(v * a) / sum(a)", "(SELECT t, j, i, max_by(salt, k) AS v FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'east'"),
    ("east_density_bottom", "kg/m3", "sum(v * a) / sum(a)", "(SELECT t, j, i, max_by(density, k) AS v FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'east'"),
    ("west_density_100m", "kg/m3", "sum(v * a) / sum(a)", "(SELECT u.t, u.j, u.i, (u.density + d.density) / 2 AS v FROM f u JOIN f d ON d.t = u.t AND d.j = u.j AND d.i = u.i AND u.k = 2 AND d.k = 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'west'"),
    ("hice_max", "m", "max(ice_thickness)", "s"),
    ("mld_ewed", "m", "max(mixed_layer)", "s JOIN grid USING (j, i) WHERE lon BETWEEN -30 AND 30 AND lat BETWEEN -69 AND -60"),
    ("eta_avg", "m", "sum(surface_height * a) / sum(a)", "s"),
    ("seaice_area", "million km2", "sum(ice_area * a) * 1e-12", "s"),
    ("east_seaice_area", "million km2", "sum(ice_area * a) * 1e-12", "s JOIN m USING (j, i) WHERE region = 'east'"),
    ("temp_polynya", "degC", "avg(v)", "(SELECT t, k, sum(temp * b) AS v FROM f JOIN polynya USING (j, i) GROUP BY 1, 2 HAVING count(*) = 4) WHERE true"),
    ("salt_polynya", "psu", "avg(v)", "(SELECT t, k, sum(salt * b) AS v FROM f JOIN polynya USING (j, i) GROUP BY 1, 2 HAVING count(*) = 4) WHERE true"),
    ("conv_area", "million km2", "sum(CASE WHEN mixed_layer >= 2000 THEN a ELSE 0 END) * 1e-12", "s"),
    ("wed_gyre_trans", "Sv", "-min(psi) * 1e-6", "(SELECT t, j, i, sum(u) OVER (PARTITION BY t, i ORDER BY j) * 6.371e6 * radians(2) AS psi FROM (SELECT t, j, i, sum(u * 50) AS u FROM f GROUP BY 1, 2, 3)) JOIN m USING (j, i) WHERE region = 'middle'"),
    ("isw_vol", "% of domain", "100 * sum(CASE WHEN temp <= -1.9 THEN w ELSE 0 END) / sum(w)", "f"),
    ("hssw_vol", "% of domain", "100 * sum(CASE WHEN temp BETWEEN -1.9 AND -1.8 AND salt >= 34.55 THEN w ELSE 0 END) / sum(w)", "f"),
    ("wdw_vol", "% of domain", "100 * sum(CASE WHEN temp >= 0 THEN w ELSE 0 END) / sum(w)", "f"),
    ("mwdw_vol", "% of domain", "100 * sum(CASE WHEN temp BETWEEN -1.5 AND 0 AND salt BETWEEN 34.25 AND 34.55 THEN w ELSE 0 END) / sum(w)", "f"),
    ("ocean_vol", "m3", "sum(v)", "(SELECT t, sum(w) AS v FROM f GROUP BY 1 UNION ALL SELECT t, sum(surface_height * a) FROM s GROUP BY 1) WHERE true"),
    ("filchner_trans", "Sv", "-sum((v * cos(alpha) - u * sin(alpha)) * metres * 50) * 1e-6", "f, (SELECT atan2(radians(-0.15), cos(radians(-78.125)) * radians(10.2)) AS alpha, 6.371e6 * sqrt(pow(cos(radians(-78.125)) * radians(10.2), 2) + pow(radians(0.15), 2)) AS metres) WHERE i = 8 AND j = 1"),
    ("PITE_trans", "Sv", "-sum(v * 6.371e6 * cos(radians(73)) * radians(2) * 50) * 1e-6", "f WHERE i = 4 AND j = 4"),
    ("atemp_avg", "degC", "sum(air_temp * a) / sum(a) - 273.15", "s"),
    ("west_atemp_avg", "degC", "sum(air_temp * a) / sum(a) - 273.15", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_wind_avg", "m/s", "sum(wind * a) / sum(a)", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_uwind_avg", "m/s", "sum(wind_u * a) / sum(a)", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_vwind_avg", "m/s", "sum(wind_v * a) / sum(a)", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_aqh_avg", "1e-3 kg/kg", "sum(humidity * a) / sum(a) * 1e3", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_precip_avg", "1e-9 m/s", "sum(precipitation * a) / sum(a) * 1e9", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("middle_sst_avg", "degC", "sum(v * a) / sum(a)", "(SELECT t, j, i, min_by(temp, k) AS v FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_sss_avg", "psu", "sum(v * a) / sum(a)", "(SELECT t, j, i, min_by(salt, k) AS v FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_hice_avg", "m", "sum(ice_thickness * a) / sum(a)", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_iceprod", "1e3 m3/s", "sum(ice_production * a) * 1e-3", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_iceshelf_area", "1e3 km2", "sum(a) * 1e-9", "s JOIN m USING (j, i) WHERE region = 'middle_cavity'"),
    ("middle_seaice_melt", "1e3 m3/s", "sum(ice_melt * a) * 1e-6", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_seaice_freeze", "1e3 m3/s", "sum(ice_freeze * a) * 1e-6", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_pmepr", "1e3 m3/s", "sum(rain_less_evaporation * a) * 1e-6", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_fwflx", "1e3 m3/s", "sum(fresh_water * a) * 1e-6", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("middle_heatflx", "W", "sum(heat * a)", "s JOIN m USING (j, i) WHERE region = 'middle'"),
    ("east_salt_adv", "psu m3/s", "sum(d_salt)", "d JOIN m USING (j, i) WHERE region = 'east'"),
    ("east_salt_dif", "psu m3/s", "sum(d_diffusion)", "d JOIN m USING (j, i) WHERE region = 'east'"),
    ("east_salt_adv_icefront", "psu m3/s", "sum(CASE side WHEN 'w' THEN u WHEN 'e' THEN -ue WHEN 's' THEN v ELSE -vn END)", "d JOIN faces USING (j, i) WHERE region = 'east' AND boundary = 'icefront'"),
    ("west_salt_adv_upstream", "psu m3/s", "sum(CASE side WHEN 'w' THEN u WHEN 'e' THEN -ue WHEN 's' THEN v ELSE -vn END)", "d JOIN faces USING (j, i) WHERE region = 'west' AND boundary = 'upstream'"),
    ("west_salt_dif_downstream", "psu m3/s", "sum(CASE side WHEN 'w' THEN v WHEN 'e' THEN -ve WHEN 's' THEN u ELSE -un END)", "d JOIN faces USING (j, i) WHERE region = 'west' AND boundary = 'downstream'"),
    ("middle_salt_dif_openocean", "psu m3/s", "sum(CASE side WHEN 'w' THEN v WHEN 'e' THEN -ve WHEN 's' THEN u ELSE -un END)", "d JOIN faces USING (j, i) WHERE region = 'middle' AND boundary = 'openocean'"),
    ("west_salt_sfc", "psu m3/s", "sum(salt_flux * a) / 1028.5", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_salt_sfc_corr", "psu m3/s", "-sum(salt_correction * a)", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_salt_tend", "psu m3/s", "sum(salt_tendency * w) / 86400", "f JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_res_time", "y", "sum(volume) / (sum(psi * a) / sum(a)) / (365.25 * 86400)", "(SELECT t, j, i, sum(w) AS volume, sum(streamfunction) AS psi FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'west_cavity'"),
    ("west_mean_psi", "Sv", "sum(psi * a) / sum(a) * 1e-6", "(SELECT t, j, i, abs(sum(streamfunction)) AS psi FROM f GROUP BY 1, 2, 3) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_max_psi", "Sv", "max(psi) * 1e-6", "(SELECT t, j, i, abs(sum(streamfunction)) AS psi FROM f GROUP BY 1, 2, 3) JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_ustar", "m/s", "sum(friction_velocity * a) / sum(a)", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("west_thermal_driving", "degC", "sum(thermal_driving * a) / sum(a)", "s JOIN m USING (j, i) WHERE region = 'west'"),
    ("ft_sill_delta_rho", "kg/m3", "max(rho) FILTER (point = 'c') - max(rho) FILTER (point = 'd')", "deep WHERE true"),
    ("ronne_delta_rho", "kg/m3", "max(rho) FILTER (point = 'a') - max(rho) FILTER (point = 'b')", "deep WHERE true"),
    ("east_front_tmax", "degC", "max(temp)", "f JOIN m USING (j, i) WHERE region = 'east_front'"),
    ("middle_temp_below_100m", "degC", "sum(temp * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'middle' AND z <= -100"),
    ("middle_temp_btw_50_200m", "degC", "sum(temp * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'middle' AND z BETWEEN -200 AND -50"),
    ("east_salt_below_100m", "psu", "sum(salt * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'east' AND z <= -100"),
    ("east_salt_btw_50_200m", "psu", "sum(salt * w) / sum(w)", "f JOIN m USING (j, i) WHERE region = 'east' AND z BETWEEN -200 AND -50"),
    ("west_thermocline", "m", "sum(v * a) / sum(a)", "(SELECT t, j, i, z AS v FROM (SELECT *, (temp - lag(temp) OVER c) / (lag(z) OVER c - z) AS g FROM f WINDOW c AS (PARTITION BY t, j, i ORDER BY k)) WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, j, i ORDER BY g DESC, k) = 1) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'west'"),
    ("east_isotherm_-0.5C", "m", "sum(v * a) / sum(a)", "(SELECT t, j, i, CASE WHEN mx < -0.5 THEN low WHEN mn > -0.5 THEN NULL ELSE crossing END AS v FROM (SELECT t, j, i, arg_min((z - zn) / (temp - n) * (-0.5 - temp) + z, k) FILTER ((temp < -0.5 AND n >= -0.5) OR (temp >= -0.5 AND n < -0.5)) AS crossing, min(z) AS low, max(temp) AS mx, min(temp) AS mn FROM (SELECT *, lead(temp) OVER c AS n, lead(z) OVER c AS zn FROM f WINDOW c AS (PARTITION BY t, j, i ORDER BY k)) GROUP BY 1, 2, 3)) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'east' AND v IS NOT NULL"),
    ("east_isotherm_-0.5C_below_100m", "m", "sum(v * a) / sum(a)", "(SELECT t, j, i, CASE WHEN low > -100 THEN NULL WHEN mx < -0.5 THEN low WHEN mn > -0.5 THEN NULL ELSE crossing END AS v FROM (SELECT t, j, i, arg_min((z - zn) / (temp - n) * (-0.5 - temp) + z, k) FILTER (z <= -100 AND ((temp < -0.5 AND n >= -0.5) OR (temp >= -0.5 AND n < -0.5))) AS crossing, min(z) AS low, max(temp) FILTER (z <= -100) AS mx, min(temp) FILTER (z <= -100) AS mn FROM (SELECT *, lead(temp) OVER c AS n, lead(z) OVER c AS zn FROM f WINDOW c AS (PARTITION BY t, j, i ORDER BY k)) GROUP BY 1, 2, 3)) JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'east' AND v IS NOT NULL"),
    ("east_adv_heat_ns_50_200m", "degC m3/s", "sum(heat_advection_north * w)", "f JOIN m USING (j, i) WHERE region = 'east' AND z BETWEEN -200 AND -50"),
    ("east_dohc_adv_below_100m", "GJ/s", "sum(d_heat) * 1e-9 * 4180 * 1028.5", "d JOIN m USING (j, i) WHERE region = 'east' AND z <= -100"),
    ("east_ohc_below_100m", "GJ", "sum((temp + 273.15) * w) * 1e-9 * 4180 * 1028.5", "f JOIN m USING (j, i) WHERE region = 'east' AND z <= -100"),
    ("middle_advection_heat_xy_below_50m", "GJ/s", "sum(d_heat) * 1e-9 * 4180 * 1028.5", "d JOIN m USING (j, i) WHERE region = 'middle' AND z <= -50"),
    ("middle_advection_heat_z_below_50m", "GJ/s", "sum(CASE WHEN k = 7 THEN 0 ELSE coalesce(below_u, 0) - u END) * 1e-9 * 4180 * 1028.5", "d JOIN m USING (j, i) WHERE region = 'middle' AND z <= -50"),
    ("middle_diffusion_heat_implicit_z_below_50m", "GJ/s", "sum(CASE WHEN k = 7 THEN 0 ELSE coalesce(below_v, 0) - v END) * 1e-9 * 4180 * 1028.5", "d JOIN m USING (j, i) WHERE region = 'middle' AND z <= -50"),
    ("middle_kpp_heat_z_below_50m", "GJ/s", "sum(CASE WHEN k = 7 THEN 0 ELSE coalesce(below_mix, 0) - mix END) * 1e-9 * 4180 * 1028.5", "d JOIN m USING (j, i) WHERE region = 'middle' AND z <= -50"),
    ("west_shortwave_penetration_below_50m", "GJ/s", "sum(shortwave * a * ((0.62 * exp(z_top / 0.6) + 0.38 * exp(z_top / 20)) - (0.62 * exp(z_bot / 0.6) + 0.38 * exp(z_bot / 20)))) * 1e-9", "f JOIN s USING (t, j, i) JOIN m USING (j, i) WHERE region = 'west' AND z <= -50"),
)

#: The ratio of polynomials of McDougall and others (2003), written out for the level of 600 dbar.
_RHO = """(9.99843699e2 + temp * (7.35212840 + temp * (-5.45928211e-2 + 3.98476704e-4 * temp)) + salt * (2.96938239 - 7.23268813e-3 * temp + 2.12382341e-3 * salt)
 + 600 * (1.04004591e-2 + 1.03970529e-7 * temp * temp + 5.18761880e-6 * salt + 600 * (-3.24041825e-8 - 1.23869360e-11 * temp * temp)))
 / (1 + temp * (7.28606739e-3 + temp * (-4.60835542e-5 + temp * (3.68390573e-7 + 1.80809186e-10 * temp))) + salt * (2.14691708e-3 - temp * (9.27062484e-6 + 1.78343643e-10 * temp * temp)
 + sqrt(salt) * (4.76534122e-6 + 1.63410736e-9 * temp * temp)) + 600 * (5.30848875e-6 + 600 * temp * (-3.03175128e-16 * temp * temp - 1.27934137e-17 * 600)))"""


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


_SQL = f"""{_HIT}, f AS (SELECT t, k, j, i, w, z, z_top, z_bot, {_listed(CELLS)} FROM cells JOIN levels USING (k)),
s AS (SELECT t, j, i, w AS a, {_listed(SURFACE)} FROM cells_xy),
bound AS (SELECT name AS region, min(bathy_deep) AS deep, max(bathy_shallow) AS shallow, max(xmax) AS east, max(ymax) AS north FROM regions GROUP BY 1),
side(side, dj, di) AS (VALUES ('w', 0, -1), ('e', 0, 1), ('s', -1, 0), ('n', 1, 0)),
wet AS (SELECT region, j, i, is_ice FROM hit JOIN grid USING (j, i) JOIN bound USING (region) WHERE NOT is_land AND bathy BETWEEN deep AND shallow),
near AS (SELECT g.j, g.i, side, n.j AS nj, n.i AS ni, n.is_ice, n.is_land, n.bathy, n.lon, n.lat FROM grid g, side JOIN grid n ON n.j = least(greatest(g.j + dj, 0), 9) AND n.i = least(greatest(g.i + di, 0), 19)),
m AS (SELECT region, j, i FROM wet WHERE NOT is_ice UNION ALL SELECT region || '_cavity', j, i FROM wet WHERE is_ice
  UNION ALL SELECT region || '_front', j, i FROM wet WHERE is_ice AND EXISTS (SELECT 1 FROM near WHERE near.j = wet.j AND near.i = wet.i AND NOT near.is_ice AND NOT near.is_land)),
border AS (SELECT region, wet.j, wet.i, CASE WHEN bool_or(near.is_ice OR near.is_land) THEN 'icefront' WHEN bool_or(bathy < deep) THEN 'openocean' WHEN bool_or(lon >= east) THEN 'upstream' WHEN bool_or(lat >= north) THEN 'downstream' END AS boundary
  FROM wet JOIN bound USING (region) JOIN near ON near.j = wet.j AND near.i = wet.i WHERE NOT wet.is_ice GROUP BY 1, 2, 3),
faces AS (SELECT border.*, side FROM border, side JOIN grid n ON n.j = border.j + dj AND n.i = border.i + di WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.region = border.region AND m.j = n.j AND m.i = n.i)),
q AS (SELECT t, k, j, i, z, x, y, x - 5 AS u, y - 4 AS v, x - y AS mix FROM cells JOIN levels USING (k)),
d AS (SELECT c.t, c.k, c.j, c.i, c.z, c.x AS x0, c.u, c.v, c.mix, coalesce(e.u, 0) AS ue, coalesce(n.v, 0) AS vn, coalesce(e.v, 0) AS ve, coalesce(n.u, 0) AS un, b.u AS below_u, b.v AS below_v, b.mix AS below_mix,
  CASE WHEN e.t IS NULL OR n.t IS NULL THEN 0 ELSE c.u - e.u + c.v - n.v END AS d_salt, CASE WHEN e.t IS NULL OR n.t IS NULL THEN 0 ELSE c.v - e.v + c.u - n.u END AS d_diffusion,
  CASE WHEN e.t IS NULL OR n.t IS NULL THEN 0 ELSE c.x - e.x + c.y - n.y END AS d_heat
  FROM q c LEFT JOIN q e ON e.t = c.t AND e.k = c.k AND e.j = c.j AND e.i = c.i + 1 LEFT JOIN q n ON n.t = c.t AND n.k = c.k AND n.i = c.i AND n.j = c.j + 1 LEFT JOIN q b ON b.t = c.t AND b.j = c.j AND b.i = c.i AND b.k = c.k + 1),
polynya(j, i, b) AS (VALUES (5, 10, 4.0::DOUBLE / 9 * 0.75), (5, 11, 5.0::DOUBLE / 9 * 0.75), (6, 10, 4.0::DOUBLE / 9 * 0.25), (6, 11, 5.0::DOUBLE / 9 * 0.25)),
corner(point, j, i, b) AS (VALUES ('a', 2, 6, (1 - 12.0::DOUBLE / 18) * 0.375), ('a', 2, 7, 12.0::DOUBLE / 18 * 0.375), ('a', 3, 6, (1 - 12.0::DOUBLE / 18) * 0.625), ('a', 3, 7, 12.0::DOUBLE / 18 * 0.625),
  ('b', 1, 6, (1 - 2.0::DOUBLE / 18)), ('b', 1, 7, 2.0::DOUBLE / 18),
  ('c', 2, 8, (1 - 4.0::DOUBLE / 18) * 0.5), ('c', 2, 9, 4.0::DOUBLE / 18 * 0.5), ('c', 3, 8, (1 - 4.0::DOUBLE / 18) * 0.5), ('c', 3, 9, 4.0::DOUBLE / 18 * 0.5), ('d', 3, 8, (1 - 4.0::DOUBLE / 18)), ('d', 3, 9, 4.0::DOUBLE / 18)),
deep AS (SELECT t, point, {_RHO} AS rho FROM (SELECT t, point, sum(temp * b) AS temp, sum(salt * b) AS salt FROM f JOIN corner USING (j, i) WHERE k = 7 GROUP BY 1, 2 HAVING count(*) = CASE WHEN point IN ('a', 'c') THEN 4 ELSE 2 END)),
every AS ({" UNION ALL ".join(f"SELECT '{name}' AS name, '{units}' AS units, t, {value} AS v FROM {rows} GROUP BY t" for name, units, value, rows in EXPECTED)}),
mean AS (SELECT name, units, count(*) AS n, avg(v) AS v FROM every WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT name, units, n, CASE WHEN abs(v) < 1e-30 THEN 0 ELSE CAST(floor(log10(abs(v)) + 1e-9) AS INT) END AS power, CASE WHEN abs(v) < 1e-30 THEN 0.0 ELSE round(v / pow(10, floor(log10(abs(v)) + 1e-9)), 6) END AS digits FROM mean"""


@query(_SQL)
def u1_name_patterns(spark, sf):
    """Names of all patterns, computed together: means over time of the scaled values, as digits and a power of ten."""
    cut = cutter(spark)  # fields and masks stand in tables, as they do where they are not made up of others
    grid, boxes = cut(V.grid_xy(spark, sf)), V.regions(spark)
    masks = regions.named_masks(grid, boxes)
    masks = cut(masks.unionByName(masks.where("region = 'middle'").withColumn("region", F.lit("wed_gyre"))))
    cells = cut(V.cells(spark, sf).select("t", "k", "j", "i", "w", *[F.expr(sql).alias(name) for name, sql in CELLS.items()]))
    surface = cut(V.cells_xy(spark, sf).select("t", "j", "i", "w", *[F.expr(sql).alias(name) for name, sql in SURFACE.items()]))
    asked = [name.removesuffix("_freeze") if "mass_balance" in name else name for name, *_ in EXPECTED]
    asked = [name.removesuffix("_melt") if "mass_balance" in name else name for name in asked]
    inp = diagnostics.Inputs(
        cells, masks, cut(V.levels(spark, sf)), surface, grid, cut(regions.region_boundaries(grid, boxes)), points={"polynya": (10.0, -69.5)}, size=(18.0, 2.0),
    )
    values = diagnostics.run(inp, [*asked, "hice_corner"])
    unit = {n: d.units for d in map(diagnostics.parse, asked) for n in ((f"{d.name}_melt", f"{d.name}_freeze") if d.kernel == "melt_balance" else (d.name,))}
    units = F.create_map(*[F.lit(x) for pair in unit.items() for x in pair])[F.col("name")]
    mean = values.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    power = F.floor(F.log10(F.abs("v")) + 1e-9)
    tiny = F.abs("v") < 1e-30
    return mean.select("name", units.alias("units"), "n", F.when(tiny, 0).otherwise(power).cast("int").alias("power"), F.when(tiny, 0.0).otherwise(F.round(F.col("v") / F.pow(F.lit(10.0), power), 6)).alias("digits"))
