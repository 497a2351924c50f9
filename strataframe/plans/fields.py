"""Queries: scans, scalar expressions, regions, weighted aggregates, joins, depth columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import constants as K
from strataframe.functions import expr as X
from strataframe.operators import agg, columns, joins, regions
from strataframe.plans.core import query, rounded
from strataframe.plans.cuts import cutter
from strataframe.sources import views as V

# ---------------------------------------------------------------- scans


@query("SELECT k, j, i, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM cells WHERE year(t) BETWEEN 1998 AND 1999 GROUP BY k, j, i")
def a1_time_mean(spark, sf):
    """Time mean of two variables over a time range."""
    return rounded(V.cells(spark, sf).where(F.year("t").between(1998, 1999)).groupBy("k", "j", "i").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "x", "y")


@query("SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) - INTERVAL 1 MONTH AS month_before, CAST(l_shipdate AS DATE) AS day FROM lineitem", views=False)
def a3_time_axis(spark, sf):
    """Monthly stamps moved to the month before; other stamps cut to the day."""
    t = V.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return t.distinct().select(F.add_months(F.trunc("day", "MM"), -1).cast("timestamp_ntz").alias("month_before"), "day")


@query("SELECT t, round(sum(x + y + w / 100), 6) AS total, count(*) AS n FROM cells GROUP BY t")
def a4_sum_of_terms(spark, sf):
    """Several terms as one variable; null if any is."""
    c = V.cells(spark, sf).withColumn("s", F.col("x") + F.col("y") + F.col("w") / 100)
    return rounded(c.groupBy("t").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("n")), "total")


@query("SELECT expt, member, t, v2 FROM (SELECT *, row_number() OVER (PARTITION BY expt, member ORDER BY t) AS n FROM series) WHERE n BETWEEN 13 AND 24")
def a6_time_index(spark, sf):
    """Rows by their global time index within a run."""
    from pyspark.sql import Window

    s = V.series(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("expt", "member").orderBy("t")))
    return s.where(F.col("n").between(13, 24)).select("expt", "member", "t", "v2")


@query("SELECT expt, member, y AS last_year, n AS next_year FROM (SELECT expt, member, y, lead(y) OVER (PARTITION BY expt, member ORDER BY y) AS n FROM (SELECT DISTINCT expt, member, year(t) AS y FROM series WHERE v2 > 2)) WHERE n <> y + 1")
def a7_missing_years(spark, sf):
    """Gaps in the years that a run has."""
    from pyspark.sql import Window

    y = V.series(spark, sf).where("v2 > 2").select("expt", "member", F.year("t").alias("last_year")).distinct()
    out = y.withColumn("next_year", F.lead("last_year").over(Window.partitionBy("expt", "member").orderBy("last_year")))
    return out.where(F.col("next_year") != F.col("last_year") + 1)


# ---------------------------------------------------------------- scalar expressions


@query("SELECT j, i, CASE WHEN lon * 3 >= 180 THEN lon * 3 - 360 WHEN lon * 3 < -180 THEN lon * 3 + 360 ELSE lon * 3 END AS lon3 FROM grid")
def b1_wrap_longitude(spark, sf):
    return V.grid_xy(spark, sf).select("j", "i", X.wrap_lon(F.col("lon") * 3).alias("lon3"))


@query("""SELECT t, round(sum(-(x - 5) * 1e-6 / 1000.0 * 365.25 * 86400.0 * w) / sum(w), 6) AS melt FROM cells_xy GROUP BY t""")
def b2_melt_rate(spark, sf):
    c = V.cells_xy(spark, sf).withColumn("melt", X.melt_rate((F.col("x") - 5) * 1e-6))
    return rounded(agg.over(c, ["t"], "melt", "w"), "melt")


@query("""
, p AS (SELECT j, i, radians(-lon) AS lam, radians(-lat) AS phi, radians(71.0) AS c, 0.08181919 AS e FROM grid WHERE lat > -89.9),
q AS (SELECT *, tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) AS t,
             tan(pi() / 4 - c / 2) / pow((1 - e * sin(c)) / (1 + e * sin(c)), e / 2) AS tc, cos(c) / sqrt(1 - pow(e * sin(c), 2)) AS mc FROM p)
SELECT j, i, round(-6378137.0 * mc * t / tc * sin(lam), 3) + 0.0 AS x, round(6378137.0 * mc * t / tc * cos(lam), 3) AS y,
       round(degrees(-lam), 6) AS lon, round(degrees(-phi), 6) AS lat FROM q
""")
def b3_polar_stereographic(spark, sf):
    """Forward, and back again: the inverse must give the grid's own coordinates."""
    x, y = X.polar_stereographic("lon", "lat")
    out = V.grid_xy(spark, sf).where("lat > -89.9").select("j", "i", x.alias("x"), y.alias("y"))
    lon, lat = X.polar_stereographic_inverse("x", "y")
    # the date line has two names
    out = out.select("j", "i", "x", "y", F.when(F.round(lon, 9) == 180, -180.0).otherwise(lon).alias("lon"), lat.alias("lat"))
    return rounded(rounded(out, "x", "y", n=3), "lon", "lat")


@query("""SELECT a.j, a.i, round(sqrt(pow(6.371e6 * cos(radians((a.lat + b.lat) / 2)) * radians(b.lon - a.lon), 2) + pow(6.371e6 * radians(b.lat - a.lat), 2)), 3) AS d
FROM grid a JOIN grid b ON b.j = a.j + 1 AND b.i = a.i + 1""")
def b6_flat_distance(spark, sf):
    g = V.grid_xy(spark, sf).select("j", "i", "lon", "lat")
    far = g.select((F.col("j") - 1).alias("j"), (F.col("i") - 1).alias("i"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    return rounded(g.join(far, ["j", "i"]).select("j", "i", X.flat_distance("lon", "lat", "lon1", "lat1").alias("d")), "d", n=3)


def _gradient_sql(t: str, p: str) -> str:
    """The adiabatic gradient of the fixed coefficients as SQL, with salinity in ``s``."""
    parts = {"1": "1", "salt": "(s - 35)", "press": p, "salt*press": f"(s - 35) * {p}", "press*press": f"{p} * {p}"}
    return " + ".join(f"{c!r} * pow({t}, {n}) * {parts[name]}" for name, row in K.ADIABATIC.items() for n, c in enumerate(row))


def _in_situ_sql() -> str:
    """Gill's scheme over cells, a table for each of its steps: the temperature and the carried difference."""
    out, half = "a0 AS (SELECT t, k, j, i, x AS th, 0.0 AS q, 30 + y AS s, abs(z) AS p FROM cells JOIN levels USING (k))", "sqrt(0.5)"
    for n, (at, gain, carry, keep) in enumerate((("0.0", "0.5", "1", "0"), ("0.5", f"(1 - {half})", f"(2 - 2 * {half})", f"(3 * {half} - 2)"), ("0.5", f"(1 + {half})", f"(2 + 2 * {half})", f"(-3 * {half} - 2)"))):
        out += f", d{n} AS (SELECT *, p * ({_gradient_sql('th', f'({at} * p)')}) AS d FROM a{n})"
        out += f", a{n + 1} AS (SELECT t, k, j, i, s, p, th + {gain} * (d - q) AS th, {carry} * d + {keep} * q AS q FROM d{n})"
    return out + f", situ AS (SELECT t, k, j, i, s, p, th + (p * ({_gradient_sql('th', 'p')}) - 2 * q) / 6 AS temp FROM a3)"


@query(f""", {_in_situ_sql()}
SELECT t, k, j, i, round(temp, 6) AS temp_in_situ, round(temp - ({K.FREEZING[0]!r} * s + {K.FREEZING[1]!r} * p + {K.FREEZING[2]!r}), 6) AS driving FROM situ""")
def b9_thermal_driving(spark, sf):
    """In-situ temperature, and what it is above the freezing point."""
    c = V.cells(spark, sf).join(V.levels(spark, sf), "k").withColumn("s", 30 + F.col("y"))
    out = X.with_in_situ(c, "x", "s", "z").withColumn("driving", F.col("temp_in_situ") - X.freezing_point("s", "z"))
    return rounded(out.select("t", "k", "j", "i", "temp_in_situ", "driving"), "temp_in_situ", "driving")


@query("""SELECT t, k, round(sum((x - (-0.0575 * (30 + y) - 7.61e-4 * abs(z) + 0.0901)) * 1028.5 * (1 - 3.733e-5 * (x + 1) + 7.843e-4 * (30 + y - 34.2)) * 4180.0 * w) / 1e9, 4) AS heat
FROM cells JOIN levels USING (k) GROUP BY t, k""")
def b11_heat_content(spark, sf):
    c = V.cells(spark, sf).join(V.levels(spark, sf), "k")
    h = X.heat_content_freezing("x", 30 + F.col("y"), "z", "w")
    return rounded(c.groupBy("t", "k").agg((F.sum(h) / 1e9).alias("heat")), "heat", n=4)


@query("SELECT k, round((0.62 * exp(z_top / 0.6) + 0.38 * exp(z_top / 20.0)) - (0.62 * exp(z_bot / 0.6) + 0.38 * exp(z_bot / 20.0)), 9) AS share FROM levels")
def b13_shortwave(spark, sf):
    return rounded(V.levels(spark, sf).select("k", X.shortwave_fraction("z_top", "z_bot").alias("share")), "share", n=9)


@query("SELECT t, round(avg(sqrt((x - 5) * (x - 5) + (y - 4) * (y - 4))), 6) AS speed, round(avg(atan2(y - 4, x - 5)), 6) AS angle FROM cells_xy GROUP BY t")
def b14_speed_and_angle(spark, sf):
    u, v = F.col("x") - 5, F.col("y") - 4
    return rounded(V.cells_xy(spark, sf).groupBy("t").agg(F.avg(X.speed(u, v)).alias("speed"), F.avg(X.angle(u, v)).alias("angle")), "speed", "angle")


@query("""SELECT t, k, j, i, round(0.62197 * e / (100000 - (1 - 0.62197) * e), 9) AS q FROM (SELECT *, 611 * exp(2.5e6 / 461.5 * (1 / 273.15 - 1 / (270 + x))) AS e FROM cells)""")
def b15_specific_humidity(spark, sf):
    return rounded(V.cells(spark, sf).select("t", "k", "j", "i", X.specific_humidity(270 + F.col("x"), F.lit(100000.0)).alias("q")), "q", n=9)


@query("""SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(day(last_day(o_orderdate)) AS INT) AS days,
CAST(CASE WHEN month(o_orderdate) = 2 THEN 28 ELSE day(last_day(o_orderdate)) END AS INT) AS noleap FROM orders""", views=False)
def b24_days_in_month(spark, sf):
    d = V.table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    return d.select("y", "m", X.days_in_month("y", "m").alias("days"), X.days_in_month("y", "m", leap=False).alias("noleap"))


@query("""SELECT j, i, k, CASE WHEN raw < lim / 2 THEN 0 WHEN raw < lim THEN lim ELSE raw END AS hfac FROM (
SELECT j, i, k, (least(z_top, draft) - greatest(z_bot, bathy)) / 50 AS raw, greatest(0.1, least(20.0 / dz, 1)) AS lim FROM grid, levels)""")
def b22_open_fraction(spark, sf):
    """Open fraction of every cell of grid and levels (two dimension tables)."""
    g = V.grid_xy(spark, sf).join(F.broadcast(V.levels(spark, sf)))
    return g.select("j", "i", "k", X.open_fraction("bathy", "draft", "z_top", "z_bot").alias("hfac"))


@query("""SELECT j, i, coalesce(max_by(z_top - 50 * h, k), 0.0) + 0.0 AS bathy, coalesce(min_by(z_top - 50 * (1 - h), k), 0.0) + 0.0 AS draft FROM (
SELECT j, i, k, z_top, CASE WHEN raw < lim / 2 THEN 0 WHEN raw < lim THEN lim ELSE raw END AS h FROM (
SELECT j, i, k, z_top, (least(z_top, draft) - greatest(z_bot, bathy)) / 50 AS raw, greatest(0.1, least(20.0 / dz, 1)) AS lim FROM grid, levels)) WHERE h <> 0 GROUP BY j, i""")
def b23_model_boundary(spark, sf):
    """Bathymetry and draft as the open fractions show them."""
    h = b22_open_fraction(spark, sf).where("hfac <> 0").join(F.broadcast(V.levels(spark, sf)), "k")
    return h.groupBy("j", "i").agg(
        (F.coalesce(F.max_by(F.col("z_top") - F.col("dz") * F.col("hfac"), "k"), F.lit(0.0)) + 0.0).alias("bathy"),
        (F.coalesce(F.min_by(F.col("z_top") - F.col("dz") * (1 - F.col("hfac")), "k"), F.lit(0.0)) + 0.0).alias("draft"),
    )


@query("""SELECT expt, member, t, round(100 * (v / base - 1), 6) AS percent FROM series JOIN (SELECT expt, member, avg(v) AS base FROM series WHERE year(t) <= 1996 GROUP BY 1, 2) USING (expt, member)""")
def b26_percent_of_baseline(spark, sf):
    s = V.series(spark, sf)
    base = s.where(F.year("t") <= 1996).groupBy("expt", "member").agg(F.avg("v").alias("base"))
    return rounded(s.join(base, ["expt", "member"]).select("expt", "member", "t", (100 * (F.col("v") / F.col("base") - 1)).alias("percent")), "percent")


# ---------------------------------------------------------------- regions and masks


@query("SELECT DISTINCT name AS region, j, i FROM grid JOIN regions ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax")
def c7_restrict_to_regions(spark, sf):
    return regions.restrict(V.grid_xy(spark, sf), V.regions(spark)).select("region", "j", "i")


_MASK = """, hit AS (SELECT DISTINCT name AS region, j, i, bathy, is_ice, is_land FROM grid JOIN regions ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax),
bound AS (SELECT name AS region, min(bathy_deep) AS deep, max(bathy_shallow) AS shallow, min(z_deep) AS zd, max(z_shallow) AS zs FROM regions GROUP BY 1),
mask AS (SELECT region, j, i, bathy, zd, zs FROM hit JOIN bound USING (region) WHERE NOT is_land AND NOT is_ice AND bathy BETWEEN deep AND shallow)"""


@query(_MASK + " SELECT region, j, i FROM mask")
def c8_region_mask(spark, sf):
    return regions.region_mask(V.grid_xy(spark, sf), V.regions(spark)).select("region", "j", "i")


@query(_MASK + " SELECT region, k, j, i FROM mask JOIN levels ON z BETWEEN zd AND zs AND z > bathy")
def c10_mask_to_levels(spark, sf):
    r = V.regions(spark)
    return regions.to_levels(regions.region_mask(V.grid_xy(spark, sf), r), V.levels(spark, sf), r)


@query("SELECT t, round(sum(x * w) / sum(w), 6) AS kept, count(*) AS n FROM cells JOIN grid USING (j, i) WHERE NOT is_land AND NOT is_ice GROUP BY t")
def c2_mask_land_and_ice(spark, sf):
    open_sea = V.grid_xy(spark, sf).where("NOT is_land AND NOT is_ice")
    c = regions.apply_mask(V.cells(spark, sf), open_sea, ["j", "i"])
    return rounded(c.groupBy("t").agg(agg.wavg("x", "w").alias("kept"), F.count(F.lit(1)).alias("n")), "kept")


@query("SELECT j, i FROM grid WHERE lon BETWEEN -100 AND 80 AND lat >= -75 + (lon + 100) / 15")
def c5_above_line(spark, sf):
    return V.grid_xy(spark, sf).where(regions.beside_line("lon", "lat", (-100.0, -75.0), (80.0, -63.0))).select("j", "i")


_NEAR = """, ext AS (SELECT min(j) AS j0, max(j) AS j1, min(i) AS i0, max(i) AS i1 FROM grid),
near AS (SELECT g.j, g.i, g.is_ice, g.is_land, n.is_ice AS ni, n.is_land AS nl FROM grid g, ext, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dj, di)
  LEFT JOIN grid n ON n.j = least(greatest(g.j + dj, j0), j1) AND n.i = least(greatest(g.i + di, i0), i1))"""


@query(_NEAR + " SELECT DISTINCT j, i FROM near WHERE is_ice AND NOT is_land AND NOT ni AND NOT nl")
def c11_ice_front(spark, sf):
    return regions.ice_front(V.grid_xy(spark, sf)).select("j", "i")


@query(_NEAR + " SELECT DISTINCT j, i, 'coast' AS kind FROM near WHERE NOT is_ice AND NOT is_land AND (ni OR nl) UNION ALL SELECT DISTINCT j, i, 'grounding' FROM near WHERE is_ice AND NOT is_land AND nl")
def c12_coast_and_grounding_line(spark, sf):
    g = V.grid_xy(spark, sf)
    return regions.coast(g).select("j", "i", F.lit("coast").alias("kind")).union(regions.grounding_line(g).select("j", "i", F.lit("grounding").alias("kind")))


@query("""SELECT expt, member, min(CASE WHEN v > 300 THEN t END) AS first_time FROM series GROUP BY 1, 2""")
def c14_first_crossing(spark, sf):
    return regions.first_crossing(V.series(spark, sf), ["expt", "member"], "v", 300.0)


# ---------------------------------------------------------------- joins


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY t) AS step FROM series WHERE expt = 'BUILDING'),
m AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY t) AS step FROM series WHERE expt = 'MACHINERY' AND year(t) >= 1996)
SELECT n.member, n.step, n.t, round(m.v - n.v, 6) AS difference FROM n JOIN m USING (member, step)""")
def d2_trim_and_diff(spark, sf):
    s = V.series(spark, sf)
    out = joins.trim_and_diff(s.where("expt = 'BUILDING'"), s.where("expt = 'MACHINERY'").where(F.year("t") >= 1996), ["member"], "v")
    return rounded(out, "difference").withColumn("step", F.col("step").cast("long"))


@query("""SELECT c.c_custkey, arg_min({'j': g.j, 'i': g.i}, [CAST(sqrt(pow(c.lon - g.lon, 2) + pow(c.lat - g.lat, 2)) AS DOUBLE), g.j, g.i]).j AS j,
arg_min({'j': g.j, 'i': g.i}, [CAST(sqrt(pow(c.lon - g.lon, 2) + pow(c.lat - g.lat, 2)) AS DOUBLE), g.j, g.i]).i AS i
FROM (SELECT c_custkey, CAST(c_custkey * 7 % 360 - 179.75 AS DOUBLE) AS lon, CAST(-79.75 + c_custkey % 17 AS DOUBLE) AS lat FROM customer) c, grid g GROUP BY 1""")
def d4_nearest_cell(spark, sf):
    """Nearest grid column of a point for every customer."""
    p = V.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 360 - 179.75).cast("double").alias("lon"), (-79.75 + F.col("c_custkey") % 17).cast("double").alias("lat"))
    return joins.nearest_cell(p, V.grid_xy(spark, sf), cutter(spark)).select("c_custkey", "j", "i")


@query("SELECT p_partkey, k FROM part LEFT JOIN levels ON -7.0 * p_size <= z_top AND -7.0 * p_size > z_bot")
def d5_level_of_depth(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", (-7.0 * F.col("p_size")).alias("depth"))
    return joins.level_of(p, V.levels(spark, sf), "depth").select("p_partkey", "k")


@query("""SELECT region, month, round(m, 6) AS model, round(o, 6) AS observed, round(m - o, 6) AS bias FROM
(SELECT region, month, avg(temp) AS m FROM casts WHERE depth <= 25 GROUP BY 1, 2) JOIN (SELECT region, month, avg(temp) AS o FROM casts WHERE depth > 25 GROUP BY 1, 2) USING (region, month)""")
def d6_against_observations(spark, sf):
    c = V.casts(spark, sf)
    return rounded(joins.against_observations(c.where("depth <= 25"), c.where("depth > 25"), ["region", "month"], "temp"), "model", "observed", "bias")


@query("""SELECT a.j, a.i, round(min(sqrt(pow(6.371e6 * cos(radians((a.lat + b.lat) / 2)) * radians(b.lon - a.lon), 2) + pow(6.371e6 * radians(b.lat - a.lat), 2))) / 1000, 4) AS distance
FROM grid a, grid b WHERE b.is_land AND NOT a.is_land GROUP BY 1, 2""")
def d7_distance_to_land(spark, sf):
    g = V.grid_xy(spark, sf)
    return rounded(joins.distance_to_set(g.where("NOT is_land"), g.where("is_land"), ["j", "i"], cutter(spark)), "distance", n=4)


@query("""SELECT a.member, a.t, round(a.v, 6) AS first, round(b.v, 6) AS second FROM series a JOIN series b USING (member, t) WHERE a.expt = 'BUILDING' AND b.expt = 'FURNITURE'""")
def d9_paired_experiments(spark, sf):
    s = V.series(spark, sf)
    return rounded(joins.paired(s.where("expt = 'BUILDING'"), s.where("expt = 'FURNITURE'"), ["member", "t"], "v"), "first", "second")


@query("""SELECT t, k, j, i, round(last_value(CASE WHEN x > 6 THEN x END IGNORE NULLS) OVER (PARTITION BY t, j, i ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS x FROM cells""")
def d10_last_valid_above(spark, sf):
    c = V.cells(spark, sf).withColumn("x", F.when(F.col("x") > 6, F.col("x")))
    return rounded(columns.fill_downwards(c, ["t", "j", "i"], "x").select("t", "k", "j", "i", "x"), "x")


# ---------------------------------------------------------------- aggregates


@query("SELECT t, k, round(sum(x * w) / sum(w), 6) AS x FROM cells GROUP BY t, k")
def e2_area_average(spark, sf):
    return rounded(agg.over(V.cells(spark, sf), ["t", "k"], "x", "w"), "x")


@query("""SELECT region, t, round(sum(x * w) / sum(w), 6) AS x FROM cells JOIN (SELECT DISTINCT name AS region, j, i FROM grid JOIN regions ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax) USING (j, i) GROUP BY region, t""")
def e3_regional_monthly_mean(spark, sf):
    """Volume-weighted monthly means by region: one scan, one shuffle."""
    r = regions.restrict(V.grid_xy(spark, sf), V.regions(spark)).select("region", "j", "i")
    return rounded(agg.over(V.cells(spark, sf).join(r, ["j", "i"]), ["region", "t"], "x", "w"), "x")


@query("SELECT t, j, i, round(sum(x * dz) / sum(dz), 6) AS x FROM cells JOIN levels USING (k) GROUP BY t, j, i")
def e4_vertical_average(spark, sf):
    c = V.cells(spark, sf).join(F.broadcast(V.levels(spark, sf)), "k")
    return rounded(agg.over(c, ["t", "j", "i"], "x", "dz"), "x")


@query("SELECT t, round(max(x), 6) AS largest FROM cells JOIN grid USING (j, i) WHERE lon BETWEEN -100 AND 100 AND NOT is_land GROUP BY t")
def e8_largest_in_box(spark, sf):
    g = V.grid_xy(spark, sf).where(F.col("lon").between(-100, 100) & ~F.col("is_land"))
    return rounded(regions.apply_mask(V.cells(spark, sf), g, ["j", "i"]).groupBy("t").agg(F.max("x").alias("largest")), "largest")


@query("SELECT t, round(sum(CASE WHEN x >= 5 THEN w ELSE 0 END), 6) AS area FROM cells_xy GROUP BY t")
def e9_area_above_threshold(spark, sf):
    return rounded(V.cells_xy(spark, sf).groupBy("t").agg(agg.area_at_least("x", 5, "w").alias("area")), "area")


@query("""SELECT t, round(sum((x - 5) * w) * 917, 4) AS loss, round(sum(greatest(x - 5, 0) * w) * 917, 4) AS melting, round(sum(least(x - 5, 0) * w) * 917, 4) AS freezing FROM cells_xy GROUP BY t""")
def e10_mass_balance(spark, sf):
    m = F.col("x") - 5
    out = V.cells_xy(spark, sf).groupBy("t").agg(*[(agg.mass_balance(m, "w", o) * 1e12).alias(o) for o in ("loss", "melting", "freezing")])
    return rounded(out, "loss", "melting", "freezing", n=4)


@query("SELECT t, round(100 * sum(CASE WHEN x >= 4 AND x <= 6 AND y <= 4 THEN w ELSE 0 END) / sum(w), 6) AS percent FROM cells GROUP BY t")
def e11_water_mass(spark, sf):
    return rounded(V.cells(spark, sf).groupBy("t").agg(agg.water_mass_percent("x", "y", "w", t_low=4, t_high=6, s_high=4).alias("percent")), "percent")


@query("SELECT k, round(min(x) - 0.02 * (max(x) - min(x)), 6) AS low, round(max(x) + 0.02 * (max(x) - min(x)), 6) AS high FROM cells GROUP BY k")
def e13_padded_range(spark, sf):
    return rounded(agg.padded_range(V.cells(spark, sf), ["k"], "x"), "low", "high")


@query("""SELECT expt, member, min_by(t, v) AS t_min, max_by(t, v) AS t_max FROM series GROUP BY 1, 2""")
def e14_times_of_extremes(spark, sf):
    return agg.times_of_extremes(V.series(spark, sf), ["expt", "member"], "t", "v")


@query("SELECT t, round(sqrt(sum((x - y) * (x - y))), 6) AS rss, round(sqrt(avg((x - y) * (x - y))), 6) AS rms FROM cells GROUP BY t")
def e15_root_squares(spark, sf):
    return rounded(V.cells(spark, sf).groupBy("t").agg(agg.root_sum_square("x", "y").alias("rss"), agg.root_mean_square("x", "y").alias("rms")), "rss", "rms")


@query("SELECT t, k, j, round(sum(x * cos(radians(lat)) * w) / sum(cos(radians(lat)) * w), 6) AS x FROM cells JOIN grid USING (j, i) WHERE lon BETWEEN -100 AND 100 GROUP BY t, k, j")
def e17_zonal_band(spark, sf):
    g = V.grid_xy(spark, sf).where(F.col("lon").between(-100, 100)).select("j", "i", "lat")
    c = V.cells(spark, sf).join(g, ["j", "i"]).withColumn("dx", F.cos(F.radians("lat")) * F.col("w"))
    return rounded(agg.over(c, ["t", "k", "j"], "x", "dx"), "x")


@query("SELECT t, CAST(j // 3 AS INT) AS bj, CAST(i // 4 AS INT) AS bi, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM cells_xy GROUP BY 1, 2, 3")
def e18_block_average(spark, sf):
    return rounded(agg.block_average(V.cells_xy(spark, sf), ["t"], ["x", "y"], 3, 4), "x", "y")


@query("SELECT j, i, CAST(sum(CASE WHEN x < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_cold, count(*) AS n FROM cells_xy GROUP BY j, i")
def e19_count_condition(spark, sf):
    return V.cells_xy(spark, sf).groupBy("j", "i").agg(F.count_if(F.col("x") < 4).alias("n_cold"), F.count(F.lit(1)).alias("n"))


@query("SELECT expt, t, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM series GROUP BY 1, 2")
def e22_ensemble_mean_std(spark, sf):
    return rounded(agg.ensemble(V.series(spark, sf), ["expt", "t"], "v"), "mean", "std")


@query("""SELECT region, t, round(sum(x * w) / sum(w), 6) AS x FROM cells_xy JOIN (SELECT j, i, min(name) AS region FROM grid JOIN regions ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax GROUP BY 1, 2) USING (j, i) GROUP BY GROUPING SETS ((region, t), (t))""")
def e23_regions_and_total(spark, sf):
    r = regions.restrict(V.grid_xy(spark, sf), V.regions(spark)).groupBy("j", "i").agg(F.min("region").alias("region"))
    return rounded(agg.by_region_and_total(V.cells_xy(spark, sf).join(r, ["j", "i"]), "region", ["t"], "x", "w"), "x")


@query("""SELECT t, arg_max(lat, [xm, -lat]) AS lat FROM (SELECT t, lat, round(avg(x), 9) AS xm FROM cells_xy JOIN grid USING (j, i) GROUP BY 1, 2) GROUP BY t""")
def e24_latitude_of_maximum(spark, sf):
    z = V.cells_xy(spark, sf).join(V.grid_xy(spark, sf).select("j", "i", "lat"), ["j", "i"]).groupBy("t", "lat").agg(F.round(F.avg("x"), 9).alias("xm"))
    return z.groupBy("t").agg(F.max_by("lat", F.struct("xm", (-F.col("lat")).alias("l"))).alias("lat"))


@query("SELECT t, round(sum(greatest(x - 5, 0) * w), 6) AS salt, round(sum(greatest(y - 4, 0) * w), 6) AS heat FROM cells_xy GROUP BY t")
def e28_positive_integrals(spark, sf):
    out = V.cells_xy(spark, sf).groupBy("t").agg(agg.positive_integral(F.col("x") - 5, "w").alias("salt"), agg.positive_integral(F.col("y") - 4, "w").alias("heat"))
    return rounded(out, "salt", "heat")


# ---------------------------------------------------------------- depth columns


@query("SELECT t, j, i, round(min_by(x, k), 6) AS top, round(max_by(x, k), 6) AS bottom FROM cells GROUP BY t, j, i")
def f1_top_and_bottom(spark, sf):
    c = V.cells(spark, sf)
    top = columns.end_level(c, ["t", "j", "i"], "x").withColumnRenamed("x", "top")
    bottom = columns.end_level(c, ["t", "j", "i"], "x", which="bottom").withColumnRenamed("x", "bottom")
    return rounded(top.join(bottom, ["t", "j", "i"]), "top", "bottom")


@query("SELECT vec_id, CAST(-10.0 * arg_min(k, [-v, k]) AS DOUBLE) AS depth FROM profiles GROUP BY 1")
def f2_depth_of_maximum(spark, sf):
    p = V.profiles(spark, sf).withColumn("z", F.col("k") * -10.0)
    return columns.depth_of_max(p, ["vec_id"], "v")


@query(""", p AS (SELECT vec_id, k, -10.0 * k AS z, v, lead(v) OVER w AS v2, lead(-10.0 * k) OVER w AS z2 FROM profiles WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
c AS (SELECT *, z <= -20 AND ((v < 0.1 AND v2 >= 0.1) OR (v >= 0.1 AND v2 < 0.1)) AS hit FROM p),
g AS (SELECT vec_id, arg_min((z - z2) / (v - v2) * (0.1 - v) + z, k) FILTER (hit) AS cross_z, min(z) AS floor_z, max(v) FILTER (z <= -20) AS mx, min(v) FILTER (z <= -20) AS mn FROM c GROUP BY 1)
SELECT vec_id, round(CASE WHEN mx < 0.1 THEN floor_z WHEN mn > 0.1 THEN NULL ELSE cross_z END, 6) AS depth FROM g""")
def f3_isoline_depth(spark, sf):
    p = V.profiles(spark, sf).withColumn("z", F.col("k") * -10.0)
    return rounded(columns.isoline_depth(p, ["vec_id"], "v", 0.1, below=-20.0), "depth")


@query("""SELECT a.t, a.j, a.i, round(a.x * 0.6 + b.x * 0.4, 6) AS x FROM cells a JOIN cells b USING (t, j, i) WHERE a.k = 2 AND b.k = 3""")
def f4_at_depth(spark, sf):
    """Between the levels at -75 and -125."""
    return rounded(columns.at_depth(V.cells(spark, sf), V.levels(spark, sf), ["t", "j", "i"], "x", -95.0), "x")


@query("""SELECT vec_id, CAST(-10.0 * arg_min(k, [-g, k]) AS DOUBLE) AS depth FROM (SELECT vec_id, k, (v - lag(v) OVER (PARTITION BY vec_id ORDER BY k)) / 10 AS g FROM profiles) WHERE g IS NOT NULL GROUP BY 1""")
def f5_thermocline(spark, sf):
    p = V.profiles(spark, sf).withColumn("z", F.col("k") * -10.0)
    return columns.thermocline(p, ["vec_id"], "v")


@query("""SELECT vec_id, CAST(d AS DOUBLE) AS depth, round(a.v + (b.v - a.v) * (d - 10 * a.k) / 10, 6) AS v FROM (SELECT vec_id, unnest(range(12, 641, 4)) AS d FROM (SELECT DISTINCT vec_id FROM profiles)) q
JOIN profiles a USING (vec_id) JOIN profiles b USING (vec_id) WHERE a.k = least(d // 10, 63) AND b.k = a.k + 1""")
def f8_refine_profile(spark, sf):
    p = V.profiles(spark, sf).withColumn("z", F.col("k") * -10.0)
    return rounded(columns.refine(p, ["vec_id"], "v", 4.0), "v")


@query("""SELECT vec_id, CAST(10 * arg_min(k, [v, k]) AS DOUBLE) AS core_depth, round(min(v), 6) AS core_temp FROM profiles WHERE k <= 42 GROUP BY 1""")
def f9_winter_water_core(spark, sf):
    p = V.profiles(spark, sf).withColumn("depth", F.col("k") * 10.0)
    return rounded(columns.winter_water_core(p, ["vec_id"], "v", "depth"), "core_temp")


@query("SELECT region, k, round(avg(v), 6) AS v FROM profiles GROUP BY 1, 2")
def f12_hovmoller(spark, sf):
    return rounded(V.profiles(spark, sf).groupBy("region", "k").agg(F.avg("v").alias("v")), "v")


@query("""SELECT t, k, j, i, round(x - sum(x * dz) OVER w / sum(dz) OVER w, 6) + 0.0 AS baroclinic FROM cells JOIN levels USING (k) WINDOW w AS (PARTITION BY t, j, i)""")
def f13_baroclinic(spark, sf):
    c = V.cells(spark, sf).join(F.broadcast(V.levels(spark, sf)), "k")
    return rounded(columns.baroclinic(c, ["t", "j", "i"], "x", "dz").select("t", "k", "j", "i", "baroclinic"), "baroclinic")


@query(""", p AS (SELECT vec_id, k, v < first_value(v) OVER w + 0.1 AS ok FROM profiles WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
q AS (SELECT vec_id, k, bool_and(ok) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS whole FROM p)
SELECT vec_id, CAST(-10.0 * max(k) AS DOUBLE) AS depth FROM q WHERE whole GROUP BY 1""")
def f14_mixed_layer(spark, sf):
    p = V.profiles(spark, sf).withColumn("z", F.col("k") * -10.0)
    return columns.mixed_layer(p, ["vec_id"], "v")


@query("""SELECT t, k, j, i, round(sum((1028.5 * (1 - 3.733e-5 * (x + 1) + 7.843e-4 * (30 + y - 34.2)) - 1028.5) * 9.81 * dz) OVER (PARTITION BY t, j, i ORDER BY k ROWS UNBOUNDED PRECEDING), 4) AS load FROM cells JOIN levels USING (k)""")
def f15_load_anomaly(spark, sf):
    c = V.cells(spark, sf).join(F.broadcast(V.levels(spark, sf)), "k").withColumn("rho", X.density_linear(30 + F.col("y"), "x"))
    return rounded(columns.load_anomaly(c, ["t", "j", "i"], "rho", "dz", 1028.5).select("t", "k", "j", "i", "load"), "load", n=4)


@query("""SELECT t, j, i, k, round(x * greatest(0, z_top - greatest(z_bot, -120)) / 120, 6) AS x FROM cells_xy, levels WHERE z_top > -120""")
def f16_spread_flux(spark, sf):
    flux = V.cells_xy(spark, sf).select("t", "j", "i", "x")
    return rounded(columns.spread_flux(flux, F.broadcast(V.levels(spark, sf)), "x", 120.0), "x")
