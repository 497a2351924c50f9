"""Queries: further rows of the operator inventory, compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.functions import constants as K
from strataframe.functions import expr as X
from strataframe.operators import agg, binning, boundary, calendar, columns, fill, joins, regions, regrid, stats, stencil
from strataframe.plans.changes import _DAYS, _S, _STEP, P_VALUES, monthly
from strataframe.plans.core import query, rounded
from strataframe.plans.cuts import cutter
from strataframe.sources import views as V

# ---------------------------------------------------------------- scalar expressions


@query("SELECT t, k, round(sum(x * 100 - (-1.9) * (y - 4) * w), 4) AS heat FROM cells GROUP BY t, k")
def b12_advection_above_freezing(spark, sf):
    h = X.advection_above_freezing(F.col("x") * 100, F.col("y") - 4, "w")
    return rounded(V.cells(spark, sf).groupBy("t", "k").agg(F.sum(h).alias("heat")), "heat", n=4)


@query("SELECT event_type, round(avg(v + 273.15 - 273.15), 6) AS celsius, round(avg(v / 3600), 9) AS rate, round(avg(-v), 6) AS flipped, round(avg((v / 1e4) / (1 + v / 1e4)), 9) AS specific FROM (SELECT event_type, value AS v FROM events) GROUP BY 1", views=False)
def b16_unit_conversions(spark, sf):
    """Kelvin to Celsius, accumulated to rate, sign, mixing ratio to specific humidity."""
    v = F.col("value")
    out = V.table(spark, sf, "events").groupBy("event_type").agg(
        F.avg(v + K.KELVIN - K.KELVIN).alias("celsius"), F.avg(v / 3600).alias("rate"), F.avg(-v).alias("flipped"), F.avg(X.mixing_to_specific(v / 1e4)).alias("specific")
    )
    return rounded(rounded(out, "celsius", "flipped"), "rate", "specific", n=9)


_ANGLE = "atan2(radians(5), cos(radians(-72.5)) * radians(20))"


@query(f"SELECT t, round(avg((y - 4) * cos({_ANGLE}) - (x - 5) * sin({_ANGLE})), 6) + 0.0 AS normal, round(avg((x - 5) * cos({_ANGLE}) + (y - 4) * sin({_ANGLE})), 6) + 0.0 AS along FROM cells_xy GROUP BY t")
def b17_rotate_to_transect(spark, sf):
    n, p = X.rotate(F.col("x") - 5, F.col("y") - 4, 0.0, -75.0, 20.0, -70.0)
    return rounded(V.cells_xy(spark, sf).groupBy("t").agg(F.avg(n).alias("normal"), F.avg(p).alias("along")), "normal", "along")


@query("""SELECT a.member, a.t, round(((a.v - a.f) - (b.v - b.f)) * 1e12 * (-910.0 / 1028.0 / 3.625e14), 9) + 0.0 AS slr FROM (SELECT *, first_value(v) OVER (PARTITION BY member ORDER BY t) AS f FROM series WHERE expt = 'BUILDING') a
JOIN (SELECT *, first_value(v) OVER (PARTITION BY member ORDER BY t) AS f FROM series WHERE expt = 'MACHINERY') b USING (member, t)""")
def b19_sea_level(spark, sf):
    """Change of ice volume since the start, minus that of the control run, as sea level."""
    s = V.series(spark, sf).withColumn("d", X.sea_level(F.col("v") * 1e12, F.first("v").over(Window.partitionBy("expt", "member").orderBy("t")) * 1e12))
    both = joins.paired(s.where("expt = 'BUILDING'"), s.where("expt = 'MACHINERY'"), ["member", "t"], "d")
    return rounded(both.select("member", "t", (F.col("first") - F.col("second")).alias("slr")), "slr", n=9)


@query("""SELECT k, coalesce((lag(z) OVER w + z) / 2, z + (z - lead(z) OVER w) / 2) AS upper, coalesce((z + lead(z) OVER w) / 2, z - (lag(z) OVER w - z) / 2) AS lower FROM levels WINDOW w AS (ORDER BY k)""")
def b20_axis_edges(spark, sf):
    """Edges halfway between centres, the ends extrapolated."""
    w = Window.orderBy("k")  # one axis
    up, down = F.lag("z").over(w), F.lead("z").over(w)
    out = V.levels(spark, sf).withColumn("upper", F.coalesce((up + F.col("z")) / 2, F.col("z") + (F.col("z") - down) / 2))
    return out.withColumn("lower", F.coalesce((F.col("z") + down) / 2, F.col("z") - (up - F.col("z")) / 2)).select("k", "upper", "lower")


@query("SELECT j, i, round(pow(6.371e6, 2) * radians(18) * cos(radians(lat)) * radians(2) / 1e6, 4) AS area FROM grid")
def b21_cell_area(spark, sf):
    side = K.EARTH_RADIUS * F.radians(F.lit(18.0)) * F.cos(F.radians("lat")) * K.EARTH_RADIUS * F.radians(F.lit(2.0))
    return rounded(V.grid_xy(spark, sf).select("j", "i", (side / 1e6).alias("area")), "area", n=4)


@query("SELECT t, k, j, i, round(least(greatest(x, 2), 8), 6) AS x, round(CASE WHEN x <= 2 THEN 0 ELSE y END, 6) AS y FROM cells")
def b27_clamp(spark, sf):
    """Physical bounds; a dependent variable is 0 where its driver is at the bound."""
    c = V.cells(spark, sf).select("t", "k", "j", "i", X.clamp("x", 2.0, 8.0).alias("x"), F.when(F.col("x") <= 2, 0.0).otherwise(F.col("y")).alias("y"))
    return rounded(c, "x", "y")


# ---------------------------------------------------------------- masks and joins


@query("SELECT t, round(sum(CASE WHEN lon BETWEEN -100 AND 80 AND lat BETWEEN -76 AND -66 THEN 0 ELSE x END), 6) AS total FROM cells_xy JOIN grid USING (j, i) GROUP BY t")
def c4_set_inside_box(spark, sf):
    c = V.cells_xy(spark, sf).join(V.grid_xy(spark, sf).select("j", "i", "lon", "lat"), ["j", "i"])
    return rounded(c.groupBy("t").agg(F.sum(regions.set_inside("x", "lon", "lat", (-100.0, 80.0, -76.0, -66.0), 0.0)).alias("total")), "total")


_SIDES = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dj, di)"


@query(f""", m AS (SELECT *, NOT is_ice AND NOT is_land AND i BETWEEN 4 AND 14 AND j BETWEEN 2 AND 8 AS own FROM grid),
n AS (SELECT a.j, a.i, bool_or(b.is_ice AND NOT b.is_land) AS ice, bool_or(NOT b.own AND NOT b.is_ice AND NOT b.is_land) AS sea FROM m a, {_SIDES} JOIN m b ON b.j = least(greatest(a.j + dj, 0), 9) AND b.i = least(greatest(a.i + di, 0), 19) WHERE a.own GROUP BY 1, 2)
SELECT j, i, CASE WHEN ice THEN 'ice_front' ELSE 'open_ocean' END AS boundary FROM n WHERE ice OR sea""")
def c9_boundary_classes(spark, sf):
    g = V.grid_xy(spark, sf).withColumn("own", ~F.col("is_ice") & ~F.col("is_land") & F.col("i").between(4, 14) & F.col("j").between(2, 8))
    return regions.boundary_class(g, "own")


@query("SELECT expt, member, t, round(v, 6) AS v FROM series JOIN (SELECT expt, member, t FROM series WHERE v2 >= 4) USING (expt, member, t)")
def c15_condition_on_companion(spark, sf):
    s = V.series(spark, sf)
    return rounded(regions.apply_mask(s.select(*_S, "t", "v"), s.where("v2 >= 4"), [*_S, "t"]), "v")


@query("SELECT t, k, round(sum(x * cos(radians(lat)) * dz) / sum(cos(radians(lat)) * dz), 6) AS x FROM cells JOIN grid USING (j, i) JOIN levels USING (k) GROUP BY t, k")
def d1_broadcast_dimensions(spark, sf):
    """Plane and depth dimensions by join, never tiled."""
    c = V.cells(spark, sf).join(V.grid_xy(spark, sf).select("j", "i", "lat"), ["j", "i"]).join(F.broadcast(V.levels(spark, sf)), "k")
    return rounded(agg.over(c.withColumn("dv", F.cos(F.radians("lat")) * F.col("dz")), ["t", "k"], "x", "dv"), "x")


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY expt || member ORDER BY t) AS s, count(*) OVER (PARTITION BY expt || member) AS c FROM series) SELECT expt, member, t, v2 FROM n WHERE s = (SELECT min(c) FROM n)""")
def d3_common_last_step(spark, sf):
    s = V.series(spark, sf).withColumn("run", F.concat("expt", F.col("member").cast("string")))
    return joins.common_last(s, "run").select(*_S, "t", "v2")


# ---------------------------------------------------------------- aggregates


@query("SELECT t, round(sum(x * w) FILTER (k = 1) / sum(w) FILTER (k = 1), 6) AS surface, round(sum((x + 273.15) * w) FILTER (z BETWEEN -250 AND -100) / 1e3, 4) AS heat FROM cells JOIN levels USING (k) GROUP BY t")
def e7_series_between_depths(spark, sf):
    """Surface mean, and the integral between depths in kelvin."""
    c = V.cells(spark, sf).join(F.broadcast(V.levels(spark, sf)), "k")
    at = lambda cond, col: F.when(cond, F.col(col))
    top, mid = F.col("k") == 1, F.col("z").between(-250, -100)
    out = c.groupBy("t").agg(agg.wavg(at(top, "x"), at(top, "w")).alias("surface"), (F.sum((at(mid, "x") + K.KELVIN) * F.col("w")) / 1e3).alias("heat"))
    return rounded(rounded(out, "surface"), "heat", n=4)


@query("""SELECT a.t, round(vol / flow / (365.25 * 86400) * 1e6, 6) AS years FROM (SELECT t, sum(w) AS vol FROM cells GROUP BY 1) a JOIN (SELECT t, sum(x * w) / sum(w) AS flow FROM cells_xy GROUP BY 1) b USING (t)""")
def e16_residence_time(spark, sf):
    """Volume over the area mean of the stream function."""
    vol = V.cells(spark, sf).groupBy("t").agg(F.sum("w").alias("vol"))
    flow = agg.over(V.cells_xy(spark, sf), ["t"], "x", "w", out="flow")
    return rounded(vol.join(flow, "t").select("t", (F.col("vol") / F.col("flow") / K.SECONDS_PER_YEAR * 1e6).alias("years")), "years")


@query("SELECT t, round(sum(CASE WHEN x < 3 THEN 0 ELSE x * w END) / sum(w), 6) AS extent FROM cells_xy GROUP BY t")
def e20_extent(spark, sf):
    """Area mean with small values set to 0."""
    return rounded(agg.over(V.cells_xy(spark, sf).withColumn("x", F.when(F.col("x") < 3, 0.0).otherwise(F.col("x"))), ["t"], "x", "w", out="extent"), "extent")


@query("SELECT d, round(max(v), 6) AS largest, round(avg(v), 6) AS mean, round(sum(v), 4) AS total, count(v) AS n FROM forcing GROUP BY 1")
def e21_forcing_series(spark, sf):
    f = V.forcing(spark, sf).groupBy("d").agg(F.max("v").alias("largest"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.count("v").alias("n"))
    return rounded(rounded(f, "largest", "mean"), "total", n=4)


@query("""SELECT cap, round(100.0 * avg(CASE WHEN r > cap THEN 1 ELSE 0 END), 6) AS above, round(avg(least(r, cap)), 6) AS mean FROM (SELECT x / y AS r FROM cells_xy WHERE y > 0), (SELECT CAST(unnest(range(1, 11)) * 0.5 AS DOUBLE) AS cap) GROUP BY cap""")
def e25_ratio_caps(spark, sf):
    """Ratio of two sources under each of ten caps."""
    r = V.cells_xy(spark, sf).where("y > 0").select((F.col("x") / F.col("y")).alias("r"))
    r = r.withColumn("cap", F.explode(F.array(*[F.lit(0.5 * n) for n in range(1, 11)])))
    out = r.groupBy("cap").agg((100.0 * F.avg((F.col("r") > F.col("cap")).cast("int"))).alias("above"), F.avg(F.least("r", "cap")).alias("mean"))
    return rounded(out, "above", "mean")


@query("SELECT t, j, i, round(max(x), 6) AS x FROM cells WHERE k >= 4 GROUP BY t, j, i")
def e26_maximum_below(spark, sf):
    return rounded(V.cells(spark, sf).where("k >= 4").groupBy("t", "j", "i").agg(F.max("x").alias("x")), "x")


@query(""", c AS (SELECT expt, member, 100 * (avg(v) FILTER (year(t) >= 1999) / avg(v) FILTER (year(t) < 1999) - 1) AS p FROM series GROUP BY 1, 2) SELECT expt, round(min(p), 6) AS least, round(avg(p), 6) AS mean, round(max(p), 6) AS most FROM c GROUP BY 1""")
def e27_change_between_periods(spark, sf):
    late = F.year("t") >= 1999
    c = V.series(spark, sf).groupBy(*_S).agg((100 * (F.avg(F.when(late, F.col("v"))) / F.avg(F.when(~late, F.col("v"))) - 1)).alias("p"))
    return rounded(c.groupBy("expt").agg(F.min("p").alias("least"), F.avg("p").alias("mean"), F.max("p").alias("most")), "least", "mean", "most")


# ---------------------------------------------------------------- depth columns


@query(""", p AS (SELECT vec_id, region, k, -10.0 * k AS z, v, lead(v) OVER w AS v2, lead(-10.0 * k) OVER w AS z2 FROM profiles WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
g AS (SELECT vec_id, region, arg_min((z - z2) / (v - v2) * (0.05 - v) + z, k) FILTER ((v < 0.05 AND v2 >= 0.05) OR (v >= 0.05 AND v2 < 0.05)) AS c, min(z) AS f, max(v) AS mx, min(v) AS mn FROM p GROUP BY 1, 2)
SELECT region, round(avg(CASE WHEN mx < 0.05 THEN f WHEN mn > 0.05 THEN NULL ELSE c END), 6) AS depth FROM g GROUP BY 1""")
def f6_mean_isoline_depth(spark, sf):
    p = V.profiles(spark, sf).withColumn("z", F.col("k") * -10.0)
    d = columns.isoline_depth(p, ["vec_id", "region"], "v", 0.05)
    return rounded(d.groupBy("region").agg(F.avg("depth").alias("depth")), "depth")


@query(""", c AS (SELECT vec_id, arg_min(k, [v, k]) AS c FROM profiles WHERE k <= 42 GROUP BY 1), g AS (SELECT vec_id, k, (v - lag(v) OVER (PARTITION BY vec_id ORDER BY k)) / 10 AS g FROM profiles),
b AS (SELECT vec_id, k, g, max(g) OVER (PARTITION BY vec_id) AS top FROM g JOIN c USING (vec_id) WHERE k > c AND k * 10 < 640 * 0.8 AND g IS NOT NULL)
SELECT vec_id, CAST(10 * max(CASE WHEN top > 0 AND g > 0.05 / pow(2, greatest(0, floor(log2(0.05 / CASE WHEN top > 0 THEN top END)) + 1)) THEN k END) AS DOUBLE) AS base_depth FROM b GROUP BY 1""")
def f10_thermocline_base(spark, sf):
    p = V.profiles(spark, sf).withColumn("depth", F.col("k") * 10.0)
    return columns.thermocline_base(p, ["vec_id"], "v", "depth", 0.05)


@query("SELECT t, k, j, i, round(sum((1000 + x) * 9.81 * dz) OVER (PARTITION BY t, j, i ORDER BY k ROWS UNBOUNDED PRECEDING), 4) AS pressure FROM cells JOIN levels USING (k)")
def f17_pressure(spark, sf):
    """Cumulative weight of the column."""
    c = V.cells(spark, sf).join(F.broadcast(V.levels(spark, sf)), "k").withColumn("rho", 1000 + F.col("x"))
    return rounded(columns.load_anomaly(c, ["t", "j", "i"], "rho", "dz", 0.0).select("t", "k", "j", "i", F.col("load").alias("pressure")), "pressure", n=4)


# ---------------------------------------------------------------- calendar and windows


@query("SELECT k, j, i, round(avg(x), 6) AS x FROM cells WHERE year(t) = 1997 GROUP BY 1, 2, 3")
def g5_simple_average(spark, sf):
    return rounded(calendar.long_term_mean(V.cells(spark, sf), ["k", "j", "i"], ["x"], 1997, 1997, weighted=False), "x")


@query(f"SELECT k, j, i, year(t) AS year, round(sum(x * {_DAYS}) / sum({_DAYS}), 6) AS x FROM cells GROUP BY 1, 2, 3, 4")
def g6_annual_fields(spark, sf):
    """Annual means of every cell, also of years in which it is dry for some months."""
    return rounded(calendar.annual(V.cells(spark, sf), ["k", "j", "i"], ["x"], complete=False), "x")


@query("SELECT expt, month(t) AS month, round(avg(v), 6) AS v FROM series WHERE year(t) BETWEEN 1995 AND 1998 GROUP BY 1, 2")
def g11_ensemble_climatology(spark, sf):
    return rounded(calendar.climatology(V.series(spark, sf), ["expt"], ["v"], first=1995, last=1998), "v")


@query("""SELECT expt, member, t, round(sum((v - m) * 2592000) OVER (PARTITION BY expt, member ORDER BY t ROWS UNBOUNDED PRECEDING) / 1e9, 6) + 0.0 AS integral FROM (SELECT *, avg(v) OVER (PARTITION BY expt, member) AS m FROM series)""")
def h13_integral_of_anomaly(spark, sf):
    s = V.series(spark, sf).withColumn("a", (F.col("v") - F.avg("v").over(Window.partitionBy(*_S))) / 1e9)
    return rounded(stencil.running_integral(s, "a", _S, "t", 2592000.0).select(*_S, "t", "integral"), "integral")


@query(""", s AS (SELECT *, avg(v) OVER w AS a, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)), f AS (SELECT *, CASE WHEN n = 25 THEN a END AS s FROM s)
SELECT expt, member, t, round(v - coalesce(s, CASE WHEN t < (SELECT min(t) FROM f g WHERE g.expt = f.expt AND g.member = f.member AND g.s IS NOT NULL) THEN first_value(s IGNORE NULLS) OVER q ELSE last_value(s IGNORE NULLS) OVER q END), 6) + 0.0 AS detrended
FROM f WINDOW q AS (PARTITION BY expt, member ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def h12_detrend(spark, sf):
    """Minus a long moving average whose end values reach outwards."""
    s = V.series(spark, sf)
    smooth = stencil.moving_average(s, "v", _S, "t", 25).select(*_S, "t", "smooth")
    w = Window.partitionBy(*_S).orderBy("t")
    own = s.join(smooth, [*_S, "t"], "left")
    past = F.last("smooth", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("smooth", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rounded(own.select(*_S, "t", (F.col("v") - F.coalesce(past, ahead)).alias("detrended")), "detrended")


@query(""", f AS (SELECT t, i, CAST(round(x * w, 6) AS DECIMAL(20, 6)) AS f FROM cells WHERE i IN (0, 19)), b AS (SELECT t, coalesce(sum(f) FILTER (i = 0), 0) AS a, coalesce(sum(f) FILTER (i = 19), 0) AS b FROM f GROUP BY t)
SELECT t, CAST(a AS DOUBLE) / 1e3 AS inflow, CAST(b AS DOUBLE) / 1e3 AS outflow, CAST(sum(a - b) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e3 AS volume FROM b""")
def h14_volume_budget(spark, sf):
    """Fluxes by boundary and their running difference. Fluxes are fixed decimals, so sums do not depend on their order."""
    flux = F.round(F.col("x") * F.col("w"), 6).cast("decimal(20,6)")
    at = lambda i: F.coalesce(F.sum(F.when(F.col("i") == i, flux)), F.lit(0).cast("decimal(20,6)"))
    s = V.cells(spark, sf).where("i IN (0, 19)").groupBy("t").agg(at(0).alias("a"), at(19).alias("b")).withColumn("d", F.col("a") - F.col("b"))
    out = stencil.running_total(s, "d", "t", F.year("t"), "volume")
    return out.select("t", *[(F.col(c).cast("double") / 1e3).alias(n) for c, n in (("a", "inflow"), ("b", "outflow"), ("volume", "volume"))])


# ---------------------------------------------------------------- regridding, filling


@query(""", wet AS (SELECT j * 20 + i AS n, j, i, lon, lat FROM grid WHERE is_ice AND NOT is_land), r(a, b) AS (SELECT n, n FROM wet UNION SELECT r.a, w2.n FROM r JOIN wet w1 ON w1.n = r.b JOIN wet w2 ON abs(w1.i - w2.i) + abs(w1.j - w2.j) = 1)
SELECT CAST(min(b) AS BIGINT) AS component, CAST(count(DISTINCT a) AS BIGINT) AS n FROM (SELECT a, min(b) AS b FROM r GROUP BY 1) GROUP BY b""")
def j7_shelf_sizes(spark, sf):
    """Cells of each connected ice shelf."""
    shelf = V.grid_xy(spark, sf).where("is_ice AND NOT is_land")
    return fill.components(shelf, 20, cutter(spark)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor(bathy / 100) AS INT) AS bucket, count(*) AS n, round(sum(cos(radians(lat))), 6) AS area FROM grid GROUP BY 1")
def k6_bathymetry_histogram(spark, sf):
    g = V.grid_xy(spark, sf).groupBy(F.floor(F.col("bathy") / 100).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos(F.radians("lat"))).alias("area"))
    return rounded(g, "area")


# ---------------------------------------------------------------- statistics


@query(f""", e AS (SELECT expt, t, avg(v) AS v, avg(v2) AS v2 FROM series GROUP BY 1, 2), d AS (SELECT expt, t, (v - lag(v) OVER w) AS dv, v2 FROM e WINDOW w AS (PARTITION BY expt ORDER BY t)) SELECT expt, round(corr(dv, v2), 6) AS r, round(regr_slope(dv, v2), 6) AS slope FROM d GROUP BY 1""")
def m8_rate_against_driver(spark, sf):
    """Rate of change of the ensemble mean against a driver."""
    e = V.series(spark, sf).groupBy("expt", "t").agg(F.avg("v").alias("v"), F.avg("v2").alias("v2"))
    d = e.withColumn("dv", F.col("v") - F.lag("v").over(Window.partitionBy("expt").orderBy("t")))
    return rounded(d.groupBy("expt").agg(F.corr("dv", "v2").alias("r"), F.regr_slope(F.col("dv"), F.col("v2")).alias("slope")), "r", "slope")


@query(f""", s AS (SELECT member, regr_slope(v, {_STEP}) AS s FROM series WHERE expt = 'BUILDING' GROUP BY 1), f AS (SELECT j, i, year(t) % 4 AS member, avg(x) AS x FROM cells_xy GROUP BY 1, 2, 3)
SELECT j, i, round(corr(x, s), 6) AS r, count(*) AS n FROM f JOIN s USING (member) GROUP BY 1, 2 HAVING count(*) = 4""")
def m11_correlation_map(spark, sf):
    """A field of every member against the members' trends, cell by cell."""
    s = stats.trend(monthly(spark, sf).where("expt = 'BUILDING'"), ["member"], "v", "step").select("member", F.col("slope").alias("s"))
    f = V.cells_xy(spark, sf).groupBy("j", "i", (F.year("t") % 4).alias("member")).agg(F.avg("x").alias("x"))
    out = f.join(s, "member").groupBy("j", "i").agg(F.corr("x", "s").alias("r"), F.count(F.lit(1)).alias("n")).where("n = 4")
    return rounded(out, "r")


@query(f""", s AS (SELECT expt, member, regr_slope(v, {_STEP}) AS a, regr_slope(v2, {_STEP}) AS b FROM series GROUP BY 1, 2) SELECT expt, round(regr_slope(a, b), 4) AS slope, round(regr_r2(a, b), 6) AS r2 FROM s GROUP BY 1""")
def m12_member_regression(spark, sf):
    m = monthly(spark, sf)
    a = stats.trend(m, _S, "v", "step").select(*_S, F.col("slope").alias("a"))
    both = a.join(stats.trend(m, _S, "v2", "step").select(*_S, F.col("slope").alias("b")), _S)
    out = stats.trend(both, ["expt"], "a", "b").select("expt", "slope", "r2")
    return rounded(rounded(out, "slope", n=4), "r2")


@query(""", p AS (SELECT expt, member, year(t) AS y, avg(v) FILTER (month(t) <= 6) AS a, avg(v) FILTER (month(t) > 6) AS b, avg(v) AS c FROM series GROUP BY 1, 2, 3) SELECT expt, y, round(avg(a), 6) AS first, round(avg(b), 6) AS second, round(avg(c - (a + b) / 2), 6) + 0.0 AS residual FROM p GROUP BY 1, 2""")
def m17_budget_residual(spark, sf):
    """Terms by year and experiment, and what they leave."""
    early = F.month("t") <= 6
    p = V.series(spark, sf).groupBy(*_S, F.year("t").alias("y")).agg(F.avg(F.when(early, F.col("v"))).alias("a"), F.avg(F.when(~early, F.col("v"))).alias("b"), F.avg("v").alias("c"))
    out = p.groupBy("expt", "y").agg(F.avg("a").alias("first"), F.avg("b").alias("second"), F.avg(F.col("c") - (F.col("a") + F.col("b")) / 2).alias("residual"))
    return rounded(out, "first", "second", "residual")


@query(""", d AS (SELECT *, 1028.5 * (1 - 3.733e-5 * (x + 1) + 7.843e-4 * (30 + y - 34.2)) AS rho FROM cells) SELECT k, CAST(floor(year(t) / 4) AS INT) AS period, round(sum(rho * w) / sum(w), 6) AS rho FROM d GROUP BY 1, 2""")
def m18_period_density(spark, sf):
    d = V.cells(spark, sf).withColumn("rho", X.density_linear(30 + F.col("y"), "x")).withColumn("period", F.floor(F.year("t") / 4).cast("int"))
    return rounded(agg.over(d, ["k", "period"], "rho", "w"), "rho")


@query(f""", {P_VALUES}, o AS (SELECT expt, CASE WHEN p < 0.05 THEN slope ELSE 0.0 END AS s FROM p)
SELECT expt, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std, count(*) AS n FROM o GROUP BY expt""")
def m19_significant_trends(spark, sf):
    """Mean and spread of member trends, those without significance counting as 0."""
    t = stats.trend(monthly(spark, sf), _S, "v", "step").withColumn("p", stats.two_sided_p("t", "dof"))
    own = t.withColumn("s", F.when(F.col("p") < 0.05, F.col("slope")).otherwise(0.0))
    return rounded(agg.ensemble(own, ["expt"], "s"), "mean", "std")


# ---------------------------------------------------------------- boundaries, corrections, sets


@query("SELECT year(t) AS year, i, round(sum((x - 5) * w) / 1e3, 6) + 0.0 AS transport FROM cells WHERE i IN (0, 7, 19) GROUP BY 1, 2")
def n7_transports_at_lines(spark, sf):
    c = V.cells(spark, sf).where("i IN (0, 7, 19)").groupBy(F.year("t").alias("year"), "i").agg((F.sum((F.col("x") - 5) * F.col("w")) / 1e3).alias("transport"))
    return rounded(c, "transport")


@query("""SELECT member, month, round(r - m, 6) AS offset FROM (SELECT member, month(t) AS month, avg(v) AS m FROM series WHERE expt = 'BUILDING' GROUP BY 1, 2) JOIN (SELECT member, month(t) AS month, avg(v) AS r FROM series WHERE expt = 'MACHINERY' GROUP BY 1, 2) USING (member, month)""")
def p1_offsets(spark, sf):
    s = V.series(spark, sf).withColumn("month", F.month("t"))
    return rounded(boundary.offset_correction(s.where("expt = 'BUILDING'"), s.where("expt = 'MACHINERY'"), ["member", "month"], "v"), "offset")


@query("""SELECT j, i, round(CASE WHEN d >= 1500 THEN 0 ELSE 0.5 + 0.5 * cos(d * pi() / 1500) END, 6) AS taper FROM (SELECT a.j, a.i, min(sqrt(pow(6.371e6 * cos(radians((a.lat + b.lat) / 2)) * radians(b.lon - a.lon), 2) + pow(6.371e6 * radians(b.lat - a.lat), 2))) / 1000 AS d FROM grid a, grid b WHERE b.is_land GROUP BY 1, 2)""")
def p4_coastal_taper(spark, sf):
    g = V.grid_xy(spark, sf)
    d = joins.distance_to_set(g, g.where("is_land"), ["j", "i"], cutter(spark))
    return rounded(d.select("j", "i", boundary.taper("distance", 1500.0).alias("taper")), "taper")


@query(""", n AS (SELECT vec_id, k, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS d FROM profiles WINDOW w AS (PARTITION BY vec_id)) SELECT CASE WHEN d = 1 THEN 10 ELSE CAST(floor(round(d, 9) * 10) AS INT) + 1 END AS bin, count(*) AS n, round(avg(k), 6) AS k FROM n GROUP BY 1""")
def p6_property_space(spark, sf):
    """Mean level by bin of the normalised column."""
    p = binning.normalise(V.profiles(spark, sf), "v", ["vec_id"], "d")
    p = p.withColumn("bin", binning.bin_of(F.round("d", 9), F.lit(0.0), F.lit(1.0), 10))
    return rounded(p.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("k")), "k")


@query("""SELECT j, i, 'both' AS kind FROM grid WHERE is_ice AND bathy <= -250 UNION ALL SELECT j, i, 'ice only' FROM grid WHERE is_ice AND NOT bathy <= -250""")
def r2_mask_algebra(spark, sf):
    g = V.grid_xy(spark, sf)
    ice, deep = g.where("is_ice").select("j", "i"), g.where("bathy <= -250").select("j", "i")
    return ice.intersect(deep).withColumn("kind", F.lit("both")).union(ice.exceptAll(deep).withColumn("kind", F.lit("ice only")))


@query("SELECT member, t, round(a + b, 6) AS total FROM (SELECT member, t, sum(v) FILTER (expt = 'BUILDING') AS a, sum(v) FILTER (expt = 'MACHINERY') AS b FROM series GROUP BY 1, 2)")
def r5_combine_variables(spark, sf):
    s = V.series(spark, sf).groupBy("member", "t").pivot("expt", ["BUILDING", "MACHINERY"]).agg(F.sum("v"))
    return rounded(s.select("member", "t", (F.col("BUILDING") + F.col("MACHINERY")).alias("total")), "total")


@query("SELECT expt, member, min_by(t, t) FILTER (v > 250) AS first_time, round(min_by(v, t) FILTER (v > 250), 6) AS v FROM series GROUP BY 1, 2")
def s4_first_record_above(spark, sf):
    s = V.series(spark, sf).groupBy(*_S).agg(F.min(F.when(F.col("v") > 250, F.struct("t", "v"))).alias("f"))
    return rounded(s.select(*_S, F.col("f.t").alias("first_time"), F.col("f.v").alias("v")), "v")


@query("SELECT t, round(sum(greatest(x - 5, 0) + greatest(y - 4, 0)), 6) AS production FROM cells_xy GROUP BY t")
def u4_production(spark, sf):
    """Terms whose negative parts count as 0, summed."""
    p = F.greatest(F.col("x") - 5, F.lit(0.0)) + F.greatest(F.col("y") - 4, F.lit(0.0))
    return rounded(V.cells_xy(spark, sf).groupBy("t").agg(F.sum(p).alias("production")), "production")


@query(f""", a AS (SELECT expt, member, year(t) AS y, sum(v * {_DAYS}) / sum({_DAYS}) AS v FROM series GROUP BY 1, 2, 3 HAVING count(DISTINCT month(t)) = 12) SELECT expt, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(v) FILTER (y >= 1999) - avg(v) FILTER (y < 1999), 6) AS anomaly FROM a GROUP BY 1""")
def u6_summary(spark, sf):
    """Mean, spread and late anomaly of annual values."""
    a, late = calendar.annual(V.series(spark, sf), _S, ["v"]), F.col("year") >= 1999
    out = a.groupBy("expt").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.avg(F.when(late, F.col("v"))) - F.avg(F.when(~late, F.col("v")))).alias("anomaly"))
    return rounded(out, "mean", "std", "anomaly")


