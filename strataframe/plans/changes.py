"""Queries: calendar, windows, stencils, filling, binning, ensemble statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.operators import agg, binning, calendar, fill, stats, stencil
from strataframe.plans.core import query, rounded
from strataframe.plans.cuts import cutter
from strataframe.sources import views as V

_S = ["expt", "member"]
_DAYS = "CAST(day(last_day(t)) AS INT)"


def monthly(spark, sf):
    """The ensemble series with a month number."""
    return V.series(spark, sf).withColumn("step", F.year("t") * 12 + F.month("t") - 1)


_STEP = "(year(t) * 12 + month(t) - 1)"

# ---------------------------------------------------------------- calendar


@query(f"SELECT expt, member, year(t) AS year, round(sum(v * {_DAYS}) / sum({_DAYS}), 6) AS v FROM series GROUP BY 1, 2, 3 HAVING count(DISTINCT month(t)) = 12")
def g1_annual_mean(spark, sf):
    return rounded(calendar.annual(V.series(spark, sf), _S, ["v"]), "v")


@query("""SELECT expt, member, max(t) FILTER (n % 12 = 6) AS t, round(avg(v), 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY expt, member ORDER BY t) - 1 AS n FROM series) GROUP BY expt, member, n // 12 HAVING count(*) = 12""")
def g2_annual_blocks(spark, sf):
    return rounded(calendar.annual_blocks(V.series(spark, sf), _S, "v"), "v")


@query("SELECT cell, CAST(date_trunc('month', d) AS DATE) AS month, round(avg(v), 6) AS v FROM (SELECT cell, d, avg(v) AS v FROM forcing GROUP BY 1, 2) GROUP BY 1, 2")
def g3_daily_to_monthly(spark, sf):
    daily = V.forcing(spark, sf).groupBy("cell", "d").agg(F.avg("v").alias("v"))
    return rounded(calendar.to_month(daily, ["cell"], "v", "d"), "v")


@query(f"SELECT k, j, i, round(sum(x * {_DAYS}) / sum({_DAYS}), 6) AS x, round(sum(y * {_DAYS}) / sum({_DAYS}), 6) AS y FROM cells WHERE year(t) BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3")
def g7_long_term_mean(spark, sf):
    return rounded(calendar.long_term_mean(V.cells(spark, sf), ["k", "j", "i"], ["x", "y"], 1996, 1999), "x", "y")


@query("SELECT k, month(t) AS month, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM cells GROUP BY 1, 2")
def g8_climatology(spark, sf):
    return rounded(calendar.climatology(V.cells(spark, sf), ["k"], ["x", "y"]), "x", "y")


@query("""SELECT o_orderstatus, CAST(dayofyear(d) - CASE WHEN month(d) > 2 AND dayofyear(make_date(year(d), 12, 31)) = 366 THEN 1 ELSE 0 END AS INT) AS day, round(avg(p), 6) AS p
FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d, o_totalprice / 1000 AS p FROM orders) WHERE NOT (month(d) = 2 AND day(d) = 29) GROUP BY 1, 2""", views=False)
def g10_daily_climatology(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderstatus", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_totalprice") / 1000).alias("p"))
    return rounded(calendar.daily_climatology(o, ["o_orderstatus"], "p", "d"), "p")


@query("SELECT expt, member, t, round(v - avg(v) OVER (PARTITION BY expt, member, month(t)), 6) + 0.0 AS anomaly FROM series")
def g12_monthly_anomaly(spark, sf):
    return rounded(calendar.anomalies(V.series(spark, sf), _S, "v").select(*_S, "t", "anomaly"), "anomaly")


# ---------------------------------------------------------------- windows and stencils


@query("""SELECT c.t, c.k, c.j, c.i, round(w.x, 6) AS west, round(e.x, 6) AS east, round(s.x, 6) AS south, round(n.x, 6) AS north,
CAST((w.x IS NOT NULL)::INT + (e.x IS NOT NULL)::INT + (s.x IS NOT NULL)::INT + (n.x IS NOT NULL)::INT AS INT) AS n_valid
FROM (SELECT *, greatest(i - 1, 0) AS iw, least(i + 1, 19) AS ie, greatest(j - 1, 0) AS js, least(j + 1, 9) AS jn FROM cells) c
LEFT JOIN cells w ON w.t = c.t AND w.k = c.k AND w.j = c.j AND w.i = c.iw LEFT JOIN cells e ON e.t = c.t AND e.k = c.k AND e.j = c.j AND e.i = c.ie
LEFT JOIN cells s ON s.t = c.t AND s.k = c.k AND s.i = c.i AND s.j = c.js LEFT JOIN cells n ON n.t = c.t AND n.k = c.k AND n.i = c.i AND n.j = c.jn""")
def h1_neighbours(spark, sf):
    """Four neighbours with the rule that an edge cell is its own."""
    c = V.cells(spark, sf)
    bounds = V.grid_xy(spark, sf).agg(F.min("j").alias("j0"), F.max("j").alias("j1"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    out = stencil.neighbours(c, "x", ["t", "k"], bounds=bounds).select("t", "k", "j", "i", "west", "east", "south", "north", "n_valid")
    return rounded(out, "west", "east", "south", "north")


@query("""SELECT c.t, c.k, c.j, c.i, round(a.x, 6) AS above, round(b.x, 6) AS below FROM cells c LEFT JOIN cells a ON a.t = c.t AND a.j = c.j AND a.i = c.i AND a.k = c.k - 1
LEFT JOIN cells b ON b.t = c.t AND b.j = c.j AND b.i = c.i AND b.k = c.k + 1""")
def h2_vertical_neighbours(spark, sf):
    c = V.cells(spark, sf)
    keys = ["t", "j", "i"]
    return rounded(c.select(*keys, "k", stencil.at_offset("x", keys, "k", -1).alias("above"), stencil.at_offset("x", keys, "k", 1).alias("below")), "above", "below")


@query(""", d AS (SELECT vec_id, k, (lead(v) OVER w - v) / 10 AS d, lag(v) OVER w AS p, v FROM profiles WINDOW w AS (PARTITION BY vec_id ORDER BY k))
SELECT vec_id, k, round(coalesce(d, (v - p) / 10), 6) + 0.0 AS d FROM d""")
def h3_depth_derivative(spark, sf):
    out = stencil.forward_difference(V.profiles(spark, sf), "v", "k", ["vec_id"], 10.0)
    return rounded(out.select("vec_id", "k", "d"), "d")


@query("SELECT expt, member, t, round(coalesce((v - lag(v) OVER w) / (epoch(t) - epoch(lag(t) OVER w)), 0) * 1e6, 6) + 0.0 AS d FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t)")
def h4_time_derivative(spark, sf):
    out = stencil.time_derivative(V.series(spark, sf), "v", _S).withColumn("d", F.col("d") * 1e6)
    return rounded(out.select(*_S, "t", "d"), "d")


@query(""", s AS (SELECT *, epoch(t) AS e, lag(epoch(t)) OVER w AS p, lead(epoch(t)) OVER w AS n FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t))
SELECT expt, member, t, round(sum(v * CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN n - e WHEN n IS NULL THEN e - p ELSE (n - p) / 2 END) OVER (PARTITION BY expt, member ORDER BY t ROWS UNBOUNDED PRECEDING) / 1e9, 6) AS integral FROM s""")
def h5_time_integral(spark, sf):
    out = stencil.time_integral(V.series(spark, sf), "v", _S).withColumn("integral", F.col("integral") / 1e9)
    return rounded(out.select(*_S, "t", "integral"), "integral")


@query("SELECT t, k, j, i, round(sum(x * 2.0) OVER (PARTITION BY t, k, i ORDER BY j ROWS UNBOUNDED PRECEDING), 6) AS integral FROM cells")
def h6_northward_integral(spark, sf):
    out = stencil.running_integral(V.cells(spark, sf), "x", ["t", "k", "i"], "j", 2.0)
    return rounded(out.select("t", "k", "j", "i", "integral"), "integral")


@query("""SELECT expt, member, t, round(s, 6) AS smooth FROM (SELECT *, avg(v) OVER w AS s, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)) WHERE n = 12""")
def h8_moving_average(spark, sf):
    return rounded(stencil.moving_average(V.series(spark, sf), "v", _S, "t", 12).select(*_S, "t", "smooth"), "smooth")


@query("""SELECT expt, member, t, round(s, 6) AS smooth FROM (SELECT *, avg(v) OVER w AS s, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) WHERE n = 25""")
def h8_long_moving_average(spark, sf):
    """The same by running sums, for long windows."""
    return rounded(stencil.moving_average_prefix(V.series(spark, sf), "v", _S, "t", 25).select(*_S, "t", "smooth"), "smooth")


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY expt, member ORDER BY t) - 1 AS n, count(*) OVER (PARTITION BY expt, member) - 1 AS m FROM series), r AS (SELECT *, least(5, n, m - n) AS r FROM n)
SELECT a.expt, a.member, a.t, round(avg(b.v), 6) AS smooth FROM r a JOIN r b ON a.expt = b.expt AND a.member = b.member AND abs(a.n - b.n) <= a.r GROUP BY 1, 2, 3""")
def h9_moving_average_edges(spark, sf):
    return rounded(stencil.moving_average_edges(V.series(spark, sf), "v", _S, "t", 5).select(*_S, "t", "smooth"), "smooth")


@query("""SELECT expt, member, t, round(avg(v) OVER w, 6) AS mean, round(stddev_pop(v) OVER w, 6) AS std FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)""")
def h10_rolling_signal(spark, sf):
    return rounded(stencil.rolling_signal(V.series(spark, sf), "v", _S, "t", 10).select(*_S, "t", "mean", "std"), "mean", "std")


@query(f"""SELECT expt, member, t, round(CASE WHEN count(*) OVER w = 20 THEN regr_slope(v, {_STEP}) OVER w END, 6) AS slope FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def h11_rolling_trend(spark, sf):
    return rounded(stencil.rolling_trend(monthly(spark, sf), "v", "step", _S, "t", 20).select(*_S, "t", "slope"), "slope")


@query("""SELECT c.t, c.k, c.j, c.i, round(CASE WHEN e.x IS NOT NULL AND n.y IS NOT NULL THEN c.x - e.x + c.y - n.y ELSE 0 END, 6) + 0.0 AS divergence
FROM cells c LEFT JOIN cells e ON e.t = c.t AND e.k = c.k AND e.j = c.j AND e.i = c.i + 1 LEFT JOIN cells n ON n.t = c.t AND n.k = c.k AND n.i = c.i AND n.j = c.j + 1""")
def h15_flux_divergence(spark, sf):
    return rounded(stencil.flux_divergence(V.cells(spark, sf), "x", "y", ["t", "k"]).select("t", "k", "j", "i", "divergence"), "divergence")


@query(""", u AS (SELECT t, j, i, sum((x - 5) * 50) AS u FROM cells GROUP BY 1, 2, 3), p AS (SELECT t, j, i, sum(u) OVER (PARTITION BY t, i ORDER BY j ROWS UNBOUNDED PRECEDING) AS psi FROM u)
SELECT t, round(-min(psi), 6) + 0.0 AS transport FROM p WHERE i BETWEEN 5 AND 15 GROUP BY t""")
def h16_gyre_transport(spark, sf):
    """Barotropic streamfunction from the south, and its minimum in a box."""
    u = V.cells(spark, sf).groupBy("t", "j", "i").agg(F.sum((F.col("x") - 5) * 50).alias("u"))
    psi = stencil.running_integral(u, "u", ["t", "i"], "j", out="psi")
    return rounded(psi.where(F.col("i").between(5, 15)).groupBy("t").agg((-F.min("psi")).alias("transport")), "transport")


@query("""SELECT c.t, c.j, c.i, round(CASE WHEN w.x IS NULL THEN c.x ELSE (c.x + w.x) / 2 END, 6) AS face FROM cells_xy c LEFT JOIN cells_xy w ON w.t = c.t AND w.j = c.j AND w.i = CASE WHEN c.i = 0 THEN 19 ELSE c.i - 1 END""")
def h17_centre_to_face(spark, sf):
    """Periodic: the first face lies between the last column and the first."""
    return rounded(stencil.to_face(V.cells_xy(spark, sf), "x", ["t", "j"], "i", 20).select("t", "j", "i", "face"), "face")


@query("""SELECT c.t, c.j, c.i, round(sum(s.x * g) / sum(g), 6) AS x FROM cells_xy c JOIN (SELECT CAST(unnest(range(-8, 9)) AS INT) AS d) k ON true
JOIN (SELECT t, j, i, x FROM cells_xy) s ON s.t = c.t AND s.j = c.j AND s.i = CASE WHEN (c.i + d + 40) % 40 >= 20 THEN 39 - (c.i + d + 40) % 40 ELSE (c.i + d + 40) % 40 END, LATERAL (SELECT exp(-0.5 * d * d / 4.0) AS g) q GROUP BY 1, 2, 3""")
def h19_gaussian_smoothing(spark, sf):
    return rounded(stencil.smooth(V.cells_xy(spark, sf).select("t", "j", "i", "x"), "x", ["t", "j"], "i", 20), "x")


@query("SELECT t, j, i, round(x, 6) AS x FROM cells_xy c WHERE EXISTS (SELECT 1 FROM cells_xy n WHERE n.t = c.t AND abs(n.i - c.i) + abs(n.j - c.j) = 1)")
def h20_remove_isolated(spark, sf):
    out = stencil.neighbours(V.cells_xy(spark, sf), "x", ["t"]).where("n_valid > 0")
    return rounded(out.select("t", "j", "i", "x"), "x")


@query("SELECT t, j, i, round(x, 6) AS x FROM cells_xy UNION ALL SELECT t, j, -1, round(x, 6) FROM cells_xy WHERE i = 19 UNION ALL SELECT t, j, 20, round(x, 6) FROM cells_xy WHERE i = 0")
def h21_wrap_columns(spark, sf):
    return rounded(stencil.wrap_columns(V.cells_xy(spark, sf).select("t", "j", "i", "x"), 20), "x")


@query("SELECT t, j, CAST((i - 7 + 20) % 20 AS INT) AS i, round(x, 6) AS x FROM cells_xy")
def h22_split_axis(spark, sf):
    return rounded(stencil.split_axis(V.cells_xy(spark, sf).select("t", "j", "i", "x"), 7, 20), "x")


@query("SELECT expt, member, round(stddev_pop(v), 6) AS std, CAST(rank() OVER (PARTITION BY expt ORDER BY stddev_pop(v) DESC) AS INT) AS place FROM series GROUP BY 1, 2")
def h23_rank_members(spark, sf):
    s = V.series(spark, sf).groupBy(*_S).agg(F.stddev_pop("v").alias("std"))
    return rounded(s.withColumn("place", F.rank().over(Window.partitionBy("expt").orderBy(F.desc("std")))), "std")


# ---------------------------------------------------------------- filling and connectivity


def _holes(spark, sf):
    """The surface field with its driest columns cut out, on the dense grid."""
    return V.cells_xy(spark, sf).where("w > 100").groupBy("j", "i", F.year("t").alias("y")).agg(F.avg("x").alias("x")).where("(i + 3 * j + y) % 5 <> 0")


_FIELD = """, g0 AS (SELECT y, j, i, x FROM (SELECT DISTINCT y FROM f) q CROSS JOIN grid LEFT JOIN f USING (y, j, i)),"""
_HOLES = """, f AS (SELECT j, i, year(t) AS y, avg(x) AS x FROM cells_xy WHERE w > 100 GROUP BY 1, 2, 3 HAVING (i + 3 * j + year(t)) % 5 <> 0)"""
_ROUND = """ {b} AS (SELECT a.y, a.j, a.i, CASE WHEN a.x IS NULL THEN (SELECT avg(n.x) FROM {a} n WHERE n.y = a.y AND abs(n.i - a.i) + abs(n.j - a.j) = 1) ELSE a.x END AS x FROM {a} a)"""


@query(_HOLES + _FIELD + _ROUND.format(a="g0", b="g1") + "," + _ROUND.format(a="g1", b="g2") + " SELECT y, j, i, round(x, 6) AS x FROM g2")
def j1_extend_into_mask(spark, sf):
    """Two rounds: a missing cell takes the mean of its valid neighbours."""
    d = fill.dense(_holes(spark, sf), V.grid_xy(spark, sf), ["y"], "x")
    return rounded(fill.extend(d, ["y"], "x", 2, cutter(spark)), "x")


@query(_HOLES + _FIELD[:-1] + """, h AS (SELECT a.y, a.j, a.i, n.x AS v, sqrt(pow(a.j - n.j, 2) + pow(a.i - n.i, 2)) AS d FROM g0 a JOIN g0 n ON n.y = a.y AND a.x IS NULL AND n.x IS NOT NULL AND pow(a.j - n.j, 2) + pow(a.i - n.i, 2) <= 16),
r AS (SELECT *, rank() OVER (PARTITION BY y, j, i ORDER BY d) AS r FROM h), q AS (SELECT y, j, i, sum(v / d) / sum(1 / d) AS fill FROM r WHERE r <= 4 GROUP BY 1, 2, 3 HAVING count(*) >= 4)
SELECT g0.y, g0.j, g0.i, round(coalesce(g0.x, fill), 6) AS x FROM g0 LEFT JOIN q USING (y, j, i)""")
def j4_nearest_weighted(spark, sf):
    d = fill.dense(_holes(spark, sf), V.grid_xy(spark, sf), ["y"], "x")
    return rounded(fill.nearest_weighted(d, ["y"], "x", 4, 4), "x")


@query(""", wet AS (SELECT j * 20 + i AS n, j, i FROM grid WHERE NOT is_land AND bathy <= -200), r(a, b) AS (SELECT n, n FROM wet UNION SELECT r.a, w2.n FROM r JOIN wet w1 ON w1.n = r.b JOIN wet w2 ON abs(w1.i - w2.i) + abs(w1.j - w2.j) = 1)
SELECT j, i, CAST(min(b) AS BIGINT) AS component FROM r JOIN wet ON n = a GROUP BY 1, 2""")
def j6_connected_components(spark, sf):
    wet = V.grid_xy(spark, sf).where("NOT is_land AND bathy <= -200")
    return fill.components(wet, 20, cutter(spark))


# ---------------------------------------------------------------- binning


@query("""SELECT t_bin, s_bin, round(sum(w), 6) AS volume FROM (SELECT w, CASE WHEN x = 10 THEN 20 ELSE CAST(floor(x / 10.0 * 20) AS INT) + 1 END AS t_bin, CASE WHEN y = 8 THEN 20 ELSE CAST(floor(y / 8.0 * 20) AS INT) + 1 END AS s_bin
FROM (SELECT w, round(x, 9) AS x, round(y, 9) AS y FROM cells) WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 8) GROUP BY 1, 2""")
def k1_ts_volume(spark, sf):
    c = V.cells(spark, sf).withColumn("x", F.round("x", 9)).withColumn("y", F.round("y", 9))
    return rounded(binning.ts_volume(c, [], "x", "y", "w", (0.0, 10.0), (0.0, 8.0), 20), "volume")


@query("""SELECT year(t) AS year, least(greatest(CASE WHEN x = 8 THEN 10 ELSE CAST(floor((x - 2) / 6.0 * 10) AS INT) + 1 END, 1), 10) AS t_bin, least(greatest(CASE WHEN y = 6 THEN 10 ELSE CAST(floor((y - 2) / 4.0 * 10) AS INT) + 1 END, 1), 10) AS s_bin, round(sum(w), 6) AS volume
FROM (SELECT t, w, round(x, 9) AS x, round(y, 9) AS y FROM cells) GROUP BY 1, 2, 3""")
def k2_ts_volume_by_year(spark, sf):
    c = V.cells(spark, sf).withColumn("x", F.round("x", 9)).withColumn("y", F.round("y", 9)).withColumn("year", F.year("t"))
    return rounded(binning.ts_volume(c, ["year"], "x", "y", "w", (2.0, 8.0), (2.0, 6.0), 10, clamp=True), "volume")


@query("""SELECT t, b AS bin, round(sum(w), 6) AS volume, round(sum(x * w) / sum(w), 6) AS x, round(sum(y * w) / sum(w), 6) AS y FROM (SELECT *, least(greatest(CASE WHEN r = 12 THEN 8 ELSE CAST(floor((r - 4) / 8.0 * 8) AS INT) + 1 END, 1), 8) AS b
FROM (SELECT *, round(x + y, 9) AS r FROM cells)) GROUP BY 1, 2""")
def k3_density_profile(spark, sf):
    c = V.cells(spark, sf).withColumn("r", F.round(F.col("x") + F.col("y"), 9))
    return rounded(binning.density_profile(c, ["t"], "r", ["x", "y"], "w", 4.0, 12.0, 8), "volume", "x", "y")


@query("""SELECT CAST(k AS INT) AS bin, round(sum(CASE WHEN year(t) >= 2000 THEN w ELSE 0 END) / 2 - sum(CASE WHEN year(t) <= 1996 THEN w ELSE 0 END) / 2, 6) AS change FROM cells WHERE year(t) >= 2000 OR year(t) <= 1996 GROUP BY 1""")
def k5_volume_change(spark, sf):
    c = V.cells(spark, sf).withColumnRenamed("k", "bin")
    return rounded(binning.volume_change(c, F.year("t") <= 1996, F.year("t") >= 2000, ["bin"], "w", 2, 2), "change")


@query("""SELECT n_name, vc.class, round(sum(s_acctbal * 1.0) / count(*), 6) AS s_acctbal, CAST(count(*) AS DOUBLE) AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN (VALUES ('low', -1000.0, 2000.0), ('middle', 2000.0, 6000.0), ('high', 6000.0, 20000.0)) vc(class, low, high) ON s_acctbal >= low AND s_acctbal < high GROUP BY 1, 2""", views=False)
def k4_mean_by_class(spark, sf):
    s = V.table(spark, sf, "supplier").join(V.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("one", F.lit(1.0))
    classes = spark.createDataFrame([("low", -1000.0, 2000.0), ("middle", 2000.0, 6000.0), ("high", 6000.0, 20000.0)], "class string, low double, high double")
    hit = s.join(classes, (F.col("s_acctbal") >= F.col("low")) & (F.col("s_acctbal") < F.col("high")))
    out = hit.groupBy("n_name", "class").agg(agg.wavg("s_acctbal", "one").alias("s_acctbal"), F.sum("one").alias("area"))
    return rounded(out, "s_acctbal")


@query("SELECT expt, member, t, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM (SELECT *, min(v) OVER (PARTITION BY expt) AS lo, max(v) OVER (PARTITION BY expt) AS hi FROM series)")
def b25_normalise(spark, sf):
    return rounded(binning.normalise(V.series(spark, sf), "v", ["expt"], "scaled").select(*_S, "t", "scaled"), "scaled")


# ---------------------------------------------------------------- ensemble statistics


@query(f"SELECT expt, member, round(regr_slope(v, {_STEP}), 6) AS slope, round(regr_intercept(v, {_STEP}), 3) AS intercept, round(regr_r2(v, {_STEP}), 6) AS r2, CAST(count(*) AS BIGINT) AS n FROM series GROUP BY 1, 2")
def m1_trends(spark, sf):
    out = stats.trend(monthly(spark, sf), _S, "v", "step").select(*_S, "slope", "intercept", "r2", "n")
    return rounded(rounded(out, "slope", "r2"), "intercept", n=3)


@query("SELECT k, j, i, round(regr_slope(x, y), 6) AS slope FROM (SELECT k, j, i, year(t) AS y, avg(x) AS x FROM cells GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) > 2")
def m2_trend_per_cell(spark, sf):
    annual = V.cells(spark, sf).groupBy("k", "j", "i", F.year("t").alias("y")).agg(F.avg("x").alias("x"))
    return rounded(stats.trend(annual, ["k", "j", "i"], "x", "y").where("n > 2").select("k", "j", "i", "slope"), "slope")


@query(f""", s AS (SELECT expt, member, regr_slope(v, {_STEP}) AS slope FROM series GROUP BY 1, 2)
SELECT expt, round(avg(slope), 6) AS mean, round(avg(slope) / (stddev_samp(slope) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS dof FROM s GROUP BY 1""")
def m3_one_sample_test(spark, sf):
    return rounded(stats.one_sample_t(stats.trend(monthly(spark, sf), _S, "v", "step"), ["expt"], "slope"), "mean", "t")


#: Two-sided p of the members' trends. With whole degrees of freedom the t distribution is a finite sum: of the even
#: powers of cos(theta) times sin(theta), or for odd degrees of the odd powers, and theta itself (tan(theta) = t / sqrt(nu)).
P_VALUES = f"""r AS (SELECT expt, member, regr_slope(v, {_STEP}) AS slope, regr_r2(v, {_STEP}) AS r2, count(*) - 2 AS nu FROM series GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN nu > 0 AND r2 < 1 THEN sign(slope) * sqrt(r2 * nu / (1 - r2)) END AS t FROM r),
c AS (SELECT *, nu / (nu + t * t) AS c2, abs(t) / sqrt(nu + t * t) AS s FROM u),
p AS (SELECT expt, member, slope, t, 1 - CASE WHEN nu % 2 = 0
  THEN s * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow(c2, j) FOR j IN range(0, nu // 2)])
  ELSE 2 / pi() * (atan(abs(t) / sqrt(nu)) + s * sqrt(c2) * coalesce(list_sum([exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(c2, j) FOR j IN range(0, (nu - 1) // 2)]), 0)) END AS p FROM c)"""


@query(f""", {P_VALUES} SELECT expt, member, round(slope, 6) + 0.0 AS slope, round(t, 6) + 0.0 AS t, round(p, 6) + 0.0 AS p FROM p""")
def m4_trend_p_values(spark, sf):
    """Two-sided p-values of the trends."""
    out = stats.trend(monthly(spark, sf), _S, "v", "step").withColumn("p", stats.two_sided_p("t", "dof"))
    return rounded(out.select(*_S, "slope", "t", "p"), "slope", "t", "p")


@query(""", s AS (SELECT member, avg(v) FILTER (expt = 'BUILDING') AS m1, var_samp(v) FILTER (expt = 'BUILDING') AS v1, count(v) FILTER (expt = 'BUILDING') AS n1, avg(v) FILTER (expt = 'MACHINERY') AS m2, var_samp(v) FILTER (expt = 'MACHINERY') AS v2, count(v) FILTER (expt = 'MACHINERY') AS n2 FROM series GROUP BY 1)
SELECT member, round(m1 - m2, 6) AS difference, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS dof FROM s""")
def m5_welch_test(spark, sf):
    out = stats.welch_t(V.series(spark, sf), ["member"], "v", F.col("expt") == "BUILDING", F.col("expt") == "MACHINERY")
    return rounded(rounded(out, "difference", "t"), "dof", n=4)


@query(""", a AS (SELECT expt, year(t) AS y, avg(v) AS v FROM series GROUP BY expt, member, year(t)), b AS (SELECT c.y AS centre, avg(a.v) FILTER (expt = 'BUILDING') AS m1, stddev_pop(a.v) FILTER (expt = 'BUILDING') AS s1, avg(a.v) FILTER (expt = 'MACHINERY') AS m2, stddev_pop(a.v) FILTER (expt = 'MACHINERY') AS s2
FROM a JOIN (SELECT DISTINCT y FROM a WHERE y BETWEEN (SELECT min(y) + 1 FROM a) AND (SELECT max(y) - 1 FROM a)) c ON abs(a.y - c.y) <= 1 GROUP BY 1)
SELECT 'BUILDING-MACHINERY' AS pair, CAST(CASE WHEN max(centre) FILTER (abs(m1 - m2) <= 0.2 * (s1 + s2)) = max(centre) THEN NULL ELSE coalesce(max(centre) FILTER (abs(m1 - m2) <= 0.2 * (s1 + s2)) + 1, min(centre)) END AS INT) AS year FROM b""")
def m6_divergence_time(spark, sf):
    a = V.series(spark, sf).groupBy(*_S, F.year("t").alias("y")).agg(F.avg("v").alias("v")).withColumn("pair", F.lit("BUILDING-MACHINERY"))
    return stats.divergence_time(a, ["pair"], "v", "y", F.col("expt") == "BUILDING", F.col("expt") == "MACHINERY", 1, z=0.2)


@query("SELECT expt, member, round(corr(v, v2), 6) AS r FROM series GROUP BY 1, 2")
def m7_correlation(spark, sf):
    return rounded(V.series(spark, sf).groupBy(*_S).agg(F.corr("v", "v2").alias("r")), "r")


@query(f""", s AS (SELECT *, {_STEP} AS step FROM series), c AS (SELECT a.expt, a.member, l AS lag, corr(a.v2, b.v) AS r FROM s a, (SELECT unnest(range(0, 13)) AS l) q, s b WHERE a.expt = b.expt AND a.member = b.member AND b.step = a.step + l GROUP BY 1, 2, 3 HAVING count(*) > 2)
SELECT expt, member, CAST(arg_max(lag, r) AS INT) AS lag, round(max(r), 6) AS r FROM c GROUP BY 1, 2""")
def m9_best_lag(spark, sf):
    return rounded(stats.best_lag(monthly(spark, sf), _S, "step", "v2", "v", 12), "r")


@query("SELECT t, j, i, round(CASE WHEN s > 0 THEN (x - m) / s END, 6) + 0.0 AS index FROM (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM cells_xy WINDOW w AS (PARTITION BY j, month(t)))")
def m14_standardised_index(spark, sf):
    return rounded(stats.standardised_by_month(V.cells_xy(spark, sf), ["j"], "x").select("t", "j", "i", "index"), "index")


@query(f"""SELECT expt, member, c AS cutoff, round(regr_slope(v, {_STEP}), 6) AS slope, CAST(count(*) AS BIGINT) AS n FROM series, (VALUES (100.0::DOUBLE), (200.0), (250.0)) q(c) WHERE v > c GROUP BY 1, 2, 3""")
def m13_trend_by_cutoff(spark, sf):
    return rounded(stats.trend_by_cutoff(monthly(spark, sf), _S, "v", "step", [100.0, 200.0, 250.0]).select(*_S, "cutoff", "slope", "n"), "slope")


@query(f""", s AS (SELECT *, {_STEP} AS step FROM series), e AS (SELECT *, max(CASE WHEN v > 320 THEN step END) OVER (PARTITION BY expt, member ORDER BY step ROWS UNBOUNDED PRECEDING) AS last FROM s)
SELECT expt, member, d AS delay, round(regr_slope(v, step), 6) AS slope, CAST(count(*) AS BIGINT) AS n FROM e, (SELECT CAST(unnest(range(0, 4)) AS INT) AS d) q WHERE last IS NULL OR step - last > d GROUP BY 1, 2, 3""")
def m20_trend_outside_events(spark, sf):
    out = stats.trend_outside_events(monthly(spark, sf), _S, "v", "step", F.col("v") > 320, [0, 1, 2, 3])
    return rounded(out.select(*_S, "delay", "slope", "n"), "slope")


_SPECTRUM = """, n AS (SELECT vec_id, v, v * v AS v2, k - 1 AS k FROM profiles), g AS (SELECT vec_id, s, v, v2, k - 8 * s AS n FROM n, (SELECT unnest(range(0, 7)) AS s) q WHERE k - 8 * s BETWEEN 0 AND 15),
fit AS (SELECT vec_id, s, regr_slope(v, n) AS a, regr_intercept(v, n) AS b, regr_slope(v2, n) AS a2, regr_intercept(v2, n) AS b2 FROM g GROUP BY 1, 2),
d AS (SELECT vec_id, s, n, (v - a * n - b) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS x, (v2 - a2 * n - b2) * (0.5 - 0.5 * cos(2 * pi() * n / 16)) AS y FROM g JOIN fit USING (vec_id, s)),
t AS (SELECT vec_id, s, f, sum(x * cos(2 * pi() * n * f / 16)) AS rx, -sum(x * sin(2 * pi() * n * f / 16)) AS ix, sum(y * cos(2 * pi() * n * f / 16)) AS ry, -sum(y * sin(2 * pi() * n * f / 16)) AS iy FROM d, (SELECT unnest(range(0, 9)) AS f) q GROUP BY 1, 2, 3)"""


@query(_SPECTRUM + """ SELECT vec_id, round(f / 16.0, 6) AS f, round(avg((rx * rx + ix * ix) / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * q / 16), 2)) FROM (SELECT unnest(range(0, 16)) AS q)) * CASE WHEN f IN (0, 8) THEN 1 ELSE 2 END), 6) AS power FROM t GROUP BY vec_id, f""")
def m15_power_spectrum(spark, sf):
    """Welch spectra of the profiles, 16 levels to a segment."""
    return rounded(stats.power_spectrum(V.profiles(spark, sf), ["vec_id"], "v", "k", 16), "f", "power")


@query(_SPECTRUM + """ SELECT vec_id, round(f / 16.0, 6) AS f, round(CASE WHEN avg(rx * rx + ix * ix) * avg(ry * ry + iy * iy) > 0 THEN (pow(avg(rx * ry + ix * iy), 2) + pow(avg(rx * iy - ix * ry), 2)) / (avg(rx * rx + ix * ix) * avg(ry * ry + iy * iy)) END, 4) AS coherence FROM t WHERE f > 0 GROUP BY vec_id, f""")
def m16_coherence(spark, sf):
    p = V.profiles(spark, sf).withColumn("v2", F.col("v") * F.col("v"))
    return rounded(rounded(stats.coherence(p, ["vec_id"], "v", "v2", "k", 16).where("f > 0"), "f"), "coherence", n=4)
