"""Queries: the inventory's rows on sources, calendars, fronts and member selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.functions import expr as X
from strataframe.operators import calendar, joins, regions
from strataframe.operators.agg import wavg
from strataframe.plans.core import query, rounded
from strataframe.sources import views as V

_DAY_WEIGHT = "day(last_day(t))"
_NOLEAP = "CASE WHEN month(t) = 2 THEN 28 ELSE day(last_day(t)) END"
_BOX = (-100.0, 80.0, -76.0, -66.0)


@query("""SELECT member, t, CASE WHEN a.v IS NOT NULL THEN 'first' ELSE 'second' END AS source, round(coalesce(a.v, b.v), 6) AS v
FROM (SELECT * FROM series WHERE expt = 'BUILDING') a FULL JOIN (SELECT * FROM series WHERE expt = 'MACHINERY') b USING (member, t)""")
def a5_find_in_sources(spark, sf):
    """Each value from the first of two sources that has it."""
    s = V.series(spark, sf)
    first = s.where("expt = 'BUILDING'").select("member", "t", F.col("v").alias("a"))
    both = first.join(s.where("expt = 'MACHINERY'").select("member", "t", F.col("v").alias("b")), ["member", "t"], "full")
    source = F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("source")
    return rounded(both.select("member", "t", source, F.coalesce("a", "b").alias("v")), "v")


@query("""SELECT t, j, i, round(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d <= -pi() THEN d + 2 * pi() ELSE d END, 6) + 0.0 AS turn
FROM (SELECT t, j, i, atan2(y - 4.03, x - 5.07) - lag(atan2(y - 4.03, x - 5.07)) OVER (PARTITION BY j, i ORDER BY t) AS d FROM cells_xy) WHERE d IS NOT NULL""")
def b18_angle_wrap(spark, sf):
    """Change of direction since the cell's step before, wrapped."""
    a = F.atan2(F.col("y") - 4.03, F.col("x") - 5.07)
    c = V.cells_xy(spark, sf).withColumn("d", a - F.lag(a).over(Window.partitionBy("j", "i").orderBy("t"))).where("d IS NOT NULL")
    return rounded(c.select("t", "j", "i", X.wrap_angle(F.col("d")).alias("turn")), "turn")


@query("SELECT j, i, is_land OR (is_ice AND lon BETWEEN -100 AND 80 AND lat BETWEEN -76 AND -66) AS is_land, is_ice AND NOT (lon BETWEEN -100 AND 80 AND lat BETWEEN -76 AND -66) AS is_ice FROM grid")
def c6_ice_in_box_to_land(spark, sf):
    box = regions.in_box(F.col("lon"), F.col("lat"), *_BOX)
    return V.grid_xy(spark, sf).select("j", "i", (F.col("is_land") | (F.col("is_ice") & box)).alias("is_land"), (F.col("is_ice") & ~box).alias("is_ice"))


@query("""SELECT t, round(s.mean, 6) AS mean, round(s.integral, 6) AS integral, round(d.strength, 6) AS strength
FROM (SELECT t, sum((x - y) * w) / sum(w) AS mean, sum((x - y) * w) AS integral FROM cells WHERE k = 1 GROUP BY t) s
JOIN (SELECT t, avg(abs(total)) AS strength FROM (SELECT t, j, i, sum(x - y) AS total FROM cells GROUP BY ALL) GROUP BY t) d USING (t)""")
def e6_surface_series(spark, sf):
    """Area mean and integral of a difference of variables at the top level, and the mean size of its depth sum."""
    c = V.cells(spark, sf).withColumn("d", F.col("x") - F.col("y"))
    column = c.groupBy("t", "j", "i").agg(F.sum("d").alias("total"), *[F.sum(F.when(F.col("k") == 1, v)).alias(n) for v, n in ((F.col("d") * F.col("w"), "dw"), (F.col("w"), "w"))])
    out = column.groupBy("t").agg((F.sum("dw") / F.sum("w")).alias("mean"), F.sum("dw").alias("integral"), F.avg(F.abs("total")).alias("strength"))
    return rounded(out.where("mean IS NOT NULL"), "mean", "integral", "strength")


@query("""SELECT t, round(sum(h * x * w) / sum(h * w), 6) AS mean FROM (SELECT *, (1 - abs(lon - 5.0) / 18) * (1 - abs(lat + 71.5) / 2) AS h FROM cells JOIN grid USING (j, i) WHERE abs(lon - 5.0) < 18 AND abs(lat + 71.5) < 2) GROUP BY t""")
def f7_point_column_mean(spark, sf):
    """Vertical mean at one point between the cells: bilinear weights of the wet cells around it, times their volume."""
    near = V.grid_xy(spark, sf).where("abs(lon - 5.0) < 18 AND abs(lat + 71.5) < 2")
    h = near.select("j", "i", ((1 - F.abs(F.col("lon") - 5.0) / 18) * (1 - F.abs(F.col("lat") + 71.5) / 2)).alias("h"))
    out = V.cells(spark, sf).join(h, ["j", "i"]).withColumn("hw", F.col("h") * F.col("w")).groupBy("t").agg(wavg("x", "hw").alias("mean"))
    return rounded(out, "mean")


@query("""SELECT year(t) AS year, k, round(sum(x * w) / sum(w), 6) AS x FROM cells JOIN (
SELECT DISTINCT g.j, g.i FROM grid g JOIN grid n ON n.is_ice AND abs(n.j - g.j) + abs(n.i - g.i) = 1 WHERE NOT g.is_ice AND NOT g.is_land) USING (j, i) GROUP BY ALL""")
def f11_front_profiles(spark, sf):
    """Profiles along the ocean side of the ice front, by year."""
    n = regions.neighbour_count(V.grid_xy(spark, sf), F.col("is_ice"))
    front = n.where("NOT is_ice AND NOT is_land AND n_near > 0").select("j", "i")
    c = regions.apply_mask(V.cells(spark, sf), front, ["j", "i"]).groupBy(F.year("t").alias("year"), "k").agg(wavg("x", "w").alias("x"))
    return rounded(c, "x")


@query(f"SELECT k, j, i, round(sum(x * d) / sum(d), 6) AS x, round(sum(y * d) / sum(d), 6) AS y, round(sum(w * d) / sum(d), 6) AS w FROM (SELECT *, {_NOLEAP} AS d FROM cells) GROUP BY ALL")
def g4_mean_of_all_variables(spark, sf):
    """Day-weighted means of all variables over all files, years of 365 days."""
    c = V.cells(spark, sf).withColumn("_d", calendar.month_days(leap=False))
    return rounded(c.groupBy("k", "j", "i").agg(*[wavg(v, "_d").alias(v) for v in "xyw"]), "x", "y", "w")


@query(f"SELECT expt, member, year(t) AS year, round(sum(v * d) / sum(d), 6) AS v, round(sum(v2 * d) / sum(d), 6) AS v2 FROM (SELECT *, {_DAY_WEIGHT} AS d FROM series) GROUP BY ALL")
def g9_annual_with_partial_years(spark, sf):
    return rounded(calendar.annual(V.series(spark, sf), ["expt", "member"], ["v", "v2"], complete=False), "v", "v2")


@query("SELECT j, i, year(t) AS year, round(sum(x * d) / sum(d), 6) AS x FROM (SELECT *, CASE WHEN month(t) = 2 THEN 28.25 ELSE day(last_day(t)) END AS d FROM cells_xy) GROUP BY ALL")
def g13_quarter_day_february(spark, sf):
    """Annual means with 28.25 days of February in every year."""
    d = F.when(F.month("t") == 2, 28.25).otherwise(calendar.month_days().cast("double"))
    c = V.cells_xy(spark, sf).withColumn("_d", d).groupBy("j", "i", F.year("t").alias("year")).agg(wavg("x", "_d").alias("x"))
    return rounded(c, "x")


@query("""SELECT event_type, CAST(date_trunc('month', d) AS DATE) AS month, round(avg(v - bias), 6) AS v FROM (
SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2) JOIN (SELECT event_type, avg(value) - 20 AS bias FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2""", views=False)
def g14_corrected_monthly(spark, sf):
    """Daily means less the bias against a reference mean of 20, resampled to months."""
    e = V.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"), F.sum("value").alias("s"), F.count("value").alias("n"))
    whole = Window.partitionBy("event_type")  # of daily rows
    corrected = e.withColumn("v", F.col("v") - (F.sum("s").over(whole) / F.sum("n").over(whole) - 20))
    return rounded(calendar.to_month(corrected, ["event_type"], "v", "d"), "v")


_SIZES = (3, 5, 7, 9, 11, 13)
_HIGH = ", ".join(f"v - avg(v) OVER (w ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING) AS a{n}, v2 - avg(v2) OVER (w ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING) AS b{n}" for n in _SIZES)
_EACH = " UNION ALL ".join(f"SELECT expt, member, {n} AS size, regr_r2(a{n}, b{n}) AS r2 FROM high GROUP BY ALL" for n in _SIZES)


@query(f", high AS (SELECT expt, member, {_HIGH} FROM series WINDOW w AS (PARTITION BY expt, member ORDER BY t)) SELECT expt, member, arg_max(size, r2) AS size, round(max(r2), 6) AS r2 FROM ({_EACH}) GROUP BY ALL")
def m10_detrending_timescale(spark, sf):
    """The window whose removal leaves the best correlated pair of series; one shuffle and one pass for all windows."""
    w = Window.partitionBy("expt", "member").orderBy("t")
    high = lambda v, n: F.col(v) - F.avg(v).over(w.rowsBetween(-(n // 2), n // 2))
    s = V.series(spark, sf).select("expt", "member", *[high(v, n).alias(f"{v}_{n}") for n in _SIZES for v in ("v", "v2")])
    r2 = s.groupBy("expt", "member").agg(*[F.regr_r2(f"v_{n}", f"v2_{n}").alias(f"r{n}") for n in _SIZES])
    best = F.array_max(F.array(*[F.struct(F.col(f"r{n}").alias("r2"), F.lit(n).alias("size")) for n in _SIZES])).alias("best")
    return rounded(r2.select("expt", "member", best).select("expt", "member", "best.size", "best.r2"), "r2")


@query("SELECT t, k, j, i, round(x, 6) AS x FROM cells JOIN grid USING (j, i) WHERE lon >= (SELECT max(lon) FROM grid WHERE lon <= -65) AND lon <= (SELECT min(lon) FROM grid WHERE lon >= 40)")
def n2_trim_to_domain(spark, sf):
    """Slices cut to a range of longitudes, with the one point on either side that interpolation needs."""
    g = V.grid_xy(spark, sf)
    ends = g.agg(F.max(F.when(F.col("lon") <= -65, F.col("lon"))).alias("lo"), F.min(F.when(F.col("lon") >= 40, F.col("lon"))).alias("hi"))  # one row
    inside = g.join(F.broadcast(ends), F.col("lon").between(F.col("lo"), F.col("hi"))).select("j", "i")
    return rounded(regions.apply_mask(V.cells(spark, sf), inside, ["j", "i"]).select("t", "k", "j", "i", "x"), "x")


@query("SELECT expt, member, round(s, 6) AS std, row_number() OVER (PARTITION BY expt ORDER BY round(s, 6) DESC, member) AS place FROM (SELECT expt, member, stddev_samp(v) AS s FROM series GROUP BY ALL)")
def s2_members_by_variability(spark, sf):
    """Members of each experiment, the most variable first."""
    s = rounded(V.series(spark, sf).groupBy("expt", "member").agg(F.stddev_samp("v").alias("std")), "std")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("expt").orderBy(F.desc("std"), "member")))


@query("""SELECT name, t, round(a.v - b.v, 6) + 0.0 AS v FROM (SELECT t, unnest(['mean', 'top', 'spread']) AS name, unnest([sum(x * w) / sum(w), max(x), stddev_pop(x)]) AS v FROM cells WHERE i < 10 GROUP BY t) a
JOIN (SELECT t, unnest(['mean', 'top', 'spread']) AS name, unnest([sum(x * w) / sum(w), max(x), stddev_pop(x)]) AS v FROM cells WHERE i >= 10 GROUP BY t) b USING (name, t)""")
def u3_difference_of_diagnostics(spark, sf):
    """Named diagnostics of two runs (the halves of the domain), paired by time and subtracted; one scan for all."""
    own = V.cells(spark, sf).groupBy("t", (F.col("i") < 10).alias("run")).agg(wavg("x", "w").alias("mean"), F.max("x").alias("top"), F.stddev_pop("x").alias("spread"))
    long = own.unpivot(["t", "run"], ["mean", "top", "spread"], "name", "v")
    both = joins.paired(long.where("run"), long.where("NOT run"), ["name", "t"], "v")
    return rounded(both.select("name", "t", (F.col("first") - F.col("second")).alias("v")), "v")


@query("""SELECT t, round(v + sum(x * w), 4) AS volume FROM cells_xy, (SELECT sum(w) AS v FROM (SELECT avg(w) AS w FROM cells GROUP BY k, j, i)) GROUP BY t, v""")
def e12_domain_volume(spark, sf):
    """Volume of the domain with its free surface: the fixed cells' volume and the surface's height times area."""
    fixed = V.cells(spark, sf).groupBy("k", "j", "i").agg(F.avg("w").alias("w")).agg(F.sum("w").alias("v"))
    c = V.cells_xy(spark, sf).groupBy("t").agg(F.sum(F.col("x") * F.col("w")).alias("eta"))
    return rounded(c.crossJoin(fixed).select("t", (F.col("v") + F.col("eta")).alias("volume")), "volume", n=4)


@query("""SELECT c.t, c.j, c.i, round(n.x, 6) AS x FROM cells_xy c LEFT JOIN cells_xy n ON n.t = c.t AND n.i = c.i AND n.j = CASE c.j WHEN 0 THEN 1 WHEN 9 THEN 8 ELSE c.j END""")
def j5_edges_from_neighbours(spark, sf):
    """Values of the first and last row replaced by those of the rows beside them (missing where these are)."""
    c = V.cells_xy(spark, sf)
    source = F.when(F.col("j") == 0, 1).when(F.col("j") == 9, 8).otherwise(F.col("j"))
    out = c.select("t", "j", "i", source.alias("_j")).join(c.select("t", F.col("j").alias("_j"), "i", "x"), ["t", "_j", "i"], "left")
    return rounded(out.select("t", "j", "i", "x"), "x")
