"""Queries: regridding, boundaries, bias correction, merges, diagnostics, grid checks, incremental work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.operators import boundary, regions, regrid
from strataframe.plans import diagnostics
from strataframe.plans.core import query, rounded
from strataframe.sources import ingest
from strataframe.sources import views as V
from strataframe.streaming import incremental

# ---------------------------------------------------------------- regridding


def _points(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_custkey") * 7 % 360 - 180.25).cast("double").alias("lon"), (-79.5 + F.col("c_custkey") % 17).cast("double").alias("lat"))


_P = ", p AS (SELECT c_custkey, CAST(c_custkey * 7 % 360 - 180.25 AS DOUBLE) AS lon, CAST(-79.5 + c_custkey % 17 AS DOUBLE) AS lat FROM customer)"


@query(_P + """, q AS (SELECT *, CASE WHEN lon < -180 THEN lon + 360 ELSE lon END AS l FROM p),
b AS (SELECT c_custkey, CAST(floor((l + 180) / 18) AS INT) AS i0, (l + 180) / 18 - floor((l + 180) / 18) AS a, CAST(floor((lat + 80) / 2) AS INT) AS j0, (lat + 80) / 2 - floor((lat + 80) / 2) AS c FROM q),
w AS (SELECT c_custkey, (i0 + di) % 20 AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a ELSE 1 - a END) * (CASE WHEN dj = 1 THEN c ELSE 1 - c END) AS w FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(di, dj))
SELECT c_custkey, j, i, round(w, 6) AS w FROM w WHERE w > 0 AND j <= 9""")
def i2_bilinear_weights(spark, sf):
    """Sparse weights of every customer's point, periodic in longitude."""
    out = regrid.bilinear_weights(_points(spark, sf), V.grid_xy(spark, sf), ["c_custkey"], period=360.0)
    return rounded(out.where("w > 0"), "w")


@query(_P + """, q AS (SELECT *, CASE WHEN lon < -180 THEN lon + 360 ELSE lon END AS l FROM p),
b AS (SELECT c_custkey, CAST(floor((l + 180) / 18) AS INT) AS i0, (l + 180) / 18 - floor((l + 180) / 18) AS a, CAST(floor((lat + 80) / 2) AS INT) AS j0, (lat + 80) / 2 - floor((lat + 80) / 2) AS c FROM q WHERE c_custkey % 10 = 3 OR c_custkey > 1000),
w AS (SELECT c_custkey, (i0 + di) % 20 AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a ELSE 1 - a END) * (CASE WHEN dj = 1 THEN c ELSE 1 - c END) AS w FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(di, dj)),
f AS (SELECT j, i, k, avg(x) AS x FROM cells GROUP BY 1, 2, 3)
SELECT c_custkey, k, round(CASE WHEN count(*) FILTER (f.x IS NULL) = 0 THEN sum(f.x * w) END, 8) AS x FROM w JOIN (SELECT DISTINCT k FROM f) USING (true) LEFT JOIN f USING (j, i, k) WHERE w > 0 AND j <= 9 GROUP BY 1, 2""".replace("JOIN (SELECT DISTINCT k FROM f) USING (true)", "CROSS JOIN (SELECT DISTINCT k FROM f) kk").replace(" WHERE c_custkey % 10 = 3 OR c_custkey > 1000", ""))
def i3_regrid_field(spark, sf):
    """The mean field at every level, interpolated to every point."""
    f = V.cells(spark, sf).groupBy("j", "i", "k").agg(F.avg("x").alias("x"))
    w = regrid.bilinear_weights(_points(spark, sf), V.grid_xy(spark, sf), ["c_custkey"], period=360.0)
    return rounded(regrid.apply_weights(f, w, ["c_custkey"], ["j", "i"], ["x"], ["k"]), "x", n=8)


@query("SELECT t, CAST(j // 2 AS INT) AS cj, CAST(i // 2 AS INT) AS ci, round(avg(x), 6) AS x FROM cells_xy GROUP BY 1, 2, 3")
def i9_coarsen(spark, sf):
    return rounded(regrid.coarsen(V.cells_xy(spark, sf), ["t"], "x", 2), "x")


@query(""", s AS (SELECT j, i, greatest(0, least((lon - 9 + 170) / 330, (lon + 9 + 170) / 330), least((lat - 1 + 79.5) / 15, (lat + 1 + 79.5) / 15)) AS a,
least(1, greatest((lon - 9 + 170) / 330, (lon + 9 + 170) / 330), greatest((lat - 1 + 79.5) / 15, (lat + 1 + 79.5) / 15)) AS b FROM grid)
SELECT j, i, round(a * sqrt(330 * 330 + 15 * 15), 6) AS enter, round(b * sqrt(330 * 330 + 15 * 15), 6) AS leave, CAST(row_number() OVER (ORDER BY a, j, i) AS INT) AS n FROM s WHERE b > a""")
def i16_transect(spark, sf):
    return rounded(regrid.transect(V.grid_xy(spark, sf), (-170.0, -79.5), (160.0, -64.5), 18.0, 2.0), "enter", "leave")


@query(_P + """, t AS (SELECT a.j * 40 + a.i * 2 + u AS triangle, a.lon AS x1, a.lat AS y1, CASE u WHEN 0 THEN a.lon + 18 ELSE a.lon END AS x2, CASE u WHEN 0 THEN a.lat ELSE a.lat + 2 END AS y2, a.lon + 18 AS x3, a.lat + 2 AS y3 FROM grid a, (VALUES (0), (1)) q(u)),
h AS (SELECT c_custkey, triangle, ((y2 - y3) * (lon - x3) + (x3 - x2) * (lat - y3)) / ((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)) AS w1, ((y3 - y1) * (lon - x3) + (x1 - x3) * (lat - y3)) / ((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)) AS w2 FROM p, t)
SELECT c_custkey, CAST(min(triangle) AS INT) AS triangle FROM h WHERE w1 >= -1e-12 AND w2 >= -1e-12 AND 1 - w1 - w2 >= -1e-12 GROUP BY 1""")
def d8_points_in_triangles(spark, sf):
    """The mesh triangle of every customer's point (two to a grid cell)."""
    g = V.grid_xy(spark, sf)
    both = g.withColumn("u", F.explode(F.array(F.lit(0), F.lit(1))))
    up = F.col("u") == 1
    mesh = both.select(
        (F.col("j") * 40 + F.col("i") * 2 + F.col("u")).alias("triangle"), F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.when(up, F.col("lon")).otherwise(F.col("lon") + 18).alias("x2"), F.when(up, F.col("lat") + 2).otherwise(F.col("lat")).alias("y2"),
        (F.col("lon") + 18).alias("x3"), (F.col("lat") + 2).alias("y3"),
    )
    p = _points(spark, sf).withColumnRenamed("lon", "x").withColumnRenamed("lat", "y")
    return regrid.in_triangles(p, mesh, ["c_custkey"], 20.0).select("c_custkey", "triangle")


# ---------------------------------------------------------------- boundaries and budgets


@query("SELECT t, k, j, i, round(x, 6) AS x FROM cells WHERE i = (SELECT max(i) FROM cells)")
def n1_boundary_rows(spark, sf):
    return rounded(boundary.edge(V.cells(spark, sf), "east").select("t", "k", "j", "i", "x"), "x")


@query("SELECT t, round(sum(least((x - 5) * w, 0)), 6) + 0.0 AS onshore, round(sum(greatest((x - 5) * w, 0)), 6) AS offshore, round(sum((x - 5) * w), 6) + 0.0 AS net FROM cells WHERE i = 7 GROUP BY t")
def n3_transport(spark, sf):
    c = V.cells(spark, sf).where("i = 7").withColumn("u", (F.col("x") - 5) * 1e6)
    return rounded(boundary.transport(c, ["t"], "u", "w"), "onshore", "offshore", "net")


@query(""", m AS (SELECT t, k, j, i, x, y, i BETWEEN 5 AND 12 AND j BETWEEN 2 AND 7 AS ins FROM cells)
SELECT a.t, round(sum(CASE WHEN a.ins AND NOT w.ins THEN a.x WHEN NOT a.ins AND w.ins THEN -a.x ELSE 0 END + CASE WHEN a.ins AND NOT s.ins THEN a.y WHEN NOT a.ins AND s.ins THEN -a.y ELSE 0 END), 6) + 0.0 AS inflow
FROM m a LEFT JOIN m w ON w.t = a.t AND w.k = a.k AND w.j = a.j AND w.i = a.i - 1 LEFT JOIN m s ON s.t = a.t AND s.k = a.k AND s.i = a.i AND s.j = a.j - 1 GROUP BY 1""")
def n4_net_inflow(spark, sf):
    """Net flux into a box through its faces."""
    c = V.cells(spark, sf).withColumn("ins", F.col("i").between(5, 12) & F.col("j").between(2, 7))
    per_level = boundary.inflow(c, ["t", "k"], "x", "y", "ins")
    return rounded(per_level.groupBy("t").agg(F.sum("inflow").alias("inflow")), "inflow")


@query(""", f AS (SELECT year(t) AS year, i, k, j, avg(x) - 5 AS u, sum(w) AS a, CASE WHEN i = 0 THEN 1.0 ELSE -1.0 END AS s FROM cells WHERE i IN (0, 19) GROUP BY 1, 2, 3, 4), n AS (SELECT year, sum(u * a * s) AS net, sum(a) AS area FROM f GROUP BY 1)
SELECT year, i, k, j, round(u - net / area * s, 6) + 0.0 AS u FROM f JOIN n USING (year)""")
def n6_balanced_boundary(spark, sf):
    """Velocities of two open boundaries, corrected so that their net inflow vanishes each year."""
    c = V.cells(spark, sf).where("i IN (0, 19)").groupBy(F.year("t").alias("year"), "i", "k", "j").agg((F.avg("x") - 5).alias("u"), F.sum("w").alias("a"))
    c = c.withColumn("s", F.when(F.col("i") == 0, 1.0).otherwise(-1.0))
    return rounded(boundary.balance(c, ["year"], "u", "a", "s").select("year", "i", "k", "j", "u"), "u")


# ---------------------------------------------------------------- bias correction


@query(""", m AS (SELECT member, month(t) AS month, avg(v) AS m FROM series WHERE expt = 'BUILDING' GROUP BY 1, 2), r AS (SELECT member, month(t) AS month, avg(v) AS r FROM series WHERE expt = 'MACHINERY' GROUP BY 1, 2)
SELECT s.member, s.t, round(least(greatest(s.v + r.r - m.m, 100), 400), 6) AS v FROM series s JOIN m ON m.member = s.member AND m.month = month(s.t) JOIN r ON r.member = s.member AND r.month = month(s.t) WHERE s.expt = 'BUILDING'""")
def p2_anomaly_transplant(spark, sf):
    s = V.series(spark, sf).withColumn("month", F.month("t"))
    out = boundary.transplant(s.where("expt = 'BUILDING'"), s.where("expt = 'MACHINERY'"), ["member", "month"], "v", 100.0, 400.0)
    return rounded(out.select("member", "t", "v"), "v")


@query(""", m AS (SELECT j, i, avg(x) - 5 AS u, avg(y) - 4 AS v FROM cells_xy WHERE year(t) <= 1997 GROUP BY 1, 2), r AS (SELECT j, i, avg(x) - 5 AS u, avg(y) - 4 AS v FROM cells_xy WHERE year(t) > 1997 GROUP BY 1, 2),
d AS (SELECT j, i, least(sqrt(r.u * r.u + r.v * r.v) / sqrt(m.u * m.u + m.v * m.v), 3) AS scale, atan2(r.v, r.u) - atan2(m.v, m.u) AS a FROM m JOIN r USING (j, i))
SELECT j, i, round(scale, 6) AS scale, round(CASE WHEN a > pi() THEN a - 2 * pi() WHEN a <= -pi() THEN a + 2 * pi() ELSE a END, 6) + 0.0 AS turn FROM d""")
def p3_polar_correction(spark, sf):
    c = V.cells_xy(spark, sf).withColumn("u", F.col("x") - 5).withColumn("v", F.col("y") - 4)
    out = boundary.polar_correction(c.where(F.year("t") <= 1997), c.where(F.year("t") > 1997), ["j", "i"], "u", "v")
    return rounded(out, "scale", "turn")


@query(""", m AS (SELECT member, min(v) AS m0, max(v) AS m1 FROM series WHERE expt = 'BUILDING' GROUP BY 1), r AS (SELECT member, min(v) AS r0, max(v) AS r1 FROM series WHERE expt = 'MACHINERY' GROUP BY 1)
SELECT member, t, round(r0 + (v - m0) / (m1 - m0) * (r1 - r0), 6) AS v FROM series JOIN m USING (member) JOIN r USING (member) WHERE expt = 'BUILDING'""")
def p5_rescale(spark, sf):
    s = V.series(spark, sf)
    return rounded(boundary.rescale(s.where("expt = 'BUILDING'"), s.where("expt = 'MACHINERY'"), ["member"], "v").select("member", "t", "v"), "v")


# ---------------------------------------------------------------- set operations, sorts


@query("SELECT t, j, i, round(CASE WHEN j >= 5 THEN b.x ELSE a.x END, 6) AS x FROM (SELECT t, j, i, x FROM cells WHERE k = 1) a FULL JOIN (SELECT t, j, i, x FROM cells WHERE k = 2) b USING (t, j, i)")
def r3_merge_where(spark, sf):
    c = V.cells(spark, sf)
    part = lambda k: c.where(F.col("k") == k).select("t", "j", "i", "x")
    return rounded(boundary.merge_where(part(1), part(2), ["t", "j", "i"], ["x"], F.col("j") >= 5), "x")


@query(""", o AS (SELECT p_partkey, CAST(p_size AS INT) AS v FROM part), e AS (SELECT l_partkey AS p_partkey, CAST(CASE WHEN l_linenumber = 7 THEN 99 WHEN l_linenumber = 6 AND l_tax > 0.05 THEN 77 ELSE p_size END AS INT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT p_partkey, min(e.v) AS nv, count(DISTINCT e.v) > 1 AS clash FROM e JOIN o USING (p_partkey) WHERE e.v <> o.v GROUP BY 1)
SELECT p_partkey, coalesce(nv, v) AS v, coalesce(clash, false) AS conflict FROM o LEFT JOIN c USING (p_partkey)""")
def r4_merge_edits(spark, sf):
    o = V.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("int").alias("v"))
    l = V.table(spark, sf, "lineitem").join(o, F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    new = F.when(F.col("l_linenumber") == 7, 99).when((F.col("l_linenumber") == 6) & (F.col("l_tax") > 0.05), 77).otherwise(F.col("v"))
    return boundary.merge_edits(o, l.select("p_partkey", new.cast("int").alias("v")), ["p_partkey"], "v")


@query("SELECT expt, member, t, v2 FROM (SELECT *, row_number() OVER (PARTITION BY expt, member ORDER BY t DESC) AS n FROM series) WHERE n <= 12")
def s3_last_records(spark, sf):
    s = V.series(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("expt", "member").orderBy(F.desc("t"))))
    return s.where("n <= 12").select("expt", "member", "t", "v2")


@query("SELECT k, j, i, 'x' AS name, round(avg(x), 6) AS value FROM cells GROUP BY 1, 2, 3 UNION ALL SELECT k, j, i, 'y', round(avg(y), 6) FROM cells GROUP BY 1, 2, 3")
def a14_long_form(spark, sf):
    f = V.cells(spark, sf).groupBy("k", "j", "i").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(ingest.unpivot(f, ["k", "j", "i"], ["x", "y"]), "value")


# ---------------------------------------------------------------- diagnostics


_HIT = """, hit AS (SELECT DISTINCT name AS region, j, i FROM grid JOIN regions ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax), own AS (SELECT * FROM cells JOIN levels USING (k) JOIN hit USING (j, i))"""
NAMES = ["west_x_avg", "east_x_int_btw_100_250m", "middle_y_max", "two_part_x_above_5", "narrow_y_avg_btw_0_150m"]


@query(_HIT + """ SELECT t, 'west_x_avg' AS name, round(sum(x * w) / sum(w), 6) AS value FROM own WHERE region = 'west' GROUP BY t
UNION ALL SELECT t, 'east_x_int_btw_100_250m', round(sum(x * w), 6) FROM own WHERE region = 'east' AND z BETWEEN -250 AND -100 GROUP BY t
UNION ALL SELECT t, 'middle_y_max', round(max(y), 6) FROM own WHERE region = 'middle' GROUP BY t
UNION ALL SELECT t, 'two_part_x_above_5', round(100 * sum(CASE WHEN x >= 5 THEN w ELSE 0 END) / sum(w), 6) FROM own WHERE region = 'two_part' GROUP BY t
UNION ALL SELECT t, 'narrow_y_avg_btw_0_150m', round(sum(y * w) / sum(w), 6) FROM own WHERE region = 'narrow' AND z BETWEEN -150 AND 0 GROUP BY t""")
def u2_named_diagnostics(spark, sf):
    """Five names, one scan and one aggregate."""
    masks = regions.restrict(V.grid_xy(spark, sf), V.regions(spark)).select("region", "j", "i")
    return rounded(diagnostics.compute(V.cells(spark, sf), masks, V.levels(spark, sf), NAMES), "value")


@query("SELECT t, j, i, round(max_by(x, k), 6) AS bottom, round(max(max_by(x, k)) OVER (PARTITION BY t), 6) AS largest FROM cells GROUP BY t, j, i")
def u5_bottom_fields(spark, sf):
    b = V.cells(spark, sf).groupBy("t", "j", "i").agg(F.max_by("x", "k").alias("bottom"))
    return rounded(b.withColumn("largest", F.max("bottom").over(Window.partitionBy("t"))), "bottom", "largest")


# ---------------------------------------------------------------- grid checks


@query(""", wet AS (SELECT j, i, k, bathy < z AS wet FROM grid, levels), deep AS (SELECT j, i, max(k) AS k FROM wet WHERE wet GROUP BY 1, 2)
SELECT d.j, d.i, d.k FROM deep d WHERE NOT EXISTS (SELECT 1 FROM wet n WHERE n.wet AND n.k = d.k AND abs(n.i - d.i) + abs(n.j - d.j) = 1)""")
def v1_isolated_bottom_cells(spark, sf):
    cells = V.grid_xy(spark, sf).join(F.broadcast(V.levels(spark, sf))).select("j", "i", "k", (F.col("bathy") < F.col("z")).alias("wet"))
    return boundary.isolated_bottom(cells, [], "wet")


@query("SELECT a.j, a.i, greatest(a.bathy, coalesce((SELECT min(n.bathy) FROM grid n WHERE abs(n.i - a.i) + abs(n.j - a.j) = 1), a.bathy)) AS bathy FROM grid a")
def v2_fill_isolated(spark, sf):
    return boundary.fill_isolated(V.grid_xy(spark, sf)).select("j", "i", "bathy")


@query("""SELECT a.j, a.i, CASE WHEN low < 0 THEN least(bathy, low - 100) ELSE bathy END AS bathy FROM (SELECT g.j, g.i, g.bathy, least(g.draft, coalesce((SELECT min(n.draft) FROM grid n WHERE abs(n.i - g.i) + abs(n.j - g.j) = 1), 0)) AS low FROM grid g) a""")
def v3_dig(spark, sf):
    return boundary.dig(V.grid_xy(spark, sf), 100.0).select("j", "i", "bathy")


@query("SELECT j, i, CASE WHEN draft < 0 AND draft > -60 THEN -60.0 ELSE draft END + 0.0 AS draft FROM grid")
def v4_thicken_thin_ice(spark, sf):
    return boundary.zap_thin(V.grid_xy(spark, sf), 60.0, grow=True).select("j", "i", (F.col("draft") + 0.0).alias("draft"))


# ---------------------------------------------------------------- incremental


@query("SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS TIMESTAMP) AS start, cell, round(avg(v), 6) AS mean, count(v) AS n FROM forcing GROUP BY 1, 2")
def t5_windowed_mean(spark, sf):
    """The batch twin of the streaming windowed mean."""
    f = V.forcing(spark, sf)
    out = incremental.windowed_mean(f, "ts", ["cell"], "v")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "mean")
