"""Queries: sources and segments, points and slices, initial and boundary conditions, corrections in property space, incremental output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataframe.functions import constants as K
from strataframe.functions import expr as X
from strataframe.operators import binning, boundary, columns, fill, joins, regions, regrid, stencil
from strataframe.plans import diagnostics
from strataframe.plans.core import query, rounded
from strataframe.plans.cuts import cutter, shared_dir
from strataframe.plans.spaces import _HIT, _P, NAMES, _points
from strataframe.sources import binary, ingest
from strataframe.sources import views as V
from strataframe.streaming import incremental

_RUN = ["expt", "member"]

#: Bilinear weights of every customer's point, periodic in longitude.
_W = _P + """, q AS (SELECT *, CASE WHEN lon < -180 THEN lon + 360 ELSE lon END AS l FROM p),
b AS (SELECT c_custkey, CAST(floor((l + 180) / 18) AS INT) AS i0, (l + 180) / 18 - floor((l + 180) / 18) AS a, CAST(floor((lat + 80) / 2) AS INT) AS j0, (lat + 80) / 2 - floor((lat + 80) / 2) AS c FROM q),
wts AS (SELECT * FROM (SELECT c_custkey, (i0 + di) % 20 AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a ELSE 1 - a END) * (CASE WHEN dj = 1 THEN c ELSE 1 - c END) AS w FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(di, dj)) WHERE w > 0 AND j <= 9)"""


def _weights(spark, sf):
    return regrid.bilinear_weights(_points(spark, sf), V.grid_xy(spark, sf), ["c_custkey"], period=360.0).where("w > 0")


def _mean(spark, sf, *values):
    return V.cells(spark, sf).groupBy("k", "j", "i").agg(*[F.avg(v).alias(v) for v in values])


def _place(spark, name: str) -> str:
    """A new place in the shared folder for the output of one run of a query."""
    return f"{shared_dir(spark)}/outputs/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and segments


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY expt, member ORDER BY t) - 1 AS n FROM series) SELECT expt, member, year(t) AS year, CAST(min(n) AS INT) AS first_record, CAST(max(n) AS INT) AS last_record FROM n GROUP BY 1, 2, 3""")
def a8_record_ranges(spark, sf):
    """Where the years of every member's run stand among its records."""
    return ingest.record_ranges(V.series(spark, sf), _RUN)


@query("SELECT (year(t) - 1992) * 12 + month(t) - 1 AS t, k, j, i, round(x, 6) AS x FROM cells")
def a9_raw_arrays(spark, sf):
    """The field written as headerless big-endian arrays, twelve months to a file, and read again by ranges of bytes."""
    c = V.cells(spark, sf).select(((F.year("t") - 1992) * 12 + F.month("t") - 1).alias("t"), "k", "j", "i", "x")
    layout, path = binary.Layout("tzyx", {"z": 8, "y": 10, "x": 20}, "x", bits=64), _place(spark, "arrays")
    binary.write_arrays(c, path, layout, 12)
    back = binary.read_arrays(spark, path, layout, split_bytes=1 << 16)
    return rounded(back.where("x IS NOT NULL").select(F.col("t").cast("long").alias("t"), "k", "j", "i", "x"), "x")


@query("SELECT year(t) AS year, count(*) AS n, round(sum(w), 2) AS w FROM cells_xy GROUP BY 1")
def a10_written_field(spark, sf):
    """A field written by year and read again, by partition."""
    path = _place(spark, "field")
    ingest.write_field(V.cells_xy(spark, sf).withColumn("year", F.year("t")), path, ["year"])
    return rounded(spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")), "w", n=2)


@query("SELECT year(t) AS segment, min(t) AS first, max(t) AS last, count(DISTINCT t) AS n_times, true AS on_disk, CAST(row_number() OVER (ORDER BY year(t)) AS INT) AS place FROM cells_xy GROUP BY 1")
def a11_segments_in_order(spark, sf):
    """The segments of a written run in chronological order."""
    path = _place(spark, "run")
    ingest.write_field(V.cells_xy(spark, sf).withColumn("segment", F.year("t")), path, ["segment"])
    return ingest.segments(spark.read.parquet(path), "segment", "t").withColumn("on_disk", F.col("files") > 0).drop("files")


@query("SELECT t, round(avg(x), 6) AS temp, round(avg(CASE WHEN year(t) % 2 = 1 THEN y END), 6) AS salt, count(*) AS n FROM cells_xy GROUP BY 1")
def a12_aliased_variables(spark, sf):
    """Two kinds of files that name a variable differently, one of which lacks another."""
    c = V.cells_xy(spark, sf)
    even = c.where("year(t) % 2 = 0").select("t", F.col("x").alias("toce"))
    odd = c.where("year(t) % 2 = 1").select("t", F.col("x").alias("thetao"), F.col("y").alias("so"))
    both = ingest.with_aliases(even.unionByName(odd, True), {"temp": ["toce", "thetao", "THETA"], "salt": ["so", "SALT"], "age": ["agessc"]})
    return rounded(both.groupBy("t").agg(F.avg("temp").alias("temp"), F.avg("salt").alias("salt"), F.count(F.lit(1)).alias("n")), "temp", "salt")


@query(_P + """, v AS (SELECT p.*, CAST(c_acctbal AS DOUBLE) AS v FROM p JOIN customer USING (c_custkey)) SELECT CAST(dense_rank() OVER (ORDER BY lat) - 1 AS INT) AS j, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INT) AS i, lon, lat, round(avg(v), 6) AS v, count(*) AS n FROM v GROUP BY lon, lat""")
def a13_text_observations(spark, sf):
    """Observations written as separated text, read again and laid on the grid of their distinct coordinates."""
    path = _place(spark, "text")
    v = V.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    _points(spark, sf).join(v, "c_custkey").select("lon", "lat", "v").write.option("sep", " ").csv(path)
    grid = ingest.points_to_grid(ingest.read_points(spark, path, ["lon", "lat", "v"]), cutter(spark))
    return rounded(grid.groupBy("j", "i", "lon", "lat").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")), "v")


@query("SELECT year(t) <= 1998 AS early, t, count(*) AS n, round(sum(w), 2) AS w FROM cells_xy GROUP BY 1, 2")
def r1_concatenated(spark, sf):
    """Two files along time as one, whatever the order of their columns."""
    c = V.cells_xy(spark, sf).select("t", "w", (F.year("t") <= 1998).alias("early"))
    both = c.where("early").unionByName(c.where("NOT early").select("early", "w", "t"))
    return rounded(both.groupBy("early", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")), "w", n=2)


@query("SELECT expt, member, min(t) AS first, CAST(row_number() OVER (ORDER BY min(t), expt, member) AS INT) AS place FROM series GROUP BY 1, 2")
def s1_chronological_runs(spark, sf):
    """Runs in order of their first record."""
    from pyspark.sql import Window

    runs = V.series(spark, sf).groupBy(*_RUN).agg(F.min("t").alias("first"))
    return runs.withColumn("place", F.row_number().over(Window.orderBy("first", *_RUN)))  # one row per run


# ---------------------------------------------------------------- scalar


@query(""", p AS (SELECT *, radians(-lon) AS lam, radians(-lat) AS phi, radians(71.0) AS c, 0.08181919 AS e FROM grid),
q AS (SELECT *, tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) AS t, tan(pi() / 4 - c / 2) / pow((1 - e * sin(c)) / (1 + e * sin(c)), e / 2) AS tc, cos(c) / sqrt(1 - pow(e * sin(c), 2)) AS mc FROM p)
SELECT j, i, round(CASE WHEN j < 5 THEN -6378137.0 * mc * t / tc * sin(lam) ELSE lon END, 3) + 0.0 AS x, round(CASE WHEN j < 5 THEN 6378137.0 * mc * t / tc * cos(lam) ELSE lat END, 3) + 0.0 AS y FROM q""")
def b5_projection_switch(spark, sf):
    """Projected in the south, degrees in the north."""
    x, y = X.polar_stereographic("lon", "lat")
    south = F.col("j") < 5
    return rounded(V.grid_xy(spark, sf).select("j", "i", F.when(south, x).otherwise(F.col("lon")).alias("x"), F.when(south, y).otherwise(F.col("lat")).alias("y")), "x", "y", n=3)


def _poly_sql(coefficients, x: str) -> str:
    return "(" + " + ".join(f"{c!r} * pow({x}, {n})" for n, c in enumerate(coefficients)) + ")"


def _terms_sql(terms) -> str:
    return "(" + " + ".join(f"{c!r} * pow(t, {a}) * pow(s, {b}) * pow(p, {d})" for c, a, b, d in terms) + ")"


@query(f""", c AS (SELECT k, x AS t, 30 + y AS s, (50.0 * k - 25) AS p FROM cells),
u AS (SELECT *, {_poly_sql(K.JMD95_FRESH, 't')} + s * {_poly_sql(K.JMD95_SALT, 't')} + pow(s, 1.5) * {_poly_sql(K.JMD95_SALT_ROOT, 't')} + s * s * {K.JMD95_SALT_SQUARE!r} AS surface,
{_poly_sql(K.JMD95_BULK_FRESH, 't')} + s * {_poly_sql(K.JMD95_BULK_SALT, 't')} + pow(s, 1.5) * {_poly_sql(K.JMD95_BULK_SALT_ROOT, 't')}
+ p / 10 * ({_poly_sql(K.JMD95_BULK_PRESS, 't')} + s * {_poly_sql(K.JMD95_BULK_PRESS_SALT, 't')} + pow(s, 1.5) * {K.JMD95_BULK_PRESS_SALT_ROOT!r})
+ p * p / 100 * ({_poly_sql(K.JMD95_BULK_PRESS2, 't')} + s * {_poly_sql(K.JMD95_BULK_PRESS2_SALT, 't')}) AS bulk, {_terms_sql(K.MDJWF_ABOVE)} / {_terms_sql(K.MDJWF_BELOW)} AS m FROM c)
SELECT k, round(avg(surface / (1 - p / 10 / bulk)), 6) AS jmd95, round(avg(m), 6) AS mdjwf FROM u GROUP BY k""")
def b10_nonlinear_density(spark, sf):
    """Two published equations of state, by level."""
    c = V.cells(spark, sf).withColumn("p", 50.0 * F.col("k") - 25).withColumn("s", 30 + F.col("y"))
    out = c.groupBy("k").agg(F.avg(X.density_jmd95("x", "s", "p")).alias("jmd95"), F.avg(X.density_mdjwf("x", "s", "p")).alias("mdjwf"))
    return rounded(out, "jmd95", "mdjwf")


# ---------------------------------------------------------------- points, slices and sections


@query(_P + """, b AS (SELECT c_custkey, CAST(floor((lat + 80) / 2) AS INT) AS j0, (lat + 80) / 2 - floor((lat + 80) / 2) AS c FROM p)
SELECT c_custkey, j0 + d AS j, round(CASE WHEN d = 1 THEN c ELSE 1 - c END, 6) AS w FROM b, (VALUES (0), (1)) s(d) WHERE CASE WHEN d = 1 THEN c ELSE 1 - c END > 0""")
def i1_bracket(spark, sf):
    """The two latitudes around every customer's point, and their weights."""
    axis = V.grid_xy(spark, sf).select("j", F.col("lat").alias("g")).distinct()
    return rounded(regrid.bracket(_points(spark, sf).select("c_custkey", "lat"), axis, "lat", "g", "j").select("c_custkey", "j", "w").where("w > 0"), "w")


@query(_W + """, h AS (SELECT j, i, CASE WHEN raw < lim / 2 THEN 0 WHEN raw < lim THEN lim ELSE raw END AS hfac FROM (SELECT j, i, (least(z_top, draft) - greatest(z_bot, bathy)) / 50 AS raw, greatest(0.1, least(20.0 / dz, 1)) AS lim FROM grid, levels WHERE k = 3)),
f AS (SELECT j, i, avg(x) AS x FROM cells GROUP BY 1, 2)
SELECT c_custkey, round(CASE WHEN count(f.x) = count(*) THEN sum(f.x * w) END, 8) AS x, round(CASE WHEN min(coalesce(hfac, 0)) <= 0 THEN 0 ELSE sum(hfac * w) END, 8) + 0.0 AS hfac FROM wts LEFT JOIN f USING (j, i) LEFT JOIN h USING (j, i) GROUP BY 1""")
def i4_value_at_points(spark, sf):
    """A field and the open fraction at points; a dry corner closes the point."""
    w = _weights(spark, sf)
    f = V.cells(spark, sf).groupBy("j", "i").agg(F.avg("x").alias("x"))
    g = V.grid_xy(spark, sf).join(F.broadcast(V.levels(spark, sf).where("k = 3")))
    hfac = regrid.point_open_fraction(w, g.select("j", "i", X.open_fraction("bathy", "draft", "z_top", "z_bot").alias("hfac")), ["c_custkey"])
    return rounded(hfac.join(regrid.apply_weights(f, w, ["c_custkey"], ["j", "i"], ["x"], []), "c_custkey", "left").select("c_custkey", "x", "hfac"), "x", "hfac", n=8)


@query(_P + """, s AS (SELECT p.*, CAST(c_acctbal AS DOUBLE) AS v FROM p JOIN customer USING (c_custkey)), d AS (SELECT j, i, v, row_number() OVER (PARTITION BY j, i ORDER BY (grid.lon - s.lon) * (grid.lon - s.lon) + (grid.lat - s.lat) * (grid.lat - s.lat), c_custkey) AS n FROM grid, s)
SELECT j, i, v FROM d WHERE n = 1""")
def i5_scattered_to_grid(spark, sf):
    """Every column takes the value of the nearest scattered point."""
    v = V.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    g = V.grid_xy(spark, sf).select("j", "i", "lon", "lat")
    return joins.nearest_value(g, _points(spark, sf).join(v, "c_custkey"), "v", "c_custkey", cutter(spark)).select("j", "i", "v")


_SECTION = """, f AS (SELECT k, j, avg(x) AS x FROM cells WHERE i = 0 GROUP BY 1, 2), all_kj AS (SELECT k, j, x FROM (SELECT DISTINCT k FROM cells) CROSS JOIN (SELECT DISTINCT j FROM f) LEFT JOIN f USING (k, j)),
full_kj AS (SELECT k, j, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM all_kj)"""


@query(_SECTION + " SELECT a.k, a.j, round((a.x + b.x + c.x + d.x) / 4, 8) AS x FROM full_kj a JOIN full_kj b ON b.k = a.k + 1 AND b.j = a.j JOIN full_kj c ON c.k = a.k AND c.j = a.j + 1 JOIN full_kj d ON d.k = a.k + 1 AND d.j = a.j + 1")
def i6_boundary_section(spark, sf):
    """A boundary section filled up and down its columns, then interpolated between both axes; a value still missing fails the job."""
    f = V.cells(spark, sf).where("i = 0").groupBy("k", "j").agg(F.avg("x").alias("x"))
    levels, rows = V.levels(spark, sf).select("k", "z"), f.select("j").distinct()
    dense = rows.crossJoin(levels.select("k")).join(f, ["k", "j"], "left")  # the section's own grid
    filled = fill.whole(fill.along(dense, ["j"], "x", "k"), "x")
    mid_z = levels.select(F.col("k").alias("tk"), (F.col("z") - 25).alias("tz")).where(F.col("tk") < 7)
    mid_j = rows.select(F.col("j").alias("tj"), (F.col("j") + 0.5).alias("tlat"))
    wk = regrid.bracket(mid_z, levels, "tz", "z", "k").withColumnRenamed("w", "wk")
    wj = regrid.bracket(mid_j, rows.withColumn("lat", F.col("j").cast("double")), "tlat", "lat", "j").withColumnRenamed("w", "wj")
    both = wk.crossJoin(wj).select("tk", "tj", "k", "j", (F.col("wk") * F.col("wj")).alias("w"))  # two axes of one section
    out = regrid.apply_weights(filled, both, ["tk", "tj"], ["k", "j"], ["x"], [])
    return rounded(out.select(F.col("tk").alias("k"), F.col("tj").alias("j"), "x"), "x", n=8)


@query(""", g AS (SELECT j, i, lon + 0.7 * j AS c, lead(i) OVER w AS i2, lead(lon + 0.7 * j) OVER w AS d FROM grid WINDOW w AS (PARTITION BY j ORDER BY i)), x AS (SELECT j, i, i2, (35.0 - c) / (d - c) AS r FROM g WHERE c <= 35 AND d > 35),
w AS (SELECT j, i, 1 - r AS w FROM x UNION ALL SELECT j, i2, r FROM x WHERE r > 0), f AS (SELECT k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3)
SELECT kk.k, w.j, round(sum(f.x * w.w), 8) AS x FROM w CROSS JOIN (SELECT DISTINCT k FROM f) kk LEFT JOIN f ON f.j = w.j AND f.i = w.i AND f.k = kk.k GROUP BY 1, 2 HAVING count(f.x) = count(*)""")
def i7_curvilinear_slice(spark, sf):
    """The section along a meridian of a grid whose longitudes lean with latitude."""
    g = V.grid_xy(spark, sf).withColumn("lon2", F.col("lon") + 0.7 * F.col("j"))
    w = regrid.crossing_weights(g, ["j"], "i", "lon2", 35.0).withColumn("row", F.col("j"))
    out = regrid.apply_weights(_mean(spark, sf, "x"), w, ["row"], ["j", "i"], ["x"], ["k"])
    return rounded(out.where("x IS NOT NULL").select("k", F.col("row").alias("j"), "x"), "x", n=8)


@query(""", w(j, w) AS (VALUES (4, 0.65::DOUBLE), (5, 0.35)), f AS (SELECT k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3) SELECT k, i, round(CASE WHEN count(*) = 2 THEN sum(x * w) END, 8) AS x FROM f JOIN w USING (j) GROUP BY 1, 2""")
def i8_slice_by_weights(spark, sf):
    """The section at a latitude between two rows; missing if a contributor is."""
    axis = V.grid_xy(spark, sf).select("j", F.col("lat").alias("g")).distinct()
    w = regrid.bracket(axis.limit(1).select(F.lit(-71.3).alias("lat")), axis, "lat", "g", "j").select("lat", "j", "w")
    return rounded(regrid.apply_weights(_mean(spark, sf, "x"), w, ["lat"], ["j"], ["x"], ["k", "i"]).select("k", "i", "x"), "x", n=8)


@query(""", s AS (SELECT j, i, a * 4 + b AS sub, lon + ((a + 0.5) / 4 - 0.5) * 18 AS lon, lat + ((b + 0.5) / 4 - 0.5) * 2 AS lat FROM grid, (SELECT unnest(range(4)) AS a) x, (SELECT unnest(range(4)) AS b) y),
q AS (SELECT *, CASE WHEN lon < -180 THEN lon + 360 ELSE lon END AS l FROM s WHERE lat BETWEEN -80 AND -62),
c AS (SELECT j, i, sub, CAST(floor((l + 180) / 18) AS INT) AS i0, (l + 180) / 18 - floor((l + 180) / 18) AS a, CAST(floor((lat + 80) / 2) AS INT) AS j0, (lat + 80) / 2 - floor((lat + 80) / 2) AS b FROM q),
v AS (SELECT c.j, c.i, c.sub, sum(g.bathy * (CASE WHEN di = 1 THEN a ELSE 1 - a END) * (CASE WHEN dj = 1 THEN b ELSE 1 - b END)) AS v FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(di, dj), grid g WHERE g.i = (i0 + di) % 20 AND g.j = j0 + dj GROUP BY 1, 2, 3)
SELECT j, i, round(avg(v), 6) AS bathy, count(*) AS n FROM v GROUP BY 1, 2""")
def i10_sub_cell_average(spark, sf):
    """The mean of a surface inside each cell, from 4 x 4 bilinear samples."""
    g = V.grid_xy(spark, sf)
    pts = regrid.sub_points(g.select(F.col("j").alias("tj"), F.col("i").alias("ti"), "lon", "lat"), 4, 18.0, 2.0)
    w = regrid.bilinear_weights(pts, g, ["tj", "ti", "sub"], period=360.0)
    v = regrid.apply_weights(g.select("j", "i", "bathy"), w, ["tj", "ti", "sub"], ["j", "i"], ["bathy"], [])
    return rounded(v.groupBy(F.col("tj").alias("j"), F.col("ti").alias("i")).agg(F.avg("bathy").alias("bathy"), F.count("bathy").alias("n")), "bathy")


_FIELD3 = """, f AS (SELECT k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3), d AS (SELECT k, g.j, g.i, is_ice, is_land, bathy, x FROM grid g CROSS JOIN (SELECT DISTINCT k FROM f) kk LEFT JOIN f USING (k, j, i)),
e AS (SELECT d.k, d.j, d.i, d.is_ice, d.is_land, d.bathy, coalesce(d.x, (SELECT avg(n.x) FROM d n WHERE n.k = d.k AND abs(n.j - d.j) + abs(n.i - d.i) = 1)) AS x FROM d)"""


def _extended(spark, sf):
    """The mean field at every column and level, missing cells taking the mean of their neighbours."""
    f = _mean(spark, sf, "x")
    return fill.extend_once(fill.dense(f, V.grid_xy(spark, sf), ["k"], "x"), ["k"], "x")


@query(_W + _FIELD3 + """, s AS (SELECT c_custkey, k, sum(x * w) AS x FROM wts JOIN e USING (j, i) GROUP BY 1, 2 HAVING count(x) = count(*) AND NOT bool_or(is_land))
SELECT a.c_custkey, round(0.6 * a.x + 0.4 * b.x, 8) AS x FROM s a JOIN s b USING (c_custkey) WHERE a.k = 2 AND b.k = 3""")
def i11_regrid_with_mask(spark, sf):
    """Extrapolated into the mask, regridded across, interpolated to a depth, and masked again where a corner is land."""
    g, w = V.grid_xy(spark, sf), _weights(spark, sf)
    across = regrid.apply_weights(_extended(spark, sf), w, ["c_custkey"], ["j", "i"], ["x"], ["k"])
    at = columns.at_depth(across, V.levels(spark, sf), ["c_custkey"], "x", -95.0)
    land = w.join(g.where("is_land").select("j", "i"), ["j", "i"]).select("c_custkey").distinct()
    return rounded(regions.apply_mask(at, land, ["c_custkey"], keep=False), "x", n=8)


@query(_W + """, f AS (SELECT t, j, i, k, x, CASE k WHEN 2 THEN 0.6 ELSE 0.4 END AS wk FROM cells WHERE k IN (2, 3))
SELECT t, c_custkey, round(CAST(sum(CAST(x * w * wk AS DECIMAL(30, 12))) AS DOUBLE) / CAST(sum(CAST(w * wk AS DECIMAL(30, 12))) AS DOUBLE), 6) AS x, round(CAST(sum(CAST(w * wk AS DECIMAL(30, 12))) AS DOUBLE), 6) AS weight FROM wts JOIN f USING (j, i) GROUP BY 1, 2 HAVING CAST(sum(CAST(w * wk AS DECIMAL(30, 12))) AS DOUBLE) >= 0.3""")
def i12_weight_threshold(spark, sf):
    """Sums of value times weight over sums of weight, in three dimensions, where enough weight is there; summed in fixed decimals, so that order does not matter."""
    levels = V.levels(spark, sf).select("k", F.col("z").alias("g"))
    wk = regrid.bracket(levels.limit(1).select(F.lit(-95.0).alias("z")), levels, "z", "g", "k").select("k", F.col("w").alias("wk"))
    f = V.cells(spark, sf).select("t", "j", "i", "k", "x").join(F.broadcast(wk), "k")
    own = regrid.gather(f, _weights(spark, sf), ["c_custkey"], ["j", "i"], ["x", "wk"], ["t"])
    exact = lambda c: c.cast("decimal(30,12)")
    both = regrid.sums(own, ["t", "c_custkey"], {"xw": lambda h, w: exact(h["x"] * w * h["wk"]), "w": lambda h, w: exact(w * h["wk"])}, "decimal(34,12)")
    weight = F.col("w").cast("double")
    out = both.select("t", "c_custkey", (F.col("xw").cast("double") / weight).alias("x"), weight.alias("weight")).where("weight >= 0.3")
    return rounded(out, "x", "weight")


_INITIAL = _W + _FIELD3 + """, o AS (SELECT c_custkey, k, CASE WHEN sum(bathy * w) > -50.0 * k + 25 THEN 0 ELSE sum(CASE WHEN is_ice THEN -1.9 ELSE x END * w) END AS x, count(CASE WHEN is_ice THEN -1.9 ELSE x END) = count(*) OR sum(bathy * w) > -50.0 * k + 25 AS ok FROM wts JOIN e USING (j, i) GROUP BY 1, 2)"""


def _initial(spark, sf, field):
    """Cavities set, then across by weights; 0 below the sea floor."""
    g, w = V.grid_xy(spark, sf), _weights(spark, sf)
    set_ = field.join(g.select("j", "i", "is_ice"), ["j", "i"]).withColumn("x", F.when(F.col("is_ice"), -1.9).otherwise(F.col("x"))).drop("is_ice")
    across = regrid.apply_weights(set_, w, ["c_custkey"], ["j", "i"], ["x"], ["k"])
    floor = regrid.apply_weights(g.select("j", "i", "bathy"), w, ["c_custkey"], ["j", "i"], ["bathy"], [])
    at = across.join(floor, "c_custkey").join(V.levels(spark, sf).select("k", "z"), "k")
    return at.select("c_custkey", "k", F.when(F.col("bathy") > F.col("z"), 0.0).otherwise(F.col("x")).alias("x"))


@query(_INITIAL + " SELECT c_custkey, k, round(x, 9) + 0.0 AS x FROM o WHERE ok")
def i13_initial_field(spark, sf):
    """An initial field: filled, cavities set, interpolated, 0 in dry cells."""
    return rounded(_initial(spark, sf, _extended(spark, sf)).where("x IS NOT NULL"), "x", n=9)


@query(_W + """, m AS (SELECT month(t) AS month, j, i, avg(x) AS x FROM cells_xy GROUP BY 1, 2, 3) SELECT c_custkey, mm.month, round(coalesce(CASE WHEN count(m.x) = count(*) THEN sum(m.x * w) END, 0), 8) AS x FROM wts CROSS JOIN (SELECT DISTINCT month FROM m) mm LEFT JOIN m USING (month, j, i) GROUP BY 1, 2""")
def i14_forcing_climatology(spark, sf):
    """A monthly climatology at points, 0 where the source has none."""
    m = V.cells_xy(spark, sf).groupBy(F.month("t").alias("month"), "j", "i").agg(F.avg("x").alias("x"))
    w = _weights(spark, sf)
    out = regrid.apply_weights(m, w, ["c_custkey"], ["j", "i"], ["x"], ["month"])
    every = w.select("c_custkey").distinct().crossJoin(m.select("month").distinct())  # that is the result's own grid
    return rounded(every.join(out, ["c_custkey", "month"], "left").select("c_custkey", "month", F.coalesce("x", F.lit(0.0)).alias("x")), "x", n=8)


@query("SELECT t, j, round(x, 6) AS x FROM cells_xy WHERE i = (SELECT arg_min(i, abs(lon - 33.3)) FROM grid)")
def i15_nearest_slice(spark, sf):
    """The column of cells nearest to a longitude."""
    axis = V.grid_xy(spark, sf).select("i", "lon").distinct()
    at = axis.agg(F.min_by("i", F.struct(F.abs(F.col("lon") - 33.3), "i")).alias("_i"))  # one row
    c = V.cells_xy(spark, sf).join(F.broadcast(at), F.col("i") == F.col("_i"))
    return rounded(c.select("t", "j", "x"), "x")


@query(""", ext AS (SELECT min(j) AS j0, max(j) AS j1, min(i) AS i0, max(i) AS i1 FROM grid), near AS (SELECT g.j, g.i, g.lon, g.lat, g.is_ice, g.is_land, n.is_ice AS ni, n.is_land AS nl FROM grid g, ext, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dj, di) LEFT JOIN grid n ON n.j = least(greatest(g.j + dj, j0), j1) AND n.i = least(greatest(g.i + di, i0), i1)),
front AS (SELECT DISTINCT j, i, lon, lat, j * 20 + i AS n FROM near WHERE is_ice AND NOT is_land AND NOT ni AND NOT nl), r(a, b) AS (SELECT n, n FROM front UNION SELECT r.a, y.n FROM r JOIN front x ON x.n = r.b JOIN front y ON abs(x.i - y.i) + abs(x.j - y.j) = 1),
c AS (SELECT front.*, b AS component FROM front JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) q ON a = n), e AS (SELECT component, min(lon) AS x0, arg_min(lat, [lon, lat]) AS y0, max(lon) AS x1, arg_max(lat, [lon, lat]) AS y1 FROM c GROUP BY 1)
SELECT component, j, i, CAST(row_number() OVER (PARTITION BY component ORDER BY (lon - x0) * (x1 - x0) + (lat - y0) * (y1 - y0), j, i) AS INT) AS place FROM c JOIN e USING (component)""")
def i17_front_in_order(spark, sf):
    """The ice-front cells of every connected piece, ordered along the line between its ends."""
    from pyspark.sql import Window

    g = V.grid_xy(spark, sf)
    front = regions.ice_front(g).select("j", "i")
    own = fill.components(front, 20, cutter(spark)).join(g.select("j", "i", "lon", "lat"), ["j", "i"])
    ends = own.groupBy("component").agg(F.min(F.struct("lon", "lat")).alias("a"), F.max(F.struct("lon", "lat")).alias("b"))
    along = (F.col("lon") - F.col("a.lon")) * (F.col("b.lon") - F.col("a.lon")) + (F.col("lat") - F.col("a.lat")) * (F.col("b.lat") - F.col("a.lat"))
    out = own.join(ends, "component").withColumn("d", along)
    return out.select("component", "j", "i", F.row_number().over(Window.partitionBy("component").orderBy("d", "j", "i")).alias("place"))


def _filled(n: int) -> str:
    """The SQL of round n: a null cell takes the mean of its valid neighbours."""
    side = lambda dj, di, name: f"LEFT JOIN r{n - 1} {name} ON {name}.j = c.j + {dj} AND {name}.i = c.i + {di}"
    count = " + ".join(f"CASE WHEN {s}.x IS NULL THEN 0 ELSE 1 END" for s in "wesn")
    total = " + ".join(f"coalesce({s}.x, 0)" for s in "wesn")
    sides = " ".join(side(*x) for x in ((0, -1, "w"), (0, 1, "e"), (-1, 0, "s"), (1, 0, "n")))
    return f"r{n} AS (SELECT c.j, c.i, coalesce(c.x, ({total}) / nullif({count}, 0)) AS x FROM r{n - 1} c {sides})"


@query(f""", m AS (SELECT j, i, avg(x) AS x FROM cells_xy GROUP BY 1, 2), r0 AS (SELECT g.j, g.i, CASE WHEN NOT (is_ice OR i BETWEEN 7 AND 14 AND j BETWEEN 2 AND 8) THEN x END AS x FROM grid g LEFT JOIN m USING (j, i)),
{", ".join(_filled(n) for n in range(1, 7))} SELECT j, i, round(x, 8) AS x FROM r6""")
def j2_discard_and_fill(spark, sf):
    """Ice columns and a block discarded, then filled from around until none is missing."""
    g = V.grid_xy(spark, sf)
    f = V.cells_xy(spark, sf).groupBy("j", "i").agg(F.avg("x").alias("x"))
    discard = F.col("is_ice") | (F.col("i").between(7, 14) & F.col("j").between(2, 8))
    own = g.select("j", "i", "is_ice").join(f, ["j", "i"], "left").select(F.lit(0).alias("all"), "j", "i", F.when(~discard, F.col("x")).alias("x"))
    return rounded(fill.fill_all(own, ["all"], "x", cutter(spark)).select("j", "i", "x"), "x", n=8)


@query(""", f AS (SELECT g.j, g.i, CASE WHEN NOT is_land THEN x END AS x, is_ice FROM grid g LEFT JOIN (SELECT j, i, avg(x) AS x FROM cells_xy GROUP BY 1, 2) q USING (j, i))
SELECT j, i, round(CASE WHEN is_ice THEN -1.9 ELSE coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 8) AS x FROM f""")
def j3_closed_cells(spark, sf):
    """Land takes the nearest value before it in its row, cavities a constant."""
    f = V.cells_xy(spark, sf).groupBy("j", "i").agg(F.avg("x").alias("x"))
    own = V.grid_xy(spark, sf).join(f, ["j", "i"], "left").withColumn("x", F.when(~F.col("is_land"), F.col("x")))
    own = fill.along(own, ["j"], "x", "i")
    return rounded(own.select("j", "i", F.when(F.col("is_ice"), -1.9).otherwise(F.col("x")).alias("x")), "x", n=8)


# ---------------------------------------------------------------- columns and casts


@query(_W + """, f AS (SELECT k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3), s AS (SELECT c_custkey, k, sum(x * w) AS x FROM wts JOIN (SELECT DISTINCT k FROM f) kk ON true LEFT JOIN f USING (k, j, i) GROUP BY 1, 2 HAVING count(x) = count(*))
SELECT c_custkey, round(sum(x * dz) / sum(dz), 8) AS x, count(*) AS n FROM s JOIN levels USING (k) GROUP BY 1""")
def e5_column_average(spark, sf):
    """Vertical averages of interpolated columns."""
    col = regrid.apply_weights(_mean(spark, sf, "x"), _weights(spark, sf), ["c_custkey"], ["j", "i"], ["x"], ["k"]).where("x IS NOT NULL")
    own = col.join(V.levels(spark, sf).select("k", "dz"), "k")
    return rounded(own.groupBy("c_custkey").agg((F.sum(F.col("x") * F.col("dz")) / F.sum("dz")).alias("x"), F.count(F.lit(1)).alias("n")), "x", n=8)


@query(""", a AS (SELECT a.t, a.j, a.i, a.x * 0.6 + b.x * 0.4 AS x, a.y * 0.6 + b.y * 0.4 AS y FROM cells a JOIN cells b USING (t, j, i) WHERE a.k = 2 AND b.k = 3)
SELECT t, j, i, round(sqrt(avg(c.x) * avg(c.x) + avg(c.y) * avg(c.y)), 6) AS average, round(sqrt(pow(arg_min(c.x, k), 2) + pow(arg_min(c.y, k), 2)), 6) AS surface, round(sqrt(pow(arg_max(c.x, k), 2) + pow(arg_max(c.y, k), 2)), 6) AS bottom, round(sqrt(any_value(a.x * a.x + a.y * a.y)), 6) AS at_95m
FROM cells c LEFT JOIN a USING (t, j, i) GROUP BY 1, 2, 3""")
def h18_speed_by_option(spark, sf):
    """Speeds of the average, the surface, the bottom and a depth of a column."""
    c, levels, key = V.cells(spark, sf), V.levels(spark, sf), ["t", "j", "i"]
    out = c.groupBy(*key).agg(
        X.speed(F.avg("x"), F.avg("y")).alias("average"), X.speed(F.min_by("x", "k"), F.min_by("y", "k")).alias("surface"), X.speed(F.max_by("x", "k"), F.max_by("y", "k")).alias("bottom")
    )
    at = columns.at_depth(c, levels, key, "x", -95.0).join(columns.at_depth(c, levels, key, "y", -95.0), key).select(*key, X.speed("x", "y").alias("at_95m"))
    return rounded(out.join(at, key, "left"), "average", "surface", "bottom", "at_95m")


@query(_W + _HIT + """, f AS (SELECT k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3), m AS (SELECT c_custkey, k, sum(x * w) AS x FROM wts JOIN (SELECT DISTINCT k FROM f) kk ON true LEFT JOIN f USING (k, j, i) GROUP BY 1, 2 HAVING count(x) = count(*)),
r AS (SELECT c_custkey, region FROM wts JOIN hit USING (j, i) GROUP BY 1, 2 HAVING sum(w) > 1 - 1e-9), o AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 1e3 AS v FROM customer)
SELECT region, k, round(avg(x), 6) AS model, round(avg(v), 6) AS observed, count(*) AS n FROM r JOIN m USING (c_custkey) JOIN o USING (c_custkey) GROUP BY 1, 2""")
def d11_casts_against_model(spark, sf):
    """The model interpolated to every cast, both averaged over the regions that hold the cast whole."""
    w = _weights(spark, sf)
    model = regrid.apply_weights(_mean(spark, sf, "x"), w, ["c_custkey"], ["j", "i"], ["x"], ["k"]).where("x IS NOT NULL")
    masks = regions.restrict(V.grid_xy(spark, sf), V.regions(spark)).select("region", "j", "i").distinct()
    inside = w.join(masks, ["j", "i"]).groupBy("c_custkey", "region").agg(F.sum("w").alias("w")).where("w > 1 - 1e-9").select("c_custkey", "region")
    seen = V.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 1e3).alias("v"))
    own = inside.join(model, "c_custkey").join(seen, "c_custkey")
    return rounded(own.groupBy("region", "k").agg(F.avg("x").alias("model"), F.avg("v").alias("observed"), F.count(F.lit(1)).alias("n")), "model", "observed")


@query(""", p(name, j0, c, i0, a) AS (VALUES ('a', 4, 0.5::DOUBLE, 10, 5.0::DOUBLE / 9), ('b', 6, 0.5, 15, 5.0 / 9)), wts AS (SELECT name, i0 + di AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a ELSE 1 - a END) * (CASE WHEN dj = 1 THEN c ELSE 1 - c END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(di, dj)),
s AS (SELECT t, k, name, sum(x * wts.w) / sum(wts.w) AS x, sum(y * wts.w) / sum(wts.w) AS y FROM cells JOIN wts USING (j, i) GROUP BY 1, 2, 3), d AS (SELECT t, a.name, 0.6 * a.x + 0.4 * b.x AS x, 0.6 * a.y + 0.4 * b.y AS y FROM s a JOIN s b USING (t, name) WHERE a.k = 2 AND b.k = 3),
r AS (SELECT t, name, 1028.5 * (1 - 3.733e-5 * (x + 1) + 7.843e-4 * (30 + y - 34.2)) AS rho FROM d)
SELECT t, round(max(rho) FILTER (name = 'a') - max(rho) FILTER (name = 'b'), 6) + 0.0 AS difference FROM r GROUP BY t HAVING count(*) = 2""")
def n5_density_difference(spark, sf):
    """Density at one point minus that at another, at a depth."""
    g = V.grid_xy(spark, sf)
    two = g.limit(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("lon"), F.lit(y).alias("lat")) for n, x, y in (("a", 10.0, -71.0), ("b", 100.0, -67.0))])).alias("p")).select("p.*")
    w = regrid.bilinear_weights(two, g, ["name"], period=360.0)
    at = regrid.apply_weights(V.cells(spark, sf).select("t", "k", "j", "i", "x", "y"), w, ["name"], ["j", "i"], ["x", "y"], ["t", "k"], whole=False)
    levels, key = V.levels(spark, sf), ["t", "name"]
    deep = columns.at_depth(at, levels, key, "x", -95.0).join(columns.at_depth(at, levels, key, "y", -95.0), key)
    rho = X.density_linear(30 + F.col("y"), "x")
    pick = lambda n: F.max(F.when(F.col("name") == n, rho))
    out = deep.groupBy("t").agg((pick("a") - pick("b")).alias("difference")).where("difference IS NOT NULL")
    return rounded(out, "difference")


# ---------------------------------------------------------------- boundary and initial conditions


@query(""", w(j, w) AS (VALUES (4, 0.65::DOUBLE), (5, 0.35)), m AS (SELECT month(t) AS month, k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3, 4), s AS (SELECT month, k, i, sum(x * w) AS x FROM m JOIN w USING (j) GROUP BY 1, 2, 3 HAVING count(*) = 2),
a AS (SELECT month, k, i, x FROM (SELECT DISTINCT k FROM cells) CROSS JOIN (SELECT DISTINCT month, i FROM s) LEFT JOIN s USING (month, k, i)),
e AS (SELECT month, k, i, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY month, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY month, i ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM a)
SELECT month, u.k, i, round((u.x + d.x) / 2, 8) AS x FROM e u JOIN e d USING (month, i) WHERE d.k = u.k + 1""")
def n8_boundary_conditions(spark, sf):
    """A boundary's monthly climatology: sliced by weights, extended up and down, interpolated to the target's levels."""
    g, levels = V.grid_xy(spark, sf), V.levels(spark, sf).select("k", "z")
    m = V.cells(spark, sf).groupBy(F.month("t").alias("month"), "k", "j", "i").agg(F.avg("x").alias("x"))
    axis = g.select("j", F.col("lat").alias("g")).distinct()
    w = regrid.bracket(axis.limit(1).select(F.lit(-71.3).alias("lat")), axis, "lat", "g", "j").select("lat", "j", "w")
    cut = regrid.apply_weights(m, w, ["lat"], ["j"], ["x"], ["month", "k", "i"]).where("x IS NOT NULL").drop("lat")
    dense = cut.select("month", "i").distinct().crossJoin(levels.select("k")).join(cut, ["month", "k", "i"], "left")  # the boundary's own grid
    filled = fill.whole(fill.along(dense, ["month", "i"], "x", "k"), "x")
    targets = levels.select(F.col("k").alias("tk"), (F.col("z") - 25).alias("tz"))
    wk = regrid.bracket(targets, levels, "tz", "z", "k").select("tk", "k", "w")
    out = regrid.apply_weights(filled, wk, ["tk"], ["k"], ["x"], ["month", "i"]).where("x IS NOT NULL")
    return rounded(out.select("month", F.col("tk").alias("k"), "i", "x"), "x", n=8)


@query(_INITIAL.replace("AS (SELECT k, j, i, avg(x) AS x FROM cells GROUP BY 1, 2, 3)", "AS (SELECT k, j, i, avg(x) AS x FROM cells WHERE month(t) = 1 GROUP BY 1, 2, 3)") + " SELECT c_custkey, k, round(x, 10) + 0.0 AS temp FROM o WHERE ok")
def n9_initial_conditions(spark, sf):
    """The initial temperature from the source's January climatology."""
    f = V.cells(spark, sf).where("month(t) = 1").groupBy("k", "j", "i").agg(F.avg("x").alias("x"))
    every = V.cells(spark, sf).select("k").distinct()
    dense = every.crossJoin(V.grid_xy(spark, sf).select("j", "i")).join(f, ["k", "j", "i"], "left")  # the model's own grid
    return rounded(_initial(spark, sf, fill.extend_once(dense, ["k"], "x")).where("x IS NOT NULL").withColumnRenamed("x", "temp"), "temp", n=10)


# ---------------------------------------------------------------- corrections in property space

_TS = """, c AS (SELECT k, j, i, avg(x) AS cx, avg(y) AS cy FROM cells WHERE year(t) % 2 = 0 GROUP BY 1, 2, 3), e AS (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM c),
m AS (SELECT year(t) AS year, greatest(1, least(8, CAST(ceil(round((cx - x0) / (x1 - x0) * 8, 9)) AS INT))) AS tb, greatest(1, least(8, CAST(ceil(round((cy - y0) / (y1 - y0) * 8, 9)) AS INT))) AS sb, sum((x - cx) * w) / sum(w) AS d
  FROM cells JOIN c USING (k, j, i), e WHERE year(t) % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT year, tb, sb, d FROM (SELECT DISTINCT year FROM m) CROSS JOIN (SELECT unnest(range(1, 9)) AS tb) CROSS JOIN (SELECT unnest(range(1, 9)) AS sb) LEFT JOIN m USING (year, tb, sb)),
q AS (SELECT h.year, h.tb, h.sb, v.d, sqrt(pow(h.tb - v.tb, 2) + pow(h.sb - v.sb, 2)) AS far FROM b h JOIN b v ON v.year = h.year AND h.d IS NULL AND v.d IS NOT NULL QUALIFY rank() OVER (PARTITION BY h.year, h.tb, h.sb ORDER BY far) <= 10),
f AS (SELECT year, tb, sb, d FROM b WHERE d IS NOT NULL UNION ALL SELECT year, tb, sb, sum(d / far) / sum(1 / far) FROM q GROUP BY 1, 2, 3),
s AS (SELECT o, exp(-o * o / 8.0) AS g, exp(-o * o / 8.0) / sum(exp(-o * o / 8.0)) OVER () AS w FROM (SELECT unnest(range(-8, 9)) AS o)),
turn AS (SELECT p, CASE WHEN (p - 1 + o + 16) % 16 < 8 THEN (p - 1 + o + 16) % 16 ELSE 15 - (p - 1 + o + 16) % 16 END + 1 AS source, w FROM (SELECT unnest(range(1, 9)) AS p), s),
one AS (SELECT year, tb, p AS sb, sum(d * w) AS d FROM f JOIN turn ON source = sb GROUP BY 1, 2, 3), z AS (SELECT year, p AS tb, sb, sum(d * w) AS d FROM one JOIN turn ON source = tb GROUP BY 1, 2, 3)"""
_BINS = 8


def _climatology(c, keys=("k", "j", "i")):
    """(keys, cx, cy, tb, sb): means over time with the bins of their normalised values."""
    m = c.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    m = binning.normalise(binning.normalise(m, "cx", [], "_a"), "cy", [], "_b")
    return m.select(*keys, "cx", "cy", binning.upper_bin("_a", _BINS).alias("tb"), binning.upper_bin("_b", _BINS).alias("sb"))


def _bin_anomalies(spark, sf):
    """(year, t_bin, s_bin, anomaly): the model's yearly anomaly from its climatology; even years play the model."""
    c, cut = V.cells(spark, sf).where(F.year("t") % 2 == 0), cutter(spark)
    own = c.join(_climatology(c), ["k", "j", "i"]).withColumn("d", F.col("x") - F.col("cx")).withColumn("year", F.year("t"))
    return binning.anomaly_by_bin(own, ["year"], "d", "w", "tb", "sb", _BINS, cut)


@query(_TS + " SELECT CAST(year AS INT) AS year, CAST(tb AS INT) AS t_bin, CAST(sb AS INT) AS s_bin, round(d, 6) + 0.0 AS anomaly FROM z")
def k7_anomaly_by_bin(spark, sf):
    return rounded(_bin_anomalies(spark, sf), "anomaly")


@query(_TS + """, r AS (SELECT k, j, i, avg(x) AS rx, avg(y) AS ry FROM cells WHERE year(t) % 2 = 1 GROUP BY 1, 2, 3), er AS (SELECT min(rx) AS x0, max(rx) AS x1, min(ry) AS y0, max(ry) AS y1 FROM r),
n AS (SELECT k, rx, greatest(1, least(8, CAST(ceil(round((rx - x0) / (x1 - x0) * 8, 9)) AS INT))) AS tb, greatest(1, least(8, CAST(ceil(round((ry - y0) / (y1 - y0) * 8, 9)) AS INT))) AS sb FROM r, er)
SELECT CAST(year AS INT) AS year, k, round(avg(rx), 6) AS before, round(avg(rx + d), 6) AS after, count(*) AS n FROM n JOIN z USING (tb, sb) GROUP BY 1, 2""")
def p7_property_correction(spark, sf):
    """The reference's climatology with the model's anomaly of each year, looked up by the reference's own normalised values; odd years play the reference."""
    own = _climatology(V.cells(spark, sf).where(F.year("t") % 2 == 1))
    fixed = own.join(_bin_anomalies(spark, sf), (F.col("tb") == F.col("t_bin")) & (F.col("sb") == F.col("s_bin")))
    return rounded(fixed.groupBy("year", "k").agg(F.avg("cx").alias("before"), F.avg(F.col("cx") + F.col("anomaly")).alias("after"), F.count(F.lit(1)).alias("n")), "before", "after")


# ---------------------------------------------------------------- grid checks


@query(""", m AS (SELECT min(z_bot) AS bottom FROM levels), p AS (SELECT j, i, bathy, z_top, dz, (z_top - bathy) / dz AS part, greatest(0.1, least(20.0 / dz, 1)) AS lim FROM grid LEFT JOIN levels ON bathy < z_top AND bathy >= z_bot)
SELECT j, i, CASE WHEN z_top IS NULL THEN greatest(bathy, bottom) ELSE z_top - dz * CASE WHEN part < lim / 2 THEN 0 WHEN part < lim THEN lim ELSE part END END + 0.0 AS bathy FROM p, m""")
def v5_model_surface(spark, sf):
    """The sea floor as partial cells can hold it."""
    g = V.grid_xy(spark, sf)
    return boundary.model_surface(g, V.levels(spark, sf), "bathy").select("j", "i", (F.col("bathy") + 0.0).alias("bathy"))


@query(""", a AS (SELECT g.j, g.i, g.bathy AS old, g.draft, greatest(g.bathy, coalesce((SELECT min(n.bathy) FROM grid n WHERE abs(n.i - g.i) + abs(n.j - g.j) = 1), g.bathy)) AS bathy FROM grid g),
b AS (SELECT j, i, old, draft, bathy AS raised, CASE WHEN low < 0 THEN least(bathy, low - 250) ELSE bathy END AS bathy FROM (SELECT a.*, least(a.draft, coalesce((SELECT min(n.draft) FROM grid n WHERE abs(n.i - a.i) + abs(n.j - a.j) = 1), 0)) AS low FROM a))
SELECT j, i, bathy + 0.0 AS bathy, CASE WHEN draft < 0 AND draft > -60 THEN -60.0 ELSE draft END + 0.0 AS draft, raised <> old AS raised, bathy <> raised AS dug, draft < 0 AND draft > -60 AS thickened FROM b""")
def v6_repaired_grid(spark, sf):
    """All repairs in order, and which of them changed a column."""
    out = boundary.repair(V.grid_xy(spark, sf), 250.0, 60.0)
    return out.select("j", "i", (F.col("bathy") + 0.0).alias("bathy"), (F.col("draft") + 0.0).alias("draft"), "raised", "dug", "thickened")


# ---------------------------------------------------------------- incremental output


def _means(batch):
    return batch.groupBy("segment", "t").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.count(F.lit(1)).alias("n"))


def _by_segment(spark, sf):
    return V.cells_xy(spark, sf).withColumn("segment", F.year("t"))


@query("SELECT year(t) AS segment, t, round(sum(x * w) / sum(w), 6) AS mean, count(*) AS n FROM cells_xy GROUP BY 1, 2")
def t1_appended_series(spark, sf):
    """A series added up from batches that each have some cells of every segment; one batch comes twice and changes nothing, some are compacted."""
    c, path = _by_segment(spark, sf), _place(spark, "series")
    key, sums = ["segment", "t"], ["part", "whole", "n"]
    for batch in (0, 1, 1, 2, 3):
        own = c.where(F.pmod(F.col("i") + F.col("j"), F.lit(4)) == batch)
        incremental.append_batch(own.groupBy(*key).agg(F.sum(F.col("x") * F.col("w")).alias("part"), F.sum("w").alias("whole"), F.count(F.lit(1)).alias("n")), path, batch)
        if batch == 2:
            incremental.compact(spark, path, key, sums)
    return rounded(incremental.merged(spark, path, key, sums).select(*key, (F.col("part") / F.col("whole")).alias("mean"), "n"), "mean")


@query("SELECT year(t) AS segment, count(DISTINCT t) AS n, true AS refused FROM cells_xy WHERE year(t) IN (1996, 1997, 1999) GROUP BY 1")
def t2_guarded_append(spark, sf):
    """Existing output takes only segments that are named."""
    c, path, refused = _by_segment(spark, sf), _place(spark, "guarded"), False
    incremental.append_guarded(c.where("segment IN (1996, 1997)"), path, _means)
    try:
        incremental.append_guarded(c, path, _means)
    except FileExistsError:
        refused = True
    incremental.append_guarded(c, path, _means, segments=[1999])
    return spark.read.parquet(path).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query(""", d AS (SELECT year(t) AS segment, greatest(1, least(20, CAST(floor((x - 0.0) / 10.0 * 20) AS INT) + 1)) AS bin, w FROM cells) SELECT segment, bin, round(sum(w), 2) AS volume, true AS refused FROM d GROUP BY 1, 2""")
def t3_axis_check(spark, sf):
    """Profiles over bins of a property, appended only with the axis that is there."""
    c, path, refused = V.cells(spark, sf).withColumn("segment", F.year("t")), _place(spark, "bins"), False
    profile = lambda high: lambda b: binning.density_profile(b, ["segment"], "x", [], "w", 0.0, high, 20).withColumns({"low": F.lit(0.0), "high": F.lit(high)})
    years = [r["segment"] for r in c.select("segment").distinct().collect()]  # one row per segment
    incremental.append_guarded(c.where("segment <= 1998"), path, profile(10.0))
    try:
        incremental.append_guarded(c.where("segment > 1998"), path, profile(12.0), years, ["low", "high"])
    except ValueError:
        refused = True
    incremental.append_guarded(c.where("segment > 1998"), path, profile(10.0), years, ["low", "high"])
    return rounded(spark.read.parquet(path).select("segment", "bin", "volume", F.lit(refused).alias("refused")), "volume", n=2)


@query(_HIT + """, v AS (SELECT t, 'west_x_avg' AS name, round(sum(x * w) / sum(w), 6) AS value FROM own WHERE region = 'west' GROUP BY t
UNION ALL SELECT t, 'east_x_int_btw_100_250m', round(sum(x * w), 6) FROM own WHERE region = 'east' AND z BETWEEN -250 AND -100 GROUP BY t
UNION ALL SELECT t, 'middle_y_max', round(max(y), 6) FROM own WHERE region = 'middle' GROUP BY t
UNION ALL SELECT t, 'two_part_x_above_5', round(100 * sum(CASE WHEN x >= 5 THEN w ELSE 0 END) / sum(w), 6) FROM own WHERE region = 'two_part' GROUP BY t
UNION ALL SELECT t, 'narrow_y_avg_btw_0_150m', round(sum(y * w) / sum(w), 6) FROM own WHERE region = 'narrow' AND z BETWEEN -150 AND 0 GROUP BY t) SELECT year(t) AS segment, t, name, value FROM v""")
def t4_all_segments(spark, sf):
    """All diagnostics of all segments, by a stream over files of which each has some cells of several segments."""
    source, path, state = _place(spark, "segments"), _place(spark, "diagnostics"), _place(spark, "state")
    c = V.cells(spark, sf).withColumn("segment", F.year("t"))
    c.repartition(5, "i", "j").write.parquet(source)
    masks, levels = regions.restrict(V.grid_xy(spark, sf), V.regions(spark)).select("region", "j", "i"), V.levels(spark, sf)

    def partial(batch):
        return diagnostics.partial_sums(diagnostics.Inputs(batch, masks, levels), NAMES).withColumn("segment", F.year("t"))

    incremental.follow(spark, source, c.schema, path, state, partial, files=2).awaitTermination()
    key = ["segment", "t"]
    return rounded(diagnostics.from_sums(incremental.merged(spark, path, [*key, "name"], ["part", "whole"], ["high"], ["low"]), NAMES, key), "value")
