"""Gridded views of the relational test tables: fields, grid, levels, regions, series, profiles, casts, forcing.

``*_sql`` constants give the same views to DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, part, box (inclusive), isobaths, depth bounds.
REGIONS = [
    ("west", 1, -180.0, -60.0, -80.0, -62.0, -450.0, -100.0, -350.0, 0.0),
    ("middle", 1, -60.0, 60.0, -80.0, -62.0, -300.0, -150.0, -250.0, -50.0),
    ("east", 1, 60.0, 170.0, -80.0, -62.0, -450.0, -100.0, -350.0, -100.0),
    ("two_part", 1, -180.0, -120.0, -80.0, -70.0, -450.0, -100.0, -350.0, 0.0),
    ("two_part", 2, 120.0, 170.0, -80.0, -70.0, -450.0, -100.0, -350.0, 0.0),
    ("narrow", 1, -20.0, 20.0, -74.0, -66.0, -450.0, -100.0, -250.0, -50.0),
]
REGION_SCHEMA = "name string, part int, xmin double, xmax double, ymin double, ymax double, bathy_deep double, bathy_shallow double, z_deep double, z_shallow double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(col: str):
    return F.trunc(F.col(col).cast("date"), "MM")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field(t, k, j, i, x, y, w): sparse months x levels x rows x columns; w plays the cell volume."""
    return table(spark, sf_dir, "lineitem").groupBy(
        month("l_shipdate").alias("t"), F.col("l_linenumber").cast("int").alias("k"),
        (F.col("l_suppkey") % 10).cast("int").alias("j"), (F.col("l_partkey") % 20).cast("int").alias("i"),
    ).agg(F.avg(F.col("l_discount") * 100).alias("x"), F.avg(F.col("l_tax") * 100).alias("y"), F.sum("l_quantity").alias("w"))


def cells_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field(t, j, i, x, y, w): the field without its depth axis; w plays the cell area."""
    return table(spark, sf_dir, "lineitem").groupBy(
        month("l_shipdate").alias("t"), (F.col("l_suppkey") % 10).cast("int").alias("j"), (F.col("l_partkey") % 20).cast("int").alias("i"),
    ).agg(F.avg(F.col("l_discount") * 100).alias("x"), F.avg(F.col("l_tax") * 100).alias("y"), F.sum("l_quantity").alias("w"))


def grid_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid(j, i, lon, lat, bathy, draft, is_ice, is_land) of the columns that occur."""
    ji = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("j"), (F.col("l_partkey") % 20).cast("int").alias("i")).distinct()
    ice = (F.col("i") + 2 * F.col("j")) % 11 == 0
    return ji.select(
        "j", "i", (-180.0 + 18 * F.col("i")).alias("lon"), (-80.0 + 2 * F.col("j")).alias("lat"),
        (-(100.0 + 50 * ((F.col("i") + F.col("j")) % 7))).alias("bathy"), F.when(ice, F.lit(-40.0)).otherwise(0.0).alias("draft"),
        ice.alias("is_ice"), ((F.col("i") * F.col("j")) % 13 == 12).alias("is_land"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """levels(k, z, z_top, z_bot, dz) of the levels that occur."""
    k = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("k")).distinct()
    return k.select("k", (-50.0 * F.col("k") + 25).alias("z"), (-50.0 * (F.col("k") - 1)).alias("z_top"), (-50.0 * F.col("k")).alias("z_bot"), F.lit(50.0).alias("dz"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, REGION_SCHEMA)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series(expt, member, t, v, v2): monthly values of ensemble members."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("expt"), (F.col("c_custkey") % 4).cast("int").alias("member"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", month("o_orderdate").alias("t"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("expt", "member", "t").agg(F.avg(F.col("o_totalprice") / 1000).alias("v"), F.count(F.lit(1)).alias("v2"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profiles(vec_id, region, k, v): one column of 64 levels per vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("region"), F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", "region", (F.col("p") + 1).alias("k"), F.col("v").cast("double").alias("v")
    )


def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """casts(region, month, depth, temp): observations."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("depth"))  # noqa: E741
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
        .select(F.col("n_name").alias("region"), F.month("l_shipdate").alias("month"), "depth", (F.col("l_extendedprice") / 1e4).alias("temp"))
    )


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forcing(ts, d, cell, v): many records a day."""
    return table(spark, sf_dir, "events").select("ts", F.col("ts").cast("date").alias("d"), (F.col("user_id") % 40).cast("int").alias("cell"), F.col("value").alias("v"))


_REGION_ROWS = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in REGIONS)

#: All views for DuckDB, as the head of a query.
VIEWS = f"""
WITH RECURSIVE cells AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, CAST(l_linenumber AS INT) AS k, CAST(l_suppkey % 10 AS INT) AS j,
         CAST(l_partkey % 20 AS INT) AS i, avg(l_discount * 100) AS x, avg(l_tax * 100) AS y, sum(l_quantity) AS w
  FROM lineitem GROUP BY 1, 2, 3, 4
), cells_xy AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, CAST(l_suppkey % 10 AS INT) AS j, CAST(l_partkey % 20 AS INT) AS i,
         avg(l_discount * 100) AS x, avg(l_tax * 100) AS y, sum(l_quantity) AS w
  FROM lineitem GROUP BY 1, 2, 3
), grid AS (
  SELECT j, i, CAST(-180.0 + 18 * i AS DOUBLE) AS lon, CAST(-80.0 + 2 * j AS DOUBLE) AS lat, CAST(-(100.0 + 50 * ((i + j) % 7)) AS DOUBLE) AS bathy,
         CAST(CASE WHEN (i + 2 * j) % 11 = 0 THEN -40.0 ELSE 0.0 END AS DOUBLE) AS draft, (i + 2 * j) % 11 = 0 AS is_ice, (i * j) % 13 = 12 AS is_land
  FROM (SELECT DISTINCT CAST(l_suppkey % 10 AS INT) AS j, CAST(l_partkey % 20 AS INT) AS i FROM lineitem)
), levels AS (
  SELECT k, CAST(-50.0 * k + 25 AS DOUBLE) AS z, CAST(-50.0 * (k - 1) AS DOUBLE) AS z_top, CAST(-50.0 * k AS DOUBLE) AS z_bot, CAST(50.0 AS DOUBLE) AS dz
  FROM (SELECT DISTINCT CAST(l_linenumber AS INT) AS k FROM lineitem)
), regions(name, part, xmin, xmax, ymin, ymax, bathy_deep, bathy_shallow, z_deep, z_shallow) AS (VALUES {_REGION_ROWS}
), series AS (
  SELECT c_mktsegment AS expt, CAST(c_custkey % 4 AS INT) AS member, CAST(date_trunc('month', o_orderdate) AS DATE) AS t,
         avg(o_totalprice / 1000) AS v, count(*) AS v2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
), profiles AS (
  SELECT vec_id, label AS region, k, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)
), casts AS (
  SELECT n_name AS region, month(l_shipdate) AS month, p_size AS depth, l_extendedprice / 1e4 AS temp
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), forcing AS (
  SELECT ts, CAST(ts AS DATE) AS d, CAST(user_id % 40 AS INT) AS cell, value AS v FROM events
)"""
