"""Operators on small dense cases with known answers, and their edge cases."""

import datetime as dt
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import expr as X
from strataframe.operators import agg, binning, boundary, calendar, columns, fill, graph, joins, regrid, stats, stencil
from strataframe.plans import diagnostics, further
from strataframe.plans.cuts import cutter
from strataframe.sources import ingest
from strataframe.streaming import incremental


@pytest.fixture(scope="module")
def dense(spark):
    """x = 1 + 2 i + 3 j + 5 k + 7 t on 24 months x 4 x 5 x 6 cells."""
    rows = [(dt.date(1999 + m // 12, m % 12 + 1, 1), k, j, i, 1.0 + 2 * i + 3 * j + 5 * k + 7 * m, 1.0) for m in range(24) for k in range(4) for j in range(5) for i in range(6)]
    return spark.createDataFrame(rows, "t date, k int, j int, i int, x double, w double").cache()


def test_mean_of_a_constant_and_additive_integrals(dense):
    one = dense.withColumn("c", F.lit(4.0))
    assert {r.c for r in agg.over(one, ["t"], "c", "w").collect()} == {4.0}
    whole = agg.over(dense, [], "x", "w", "integral").first()[0]
    parts = [agg.over(dense.where(c), [], "x", "w", "integral").first()[0] for c in ("i < 2", "i >= 2")]
    assert whole == pytest.approx(sum(parts))
    with pytest.raises(ValueError):
        agg.over(dense, [], "x", "w", "median")


def test_null_values_do_not_count(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 100.0), (3.0, 1.0)], "x double, w double")
    assert agg.over(df, [], "x", "w").first().x == 2.0
    assert agg.over(df.where("x IS NULL"), [], "x", "w").first().x is None
    assert agg.over(df.limit(0), ["w"], "x", "w").count() == 0


def test_derivatives_of_a_linear_field(dense):
    out = stencil.forward_difference(dense, "x", "i", ["t", "k", "j"]).agg(F.min("d"), F.max("d")).first()
    assert tuple(out) == (2.0, 2.0)
    n = stencil.neighbours(dense, "x", ["t", "k"])
    mid = n.where("n_valid = 4").select(F.max(F.abs((F.col("west") + F.col("east") + F.col("north") + F.col("south")) / 4 - F.col("x")))).first()[0]
    assert mid < 1e-12
    gap = dense.where("NOT (i = 3 AND j = 2)")
    assert stencil.neighbours(gap, "x", ["t", "k"]).where("i = 2 AND j = 2 AND east IS NOT NULL").count() == 0


def test_moving_averages_of_a_line_are_the_line(dense):
    line = dense.where("k = 0 AND j = 0 AND i = 0").withColumn("one", F.lit(1))
    for f in (stencil.moving_average, stencil.moving_average_prefix):
        out = f(line, "x", ["one"], "t", 5)
        assert out.count() == 20 and out.where("abs(smooth - x) > 1e-9").count() == 0
    even = stencil.moving_average(line, "x", ["one"], "t", 12)
    assert even.count() == 13 and even.where("abs(smooth - (x - 3.5)) > 1e-9").count() == 0
    edges = stencil.moving_average_edges(line, "x", ["one"], "t", 4)
    assert edges.count() == 24 and edges.where("abs(smooth - x) > 1e-9").count() == 0


def test_calendar_weights_and_leap_years(dense, spark):
    days = calendar.annual(dense.groupBy("t").agg(F.max(F.dayofmonth(F.last_day("t"))).alias("d")).withColumn("one", F.lit(1)), ["one"], ["d"])
    assert {r.year: round(r.d * (366 if r.year == 2000 else 365)) for r in days.collect()} == {1999: sum(d * d for d in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)), 2000: sum(d * d for d in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))}
    assert calendar.annual(dense.where("t < DATE'2000-12-01'"), ["k"], ["x"]).where("year = 2000").count() == 0
    leap = spark.createDataFrame([(dt.date(2000, 2, 29), 5.0), (dt.date(2000, 3, 1), 1.0), (dt.date(2001, 3, 1), 3.0)], "d date, v double")
    assert [(r.day, r.v) for r in calendar.daily_climatology(leap, [], "v", "d").collect()] == [(60, 2.0)]


def test_columns_on_a_step_profile(spark):
    p = spark.createDataFrame([(1, k, -10.0 * k, v) for k, v in enumerate([0.0, 2.0, 5.0, 5.0, 1.0])] + [(2, k, -10.0 * k, -1.0) for k in range(3)] + [(3, 0, 0.0, None)], "id int, k int, z double, v double")
    assert {r.id: r.depth for r in columns.depth_of_max(p, ["id"], "v").collect()} == {1: -20.0, 2: 0.0}
    assert {r.id: r.depth for r in columns.isoline_depth(p, ["id"], "v", 3.5).collect()} == {1: -15.0, 2: -20.0}
    assert {r.id: r.depth for r in columns.isoline_depth(p, ["id"], "v", 3.5, null_if_colder=True).collect()} == {1: -15.0, 2: None}
    assert [r.depth for r in columns.refine(p.where("id = 1"), ["id"], "v", 5.0).orderBy("depth").collect()] == [5.0 * n for n in range(9)]
    base = columns.thermocline_base(spark.createDataFrame([(1, 10.0 * k, v) for k, v in enumerate([0.0, -2.0, -1.9, -1.0, 0.0, 0.1, 0.1, 0.1, 0.1, 0.1])], "id int, depth double, temp double"), ["id"], "temp", "depth", 0.05)
    assert base.first().base_depth == 40.0


def test_fill_components_and_nearest(spark):
    cut = cutter(spark)
    cells = [(j, i, float(j + i) if (j, i) == (0, 0) else None) for j in range(4) for i in range(4)]
    df = spark.createDataFrame([(1, *c) for c in cells], "t int, j int, i int, x double")
    full = fill.fill_all(df, ["t"], "x", cut)
    assert full.where("x <> 0").count() == 0 and full.count() == 16
    with pytest.raises(ValueError):
        fill.fill_all(df.withColumn("x", F.lit(None).cast("double")), ["t"], "x", cut)
    islands = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3), (3, 4), (5, 0)], "j int, i int")
    assert {(r.j, r.i): r.component for r in fill.components(islands, 8, cut).collect()} == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (3, 3): 27, (3, 4): 27, (5, 0): 40}
    assert fill.connected_to(islands, (1, 1), 8, cut).count() == 3
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.connected_components(chain, cut).select("component").distinct().collect()[0][0] == 0


def test_p_values_match_tabulated_quantiles(spark):
    table = [(12.706, 1.0, 0.05), (2.571, 5.0, 0.05), (2.228, 10.0, 0.05), (3.169, 10.0, 0.01), (1.96, 1e6, 0.05), (0.0, 4.0, 1.0)]
    df = spark.createDataFrame(table, "t double, dof double, p double")
    assert all(abs(r.q - r.p) < 2e-4 for r in df.withColumn("q", stats.two_sided_p("t", "dof")).collect())
    none = spark.createDataFrame([(None, 3.0), (1.0, 0.0)], "t double, dof double").withColumn("q", stats.two_sided_p("t", "dof"))
    assert {r.q for r in none.collect()} == {None}


def test_spectrum_peaks_at_the_signal(spark):
    df = spark.createDataFrame([(1, n, math.sin(2 * math.pi * n / 8)) for n in range(256)], "id int, n int, v double")
    assert stats.power_spectrum(df, ["id"], "v", "n", 64).orderBy(F.desc("power")).first().f == 0.125
    both = df.withColumn("u", 2 * F.col("v"))
    assert stats.coherence(both, ["id"], "v", "u", "n", 64).where("f = 0.125").first().coherence == pytest.approx(1.0)


def test_regridding_with_identity_weights_is_identity(dense):
    grid = dense.select("j", "i", (F.col("i") * 10.0).alias("lon"), (F.col("j") * 2.0).alias("lat")).distinct()
    targets = grid.select((F.col("j") * 6 + F.col("i")).alias("id"), "lon", "lat")
    w = regrid.bilinear_weights(targets, grid, ["id"])
    out = regrid.apply_weights(dense, w, ["id"], ["j", "i"], ["x"], ["t", "k"])
    same = out.join(dense.withColumn("id", F.col("j") * 6 + F.col("i")).withColumnRenamed("x", "y"), ["t", "k", "id"])
    assert same.count() == dense.count() and same.where("abs(x - y) > 1e-9").count() == 0
    outside = targets.withColumn("lon", F.col("lon") + 1000)
    assert regrid.bilinear_weights(outside, grid, ["id"]).count() == 0


def _most_aggregated(df):
    """Most rows that one aggregate of a query has put out, once it has run without adaptive plans."""

    def walk(node):
        yield node
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    own = [n for n in walk(df._jdf.queryExecution().executedPlan()) if "Aggregate" in n.nodeName()]
    return max(n.metrics().get("numOutputRows").get().value() for n in own)


def test_weighted_sums_aggregate_the_field_and_not_the_result(spark, dense):
    grid = dense.select("j", "i", (F.col("i") * 10.0).alias("lon"), (F.col("j") * 2.0).alias("lat")).distinct()
    targets = spark.range(500).select("id", ((F.col("id") * 7) % 50 + 0.25).alias("lon"), ((F.col("id") * 3) % 8 + 0.25).alias("lat"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = regrid.apply_weights(dense, regrid.bilinear_weights(targets, grid, ["id"]), ["id"], ["j", "i"], ["x"], ["t", "k"])
        rows = out.collect()
        assert len(rows) == 500 * 96 and _most_aggregated(out) < len(rows) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    at = {r.id: (r.lon, r.lat) for r in targets.collect()}
    month = lambda t: (t.year - 1999) * 12 + t.month - 1
    assert all(abs(r.x - (1 + 0.2 * at[r.id][0] + 1.5 * at[r.id][1] + 5 * r.k + 7 * month(r.t))) < 1e-9 for r in rows)


def test_weighted_sums_skip_nulls_and_count_repeated_targets(spark):
    field = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, None), (2, 0, 1, None), (None, 0, 0, 4.0)], "t int, j int, i int, x double")
    w = spark.createDataFrame([(7, 0, 0, 0.25), (7, 0, 1, 0.75), (None, 0, 0, 1.0), (8, 0, 0, 0.5), (8, 0, 0, 0.5), (9, 0, 1, 0.0)], "id int, j int, i int, w double")
    got = lambda whole: {(r.t, r.id): r.x for r in regrid.apply_weights(field, w, ["id"], ["j", "i"], ["x"], ["t"], whole).collect()}
    assert got(True) == {(1, 7): None, (2, 7): None, (None, 7): None, (1, 8): 2.0, (None, 8): 4.0}
    assert got(False) == {(1, 7): 2.0, (2, 7): None, (None, 7): 4.0, (1, 8): 2.0, (None, 8): 4.0}
    both = regrid.sums(regrid.gather(field, w, ["id"], ["j", "i"], ["x"], ["t"]), ["t", "id"], {"x": lambda h, w: h["x"] * w, "w": lambda h, w: w}, "decimal(34,12)")
    assert {(r.t, r.id): (r.x and float(r.x), float(r.w)) for r in both.where("id = 7").collect()} == {(1, 7): (0.5, 1.0), (2, 7): (None, 0.75), (None, 7): (1.0, 0.25)}
    grid = spark.createDataFrame([(j, i, 10.0 * i, 10.0 * j) for j in range(2) for i in range(2)], "j int, i int, lon double, lat double")
    twice = spark.createDataFrame([(1, 2.5, 5.0), (1, 2.5, 5.0)], "id int, lon double, lat double")
    assert sorted(r.w for r in regrid.bilinear_weights(twice, grid, ["id"]).collect()) == [0.125] * 4 + [0.375] * 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_weight_threshold_aggregates_before_the_points_fan_out(spark):
    plan = further.i12_weight_threshold(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]


def test_transect_is_whole(dense):
    grid = dense.select("j", "i", (F.col("i") * 1.0).alias("lon"), (F.col("j") * 1.0).alias("lat")).distinct()
    rows = regrid.transect(grid, (-0.25, 0.0), (5.25, 4.0), 1.0, 1.0).orderBy("n").collect()
    assert rows[0].enter == 0 and rows[-1].leave == pytest.approx(math.hypot(5.5, 4)) and all(a.leave == pytest.approx(b.enter) for a, b in zip(rows, rows[1:], strict=False))
    with pytest.raises(ValueError):
        regrid.transect(grid, (0.0, 0.0), (0.0, 0.0), 1.0, 1.0)


def test_balanced_flux_sums_to_zero(dense):
    f = dense.where("k = 0 AND i IN (0, 5)").withColumn("s", F.when(F.col("i") == 0, 1.0).otherwise(-1.0))
    net = boundary.balance(f, ["t"], "x", "w", "s").groupBy("t").agg(F.sum(F.col("x") * F.col("w") * F.col("s")).alias("n"))
    assert net.where("abs(n) > 1e-9").count() == 0


def test_bins_at_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.5, 1.0, -0.1, 1.1, None)], "v double")
    lo, hi = F.lit(0.0), F.lit(1.0)
    assert [r.b for r in df.select(binning.bin_of("v", lo, hi, 2).alias("b")).collect()] == [1, 1, 2, 2, None, None, None]
    assert [r.b for r in df.where("v IS NOT NULL").select(binning.bin_of("v", lo, hi, 2, clamp=True).alias("b")).collect()] == [1, 1, 2, 2, 1, 2]


def test_expressions(spark):
    row = spark.range(1).select(
        X.wrap_lon(F.lit(180.0)).alias("a"), X.wrap_lon(F.lit(-180.0)).alias("b"), X.freezing_point(F.lit(35.0), F.lit(-1000.0)).alias("f"),
        X.days_in_month(F.lit(1900), F.lit(2)).alias("d"), X.wrap_angle(F.lit(4.0)).alias("w"), X.open_fraction(F.lit(-130.0), F.lit(0.0), F.lit(-100.0), F.lit(-150.0)).alias("h"),
    ).first()
    assert row.a == -180 and row.b == -180 and row.f == pytest.approx(-0.0575 * 35 - 0.761 + 0.0901) and row.d == 28 and row.w == pytest.approx(4 - 2 * math.pi) and row.h == pytest.approx(0.6)
    u, v = X.rotate(F.lit(1.0), F.lit(0.0), 0.0, -70.0, 10.0, -70.0)
    r = spark.range(1).select(u.alias("normal"), v.alias("along")).first()
    assert r.normal == pytest.approx(0) and r.along == pytest.approx(1)


def test_joins_cut_to_the_shorter_run(spark):
    a = spark.createDataFrame([(1, dt.date(2000, m, 1), float(m)) for m in range(1, 6)], "run int, t date, v double")
    b = spark.createDataFrame([(1, dt.date(2010, m, 1), 10.0 * m) for m in range(1, 4)], "run int, t date, v double")
    assert [(r.step, r.difference) for r in joins.trim_and_diff(a, b, ["run"], "v").orderBy("step").collect()] == [(1, 9.0), (2, 18.0), (3, 27.0)]


def test_diagnostic_names():
    d = diagnostics.parse("west_x_int_btw_100_250m")
    assert (d.region, d.variable, d.kernel, d.shallow, d.deep) == ("west", "x", "integral", -100.0, -250.0)
    diagnostics.register_diagnostic(diagnostics.Diagnostic("mine", "r", "x", "average", factor=2.0))
    assert diagnostics.parse("mine").factor == 2.0
    with pytest.raises(ValueError):
        diagnostics.parse("nonsense")


def test_read_binary(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack(">24f", *[float(n) if n != 5 else -9999.0 for n in range(24)]))
    df = ingest.read_binary(spark, str(tmp_path), "tyx", {"y": 3, "x": 4})
    rows = {(r.t, r.j, r.i): r.value for r in df.collect()}
    assert len(rows) == 24 and rows[1, 2, 3] == 23 and rows[0, 1, 1] is None
    with pytest.raises(ValueError):
        ingest.read_binary(spark, str(tmp_path), "tq", {"q": 3})


def test_aliases(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 3.0, 4.0)], "id int, toce double, thetao double")
    out = ingest.with_aliases(df, {"temp": ["toce", "thetao"], "salt": ["soce"]})
    assert [(r.id, r.temp, r.salt) for r in out.orderBy("id").collect()] == [(1, 2.0, None), (2, 3.0, None)]


def test_segments_split_over_batches_add_up_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [(s, n, float(10 * s + n)) for s in (1, 2, 3) for n in range(6)]
    schema, key, sums = "segment int, n int, v double", ["segment"], ["v", "rows"]
    partial = lambda df: df.groupBy("segment").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("rows"))
    total = lambda: sorted((r.segment, r.v, r.rows) for r in incremental.merged(spark, out, key, sums).collect())
    want = [(s, sum(10.0 * s + n for n in range(6)), 6) for s in (1, 2, 3)]
    for part in range(3):  # every file has cells of all segments, every run of the stream its own batches
        spark.createDataFrame([r for r in rows if r[1] % 3 == part], schema).repartition(2).write.mode("append").parquet(src)
        incremental.follow(spark, src, spark.createDataFrame([], schema).schema, out, ck, partial, files=1).awaitTermination()
    assert total() == want and len(incremental.committed(spark, out)[0]) > 3
    folders, last = incremental.committed(spark, out)
    batch = int(folders[-1].rpartition("=")[2])
    incremental.append_batch(spark.read.parquet(folders[-1]), str(tmp_path / "copy"), batch)
    incremental.append_batch(spark.read.parquet(str(tmp_path / "copy")), out, batch)  # the same batch again
    assert total() == want
    (tmp_path / "out" / "batch=99").mkdir()  # a batch that never ended
    spark.createDataFrame([(1, 1e9, 5)], "segment int, v double, rows long").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/batch=99")
    assert total() == want
    incremental.compact(spark, out, key, sums)
    assert total() == want and len(incremental.committed(spark, out)[0]) == 1
    incremental.append_batch(spark.createDataFrame([(2, 100.0, 1)], "segment int, v double, rows long"), out, last + 1)
    assert total()[1] == (2, want[1][1] + 100, 7)


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    ts = lambda d: dt.datetime(2024, 1, d)
    schema = "ts timestamp, k int, v double"
    for batch in ([(ts(1), 1, 2.0), (ts(10), 1, 4.0)], [(ts(1), 1, 100.0), (ts(20), 1, 6.0)], [(ts(30), 1, 1.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = incremental.windowed_mean(stream, "ts", ["k"], "v").writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.start.day: (r.mean, r.n) for r in spark.table("late").collect()}
    assert got[10] == (4.0, 1) and got[1][1] in (1, 2)


def test_equations_of_state_give_their_published_check_values(spark):
    d = spark.createDataFrame([(3.0, 35.5, 3000.0), (25.0, 35.0, 2000.0), (20.0, 20.0, 1000.0), (12.0, 40.0, 8000.0)], "t double, s double, p double")
    got = {r.t: (r.a, r.b) for r in d.select("t", X.density_jmd95("t", "s", "p").alias("a"), X.density_mdjwf("t", "s", "p").alias("b")).collect()}
    assert got[3.0][0] == pytest.approx(1041.83267, abs=1e-5)
    assert got[25.0][1] == pytest.approx(1031.654229, abs=1e-5) and got[20.0][1] == pytest.approx(1017.726743, abs=2e-2) and got[12.0][1] == pytest.approx(1062.928258, abs=1e-5)


def test_output_is_guarded(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "segment int, v double")
    path, same = str(tmp_path / "out"), lambda b: b.select("segment", "v", F.lit(1.0).alias("low"))
    incremental.append_guarded(rows.where("segment = 1"), path, same)
    with pytest.raises(FileExistsError):
        incremental.append_guarded(rows, path, same)
    with pytest.raises(ValueError):
        incremental.append_guarded(rows, path, lambda b: same(b).withColumn("low", F.lit(2.0)), [2], ["low"])
    wider = lambda b: same(b).unionByName(same(b).withColumn("low", F.lit(2.0)))
    incremental.append_guarded(rows.where("segment = 9"), str(tmp_path / "two"), wider, None, None)
    incremental.append_segment(rows.where("segment = 1"), str(tmp_path / "two"), wider)
    with pytest.raises(ValueError):  # a part of the axis is not the axis
        incremental.append_guarded(rows, str(tmp_path / "two"), same, [2], ["low"])
    incremental.append_guarded(rows, path, same, [2], ["low"])
    assert sorted(r.segment for r in spark.read.parquet(path).collect()) == [1, 2]


def test_the_tree_finds_the_nearest_at_any_distance(spark, tmp_path):
    import random

    r = random.Random(3)
    pts = [(k, r.uniform(-170, 170), r.uniform(-85, -40)) for k in range(12)]
    targets = [(k, r.uniform(-20, 20), r.uniform(-80, -70), float(k)) for k in range(25)]
    p, t = spark.createDataFrame(pts, "n int, lon double, lat double"), spark.createDataFrame(targets, "m int, lon double, lat double, v double")
    cut = cutter(spark)
    got = {x.n: x.v for x in joins.nearest_value(p, t, "v", "m", cut).collect()}
    assert got == {n: min(targets, key=lambda q: (q[1] - lon) ** 2 + (q[2] - lat) ** 2)[3] for n, lon, lat in pts}

    def flat(a, b, c, d):
        return math.hypot(6.371e6 * math.cos(math.radians((b + d) / 2)) * math.radians(c - a), 6.371e6 * math.radians(d - b)) / 1000

    got = {x.n: x.distance for x in joins.distance_to_set(p, t, ["n"], cut).collect()}
    assert all(got[n] == pytest.approx(min(flat(lon, lat, q[1], q[2]) for q in targets), rel=2e-3) for n, lon, lat in pts)


def test_a_folder_that_not_all_machines_share_is_refused():
    from types import SimpleNamespace

    from strataframe.plans.cuts import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn")))


def test_running_total_in_blocks(spark):
    rows = [(k, k % 7 + 1) for k in range(50)]
    got = {r.t: r.total for r in stencil.running_total(spark.createDataFrame(rows, "t int, v long"), "v", "t", F.floor(F.col("t") / 9)).collect()}
    assert got == {k: sum(v for n, v in rows if n <= k) for k, _ in rows}


def test_nearest_fill_of_any_radius(spark):
    """One valid cell in a corner fills the plane; with more, the k nearest and their ties."""
    plane = [(j, i) for j in range(9) for i in range(9)]
    for valid, k in (({(0, 0): 4.0}, 10), ({(0, 0): 1.0, (0, 8): 2.0, (8, 0): 3.0, (4, 4): 9.0, (5, 5): 0.0}, 2)):
        df = spark.createDataFrame([(1, j, i, valid.get((j, i))) for j, i in plane], "t int, j int, i int, v double")
        got = {(r.j, r.i): r.v for r in fill.nearest_weighted(df, ["t"], "v", k, None, cutter(spark)).collect()}
        for j, i in plane:
            d = {p: math.hypot(p[0] - j, p[1] - i) for p in valid}
            last = sorted(d.values())[min(k, len(d)) - 1]
            near = {p: x for p, x in d.items() if x <= last + 1e-12}
            want = valid[j, i] if (j, i) in valid else sum(valid[p] / x for p, x in near.items()) / sum(1 / x for x in near.values())
            assert got[j, i] == pytest.approx(want)


def test_pairs_tried_stay_level_as_the_grid_is_refined(spark):
    import random

    r, cut, tried = random.Random(7), cutter(spark), []
    points = spark.createDataFrame([(k, r.uniform(-50, 50), r.uniform(-80, 80)) for k in range(60)], "n int, lon double, lat double")
    for size in (12, 48, 96):
        axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        grid = spark.range(1).select(axis(size).alias("j")).withColumn("i", axis(size)).select("j", "i", (F.col("i") * (100.0 / size) - 50).alias("_lon"), (F.col("j") * (160.0 / size) - 80).alias("_lat"))
        dense = grid.unionByName(grid.select("j", "i", (F.col("_lon") / 1000).alias("_lon"), (F.col("_lat") / 1000).alias("_lat")))  # a crowd in the middle
        for metric in (joins._Plane(), joins._Flat()):
            pairs = joins.nearest_pairs(points, dense, metric, cut)
            tried.append(pairs.count() / 60)
            got = {x.n: x.d for x in pairs.groupBy("n").agg(F.min(metric.exact()).alias("d")).collect()}
            want = {x.n: x.d for x in points.crossJoin(dense).groupBy("n").agg(F.min(metric.exact()).alias("d")).collect()}
            assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], rel=1e-9) for n in want)
    assert max(tried) < 12 * joins.LEAF and joins.nearest_pairs(points, dense.limit(0), metric, cut).count() == 0


def test_fill_from_the_frontier_is_that_of_whole_rounds(spark):
    import random

    r = random.Random(4)
    rows = [(t, j, i, r.random() if r.random() < 0.06 or (j, i) == (5, 5) else None) for t in range(3) for j in range(11) for i in range(13) if r.random() < 0.85 or (j, i) == (5, 5)]
    value = {(t, j, i): v for t, j, i, v in rows}

    def rounds(own):
        while None in own.values():
            near = {c: [own[x] for x in ((c[0], c[1], c[2] - 1), (c[0], c[1], c[2] + 1), (c[0], c[1] - 1, c[2]), (c[0], c[1] + 1, c[2])) if own.get(x) is not None] for c, v in own.items() if v is None}
            new = {c: sum(v) / len(v) for c, v in near.items() if v}
            if not new:
                return None
            own = {**own, **new}
        return own

    stuck = {c for c in value if c[0] == 1 and c[1:] != (5, 5)}
    for own in (value, {c: None if c in stuck or c == (1, 5, 5) else v for c, v in value.items()}):
        df, want = spark.createDataFrame([(*c, v) for c, v in own.items()], "t int, j int, i int, x double"), rounds(own)
        if want is None:
            with pytest.raises(ValueError):
                fill.fill_all(df, ["t"], "x", cutter(spark))
        else:
            got = {(x.t, x.j, x.i): x.x for x in fill.fill_all(df, ["t"], "x", cutter(spark)).collect()}
            assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_trends_by_cutoff_from_moments(spark):
    import random

    r = random.Random(2)
    rows = [(k % 2, k, 1e6 + r.uniform(0, 10)) for k in range(200)] + [(0, 500, None)]
    cutoffs = [1e6 + 7.5, 1e6 + 2, 1e6 + 9.99, 1e6 + 20, 1e6 + 2]
    got = {(x.g, x.cutoff): x for x in stats.trend_by_cutoff(spark.createDataFrame(rows, "g int, x int, v double"), ["g"], "v", "x", cutoffs).collect()}
    for g in (0, 1):
        for c in set(cutoffs):
            own = [(x, v) for k, x, v in rows if k == g and v is not None and v > c]
            assert ((g, c) in got) == bool(own)
            if len(own) > 2:
                a, b = np.polyfit(*zip(*own, strict=True), 1)
                assert got[g, c].n == len(own) and got[g, c].slope == pytest.approx(a, rel=1e-6, abs=1e-9) and got[g, c].intercept == pytest.approx(b, rel=1e-6)


def test_coordinates_are_ranked_by_ranges(spark):
    rows = [(float(k * 7919 % 1000) / 8, float(-k)) for k in range(1000)] + [(3.0, -5.0)]
    got = ingest.points_to_grid(spark.createDataFrame(rows, "lon double, lat double").repartition(5), cutter(spark)).collect()
    lons, lats = sorted({a for a, _ in rows}), sorted({b for _, b in rows})
    assert len(got) == 1001 and all(lons[x.i] == x.lon and lats[x.j] == x.lat for x in got)
