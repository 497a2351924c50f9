"""Headerless arrays: ranges of a file, round trips, failures."""

import struct

import pytest

from strataframe.sources.binary import ArrayWriter, Layout, read_arrays, write_arrays

LAYOUT = Layout("tyx", {"y": 3, "x": 4})


@pytest.mark.parametrize("split", [1, 48, 100, 1 << 20])
def test_ranges_of_a_foreign_file(spark, tmp_path, split):
    (tmp_path / "a.bin").write_bytes(struct.pack(">60f", *[float(n) if n != 5 else -9999.0 for n in range(60)]))
    df = read_arrays(spark, str(tmp_path), LAYOUT, split)
    rows = {(r.t, r.j, r.i): r.value for r in df.collect()}
    assert len(rows) == 60 and rows[0, 1, 1] is None and all(v == 12 * t + 4 * j + i for (t, j, i), v in rows.items() if (t, j, i) != (0, 1, 1))
    assert df.rdd.getNumPartitions() == (5 if split < 96 else 3 if split == 100 else 1)  # whole records


@pytest.mark.parametrize(("bits", "big"), [(32, True), (64, False)])
def test_round_trip_of_a_sparse_field(spark, tmp_path, bits, big):
    layout = Layout("tzx", {"z": 2, "x": 5}, "v", bits, big)
    rows = [(t, k, i, float(t * 100 + k * 10 + i) if i else None) for t in (0, 1, 4, 7) for k in range(2) for i in range(0, 5, 2)]
    path = str(tmp_path / "out")
    write_arrays(spark.createDataFrame(rows, "t int, k int, i int, v double"), path, layout, 3)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["000000000000.bin", "000000000003.bin", "000000000006.bin"]
    got = {(r.t, r.k, r.i): r.v for r in read_arrays(spark, path, layout).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(t, k, i): v for t, k, i, v in rows if v is not None}
    write_arrays(spark.createDataFrame([(0, 0, 0, 1.0)], "t int, k int, i int, v double"), path, layout, 3, overwrite=True)
    assert [(r.t, r.v) for r in read_arrays(spark, path, layout).where("v IS NOT NULL").collect()] == [(0, 1.0)]


def test_what_is_refused_leaves_nothing(spark, tmp_path):
    layout, path = Layout("tx", {"x": 3}), str(tmp_path / "out")
    twice = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "t int, i int, value double")
    with pytest.raises(Exception, match="several values"):
        write_arrays(twice, path, layout, 2)
    with pytest.raises(Exception, match="outside the sizes"):
        write_arrays(spark.createDataFrame([(0, 3, 1.0)], "t int, i int, value double"), path, layout, 2)
    assert not list((tmp_path / "out").glob("*"))
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no multiple"):
        read_arrays(spark, str(tmp_path / "odd.bin"), layout).count()
    with pytest.raises(ValueError):
        Layout("tq", {"q": 3})
    empty = tmp_path / "none"
    empty.mkdir()
    assert read_arrays(spark, str(empty), layout).count() == 0


def test_only_committed_attempts_appear(tmp_path):
    import pyarrow as pa

    options = {"layout": Layout("tx", {"x": 2}).option(), "path": str(tmp_path), "records": "4"}
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), pa.array([1.0, 2.0])], names=["record", "number", "value"])
    w = ArrayWriter(options, False)
    w.write(iter([batch]))  # a lost attempt
    w.commit([w.write(iter([batch])), None])
    assert [p.name for p in tmp_path.iterdir()] == ["000000000000.bin"]
    v = ArrayWriter(options, False)
    v.abort([v.write(iter([batch]))])
    assert [p.name for p in tmp_path.iterdir()] == ["000000000000.bin"]
