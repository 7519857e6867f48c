import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.sources import rasters, tables, vectors
from siteflux.streaming import series


def test_tiff_round_trip(spark, tmp_path):
    a = np.arange(12, dtype="int32").reshape(3, 4)
    a[1, 2] = -999999
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(a, (10.0, 10.0), (100.0, 500.0), -999999))
    rows = {(r["i"], r["j"]): r for r in rasters.read_tiffs(spark, str(tmp_path / "a.tif")).collect()}
    assert rows[1, 2]["value"] is None and rows[2, 3]["value"] == 11 and (rows[0, 0]["x"], rows[0, 0]["y"]) == (105.0, 495.0)


def test_zarr_round_trip(spark, tmp_path):
    a = np.arange(20, dtype="<f4").reshape(4, 5)
    a[0, 0] = np.nan
    (tmp_path / "z").mkdir()
    for name, content in rasters.write_zarr(a, (3, 2)).items():
        (tmp_path / "z" / name).write_bytes(content)
    rows = {tuple(r["index"]): r["value"] for r in rasters.read_zarr(spark, str(tmp_path / "z")).collect()}
    assert len(rows) == 20 and rows[0, 0] is None and rows[3, 4] == 19


def test_netcdf_classic():
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 1) + name("x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0) + struct.pack(">II", 11, 1)
    var = name("zeta") + struct.pack(">II", 1, 0) + struct.pack(">II", 0, 0) + struct.pack(">II", 6, 24)
    data = head + var + struct.pack(">I", len(head) + len(var) + 4) + struct.pack(">3d", 1.5, 2.5, 3.5)
    axes, values = rasters.decode_netcdf(data)["zeta"]
    assert axes == ("x",) and values.tolist() == [1.5, 2.5, 3.5]


def test_netcdf_files_as_rows(spark, tmp_path):
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 2) + name("t") + struct.pack(">I", 2) + name("x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0) + struct.pack(">II", 11, 1)
    var = name("zeta") + struct.pack(">III", 2, 0, 1) + struct.pack(">II", 0, 0) + struct.pack(">II", 6, 48)
    (tmp_path / "a.nc").write_bytes(head + var + struct.pack(">I", len(head) + len(var) + 4) + struct.pack(">6d", 1.5, 2.5, float("nan"), 4, 5, 6))
    rows = {tuple(r["index"]): r["value"] for r in rasters.read_netcdf(spark, str(tmp_path / "a.nc"), "zeta").collect()}
    assert rows == {(0, 0): 1.5, (0, 1): 2.5, (0, 2): None, (1, 0): 4, (1, 1): 5, (1, 2): 6}


def test_bounds_filter_reaches_the_scan(spark, tmp_path):
    rows = [(k, float(k), 0.0, k + 1.0, 1.0) for k in range(9)]
    spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double").write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "b")).filter(vectors.touching(3.5, 0.5, 5.5, 9.0))
    assert sorted(r["id"] for r in df.collect()) == [3, 4, 5]
    assert "PushedFilters: [IsNotNull(xmin), IsNotNull(xmax)" in df._jdf.queryExecution().toString()


def test_wkb(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    out = vectors.rings_of_wkb(spark.createDataFrame([(7, wkb), (8, None)], "id int, g binary"), "id", "g").collect()
    assert len(out) == 1 and out[0]["id"] == 7 and len(out[0]["ring"]) == 3
    assert vectors.masked(spark.createDataFrame(out), 5, 5, 6, 6).count() == 0


def _wkb_polygon(rings, extra=0, code=3, srid=None):
    flag = 0x20000000 if srid is not None else 0
    out = struct.pack("<BI", 1, code | flag) + (struct.pack("<I", srid) if flag else b"") + struct.pack("<I", len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) + struct.pack("<d", 9.0) * extra for p in r)
    return out


def test_wkb_keeps_holes_heights_and_references():
    outer, hole = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 4.0)]
    want = [(0, False, outer[:-1]), (0, True, hole[:-1])]
    plain = _wkb_polygon([outer, hole])
    kinds = [plain, _wkb_polygon([outer, hole], 1, 1003), _wkb_polygon([outer, hole], 1, 2003), _wkb_polygon([outer, hole], 2, 3003)]
    kinds += [_wkb_polygon([outer, hole], 1, 0x80000003), _wkb_polygon([outer, hole], 2, 0xC0000003), _wkb_polygon([outer, hole], 0, 3, 5070), _wkb_polygon([outer, hole], 1, 0x80000003, 5070)]
    assert all(vectors.wkb_shape(k) == want for k in kinds)
    two = struct.pack("<BII", 1, 6, 2) + plain + _wkb_polygon([outer])
    assert vectors.wkb_shape(two) == want + [(1, False, outer[:-1])]
    assert vectors.wkb_shape(struct.pack("<BIddd", 1, 1001, 1.0, 2.0, 3.0)) == [(0, False, [(1.0, 2.0)])]


def test_points_in_holes_are_outside(spark):
    from siteflux.operators import spatial

    outer, hole = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    shapes = vectors.shapes_of_wkb(spark.createDataFrame([(7, _wkb_polygon([outer, hole])), (8, None)], "poly int, g binary"), "poly", "g")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 3.0, 3.0), (3, 11.0, 5.0)], "p int, x double, y double")
    out = {r["p"]: (r["poly"], r["dist"]) for r in spatial.within_or_nearest(points, shapes, "p", "poly", "x", "y", 2.5, 2.0).collect()}
    assert out == {1: (7, 1.0), 2: (7, 0.0), 3: (7, 1.0)}
    assert shapes.select(spatial.shape_area(F.col("shape"))).first()[0] == 96


def test_shapefile_holes(spark, tmp_path):
    rings = [[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)], [(20, 0), (20, 1), (21, 1), (21, 0), (20, 0)], [(50, 0), (51, 0), (51, 1), (50, 0)]]
    flat = [p for r in rings for p in r]
    body = struct.pack("<I4d2I", 5, 0, 0, 51, 10, len(rings), len(flat)) + struct.pack("<4I", 0, 5, 10, 15) + b"".join(struct.pack("<dd", *p) for p in flat)
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">II", 1, len(body) // 2) + body)
    shape = vectors.read_shapes(spark, str(tmp_path / "a.shp")).first()["shape"]
    assert [(r["part"], r["hole"], len(r["ring"])) for r in shape] == [(0, False, 4), (1, False, 4), (0, True, 4), (2, False, 3)]


def test_combined_arrays_of_unequal_length(spark):
    cube = lambda n: spark.createDataFrame([([t, k], 10.0 * t + k) for t in range(n) for k in range(2)], "index array<long>, value double")
    times = [100.0 + t for t in range(8)]
    for lengths in (None, [3, 5]):
        out = rasters.combined([cube(3), cube(5)], {"t": times, "lat": [40.0, 41.0]}, lengths).collect()
        assert {(r["t"], r["lat"]): r["value"] for r in out} == {(100.0 + t, 40.0 + k): 10.0 * (t if t < 3 else t - 3) + k for t in range(8) for k in range(2)}
    table = spark.createDataFrame(list(enumerate(times)), "position int, coordinate double")
    gap = cube(3).filter(F.get("index", F.lit(0)) < 2)  # the last time of the first array has no cells
    out = rasters.combined([gap, cube(5)], {"t": table, "lat": [40.0, 41.0]}, [3, 5]).collect()
    assert len(out) == 14 and {r["t"] for r in out} == {*times} - {102.0}
    with pytest.raises(ValueError):
        rasters.combined([gap, cube(5)], {"t": table, "lat": [40.0, 41.0]})


def test_file_numbers_and_chunks(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "event_0007_x"))
    df = spark.read.parquet(str(tmp_path / "event_0007_x")).select(F.regexp_extract("_metadata.file_path", r"event_(\d+)", 1).cast("int").alias("e"))
    assert df.distinct().collect()[0]["e"] == 7
    path = str(tmp_path / "sink")
    tables.write_chunks(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ["k"])
    tables.write_chunks(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    left = tables.pending(spark.createDataFrame([("a",), ("c",)], "k string"), spark.read.parquet(path), ["k"])
    assert [r["k"] for r in left.collect()] == ["c"]


def test_streaming_daily_max(spark, tmp_path):
    from siteflux.streaming import series

    rows = [("2024-01-01 01:00:00", 1, 5.0), ("2024-01-01 09:00:00", 1, 7.0), ("2024-01-02 01:00:00", 1, 2.0), ("2024-01-05 01:00:00", 1, 1.0)]
    spark.createDataFrame(rows, "ts string, user int, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = series.read_files(spark, str(tmp_path / "in"), "ts timestamp, user int, value double")
    q = series.write_table(series.daily_max(stream, ["user"], "ts", "value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {str(r["date"]): r["value_max"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == 7.0 and got["2024-01-02"] == 2.0


def test_lists_and_typed_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("NC\n\n  SC \n")
    assert [r["value"] for r in tables.lines(spark, str(tmp_path / "a.txt")).collect()] == ["NC", "SC"]
    (tmp_path / "b.csv").write_text("x,id,v\n1,007,2.5\n2,08,\n")
    got = tables.csv(spark, str(tmp_path / "b.csv"), "x int, id string, v double", ("x",)).collect()
    assert [tuple(r) for r in got] == [("007", 2.5), ("08", None)]


def test_point_layer_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1.5, -2.0, "a", 7), (3.0, 4.0, None, 8), (0.0, 0.0, "é", None)], "x double, y double, name string, n int").coalesce(1)
    assert tables.save_files(vectors.point_files(d, "x", "y", ["name", "n"]), str(tmp_path)) == 3
    got = vectors.read_layer(spark, str(tmp_path), ["name", "n"]).orderBy("record").collect()
    assert [(r["ring"][0]["x"], r["ring"][0]["y"], r["name"], r["n"]) for r in got] == [(1.5, -2.0, "a", "7"), (3.0, 4.0, None, "8"), (0.0, 0.0, "é", None)]
    assert vectors.point_files(d.limit(0), "x", "y", ["name"]).count() == 0


def test_tiles_and_regions(spark, tmp_path):
    cells = spark.range(70).select((F.col("id") / 10).cast("int").alias("i"), (F.col("id") % 10).alias("j"), F.when(F.col("id") != 3, F.col("id").cast("double")).alias("value"))
    assert tables.save_files(rasters.tiff_tiles(cells, 100.0, 50.0, 2.0, 3.0, tile=4), str(tmp_path / "t")) == 6
    got = {(r["x"], r["y"]): r["value"] for r in rasters.read_tiffs(spark, str(tmp_path / "t")).filter("value IS NOT NULL").collect()}
    assert got == {(101.0 + 2 * (k % 10), 48.5 - 3 * (k // 10)): float(k) for k in range(70) if k != 3}
    z = tmp_path / "z"
    z.mkdir()
    (z / ".zarray").write_bytes(rasters.zarr_template([7, 10], [4, 5]))
    for part in (cells.filter("i < 4"), cells.filter("i >= 4")):  # two regions
        tables.save_files(rasters.zarr_chunks(part, ["i", "j"], [4, 5]), str(z))
    cube = rasters.read_zarr(spark, str(z))
    assert {tuple(r["index"]): r["value"] for r in cube.filter("value IS NOT NULL").collect()} == {(k // 10, k % 10): float(k) for k in range(70) if k != 3}
    both = rasters.combined([cube, cube], {"t": [float(t) for t in range(14)], "lat": [40.0 + j for j in range(10)]})
    assert both.agg(F.max("t"), F.max("lat")).first()[:] == (13.0, 49.0) and both.count() == 140


def test_lzw():
    raw, codes = bytes(range(256)) * 3 + b"aaaaabababab", []
    for k in range(0, len(raw), 200):
        codes += [256, *raw[k : k + 200]]
    codes.append(257)
    bits = "".join(f"{c:09b}" for c in codes)
    packed = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert rasters.unpack_lzw(packed) == raw
    run = "".join(f"{c:09b}" for c in (256, 97, 258, 259, 257))  # a, aa, aaa
    assert rasters.unpack_lzw(bytes(int(run[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(run), 8))) == b"aaaaaa"


def test_stream_totals(spark, tmp_path):
    rows = spark.range(48).select(F.lit("k").alias("k"), F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), F.lit(1.0).alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = series.rolling_total(series.read_files(spark, str(tmp_path / "in"), rows.schema), ["k"], "ts", "v", 6)
    series.write_table(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    totals = [r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert max(totals) == 6.0 and len(totals) > 20
