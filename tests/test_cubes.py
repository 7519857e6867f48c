"""Data sources of arrays: what they read, and that writes are whole."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from siteflux.sources import cubes, rasters


@pytest.fixture
def cube(tmp_path):
    a = np.arange(6 * 7 * 8, dtype="<f8").reshape(6, 7, 8)
    a[1, 2, 3] = np.nan
    for name, content in rasters.write_zarr(a, (2, 3, 4)).items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path), a


def _cells(a, keep=lambda *at: True):
    return {at: None if np.isnan(v) else v for at, v in np.ndenumerate(a) if keep(*at)}


def _rows(df, names):
    return {tuple(r[n] for n in names): r["value"] for r in df.collect()}


def test_cube_reads_whole_and_by_bounds(spark, cube):
    path, a = cube
    names = ["t", "i", "j"]
    assert _rows(cubes.read_cube(spark, path, names), names) == _cells(a)
    some = cubes.read_cube(spark, path, names, within={"t": (2, 3), "j": (4, 5)}, cells=1)
    assert _rows(some, names) == _cells(a, lambda t, i, j: t in (2, 3) and j in (4, 5))
    assert some.rdd.getNumPartitions() == 1 * 3 * 1
    named = cubes.read_cube(spark, path, ["t", ("lat", 50.0, -0.5), ("lon", 10.0, 0.25)], within={"lat": (49.0, 49.9), "lon": (11.1, 12.0)}, cells=1)
    want = {(t, 50 - 0.5 * i, 10 + 0.25 * j): v for (t, i, j), v in _cells(a, lambda t, i, j: i in (1, 2) and j >= 5).items()}
    assert _rows(named, ["t", "lat", "lon"]) == want and named.rdd.getNumPartitions() == 3 * 1 * 1
    assert cubes.read_cube(spark, path, names, within={"t": (9, 12)}).count() == 0


def test_filters_choose_the_chunks(spark, cube):
    path, a = cube
    options = {"path": path, "axes": '[["t"], ["i"], ["j"]]', "cells": "1"}
    for filters, chunks in (
        ([], 18), ([EqualTo(("t",), 5)], 6), ([GreaterThan(("t",), 1), LessThan(("j",), 3)], 9), ([In(("i",), (0, 1, None))], 6),
        ([GreaterThanOrEqual(("t",), 2), LessThanOrEqual(("t",), 2), EqualTo(("value",), 3.0)], 6), ([EqualTo(("t",), 99)], 0),
    ):
        reader = cubes.PushedZarrReader(dict(options))
        assert reader.pushFilters(filters) == filters and sum(len(p.items) for p in reader.partitions()) == chunks
    spark.conf.set(cubes.PUSHDOWN, "true")
    try:
        df = cubes.read_cube(spark, path, ["t", "i", "j"], cells=1).filter("t = 3 AND j < 2")
        assert df.rdd.getNumPartitions() == 3 and _rows(df, ["t", "i", "j"]) == _cells(a, lambda t, i, j: t == 3 and j < 2)
    finally:
        spark.conf.unset(cubes.PUSHDOWN)


def _template(folder, shape, chunks):
    folder.mkdir()
    (folder / ".zarray").write_bytes(rasters.zarr_template(shape, chunks))
    return str(folder)


def test_regions_side_by_side_and_a_failed_one(spark, tmp_path):
    path = _template(tmp_path / "z", [8, 10], [4, 5])
    cells = spark.range(80).select((F.col("id") / 10).cast("int").alias("i"), (F.col("id") % 10).alias("j"), F.col("id").cast("double").alias("value"))
    threads = [threading.Thread(target=cubes.write_cube, args=(cells.filter(w), path, ["i", "j"])) for w in ("i < 4", "i >= 4")]
    [t.start() for t in threads], [t.join() for t in threads]
    whole = {(k // 10, k % 10): float(k) for k in range(80)}
    assert _rows(cubes.read_cube(spark, path, ["i", "j"]), ["i", "j"]) == whole
    bad = cells.withColumn("value", -F.col("value")).withColumn("i", F.when(F.col("i") == 7, 99).otherwise(F.col("i")))
    with pytest.raises(Exception, match="outside the array"):
        cubes.write_cube(bad, path, ["i", "j"])
    assert _rows(cubes.read_cube(spark, path, ["i", "j"]), ["i", "j"]) == whole
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == [".zarray", "0.0", "0.1", "1.0", "1.1"]
    cubes.write_cube(cells.filter("i = 2 AND j < 3").withColumn("value", F.when(F.col("j") > 0, F.lit(7.0))), path, ["i", "j"])
    assert _rows(cubes.read_cube(spark, path, ["i", "j"]), ["i", "j"]) == whole | {(2, 0): None, (2, 1): 7.0, (2, 2): 7.0}


def test_part_of_an_array_is_null_until_written(spark, tmp_path):
    path = _template(tmp_path / "z", [5, 5], [4, 4])
    cubes.write_cube(spark.createDataFrame([(4, 4, 2.5), (0, 1, 1.5)], "i int, j int, value double"), path, ["i", "j"])
    got = _rows(cubes.read_cube(spark, path, ["i", "j"]), ["i", "j"])
    assert {k: v for k, v in got.items() if v is not None} == {(4, 4): 2.5, (0, 1): 1.5} and len(got) == 17


def test_tiff_blocks(spark, tmp_path):
    a = np.arange(35.0).reshape(5, 7)
    a[2, 2] = -9
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(a, (10.0, 10.0), (100.0, 500.0), -9))
    (tmp_path / "b.tif").write_bytes(rasters.encode_tiff(a + 100, (10.0, 10.0), (900.0, 500.0), -9))
    df = cubes.read_tiff_cells(spark, str(tmp_path))
    old = rasters.read_tiffs(spark, str(tmp_path)).withColumn("file", F.regexp_replace("file", "^file:", ""))
    key = lambda r: (r["file"], r["i"], r["j"])
    assert sorted(df.collect(), key=key) == sorted(old.select(df.columns).collect(), key=key)
    near = cubes.read_tiff_cells(spark, str(tmp_path), within={"x": (0, 130)}, cells=1)
    assert near.count() == 15 and near.rdd.getNumPartitions() == 1
