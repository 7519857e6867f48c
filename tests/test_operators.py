"""Small cases with answers worked out by hand."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.functions import keys, physics
from siteflux.operators import events, graph, leafwise, models, nearest, overlay, parallel, raster, sampling, spatial, stats, timeseries
from siteflux.operators.matching import PrefixMatch


def test_prefix_match(spark):
    c = spark.createDataFrame(
        [("b1", "35.1", "-77.0", "NC", ["37049"], "28560"), ("b2", "35.1", "-77.0", "NC", ["37049", "37103"], "28562"), ("b3", "35.1", "-77.0", "NC", ["37103"], None)],
        "id string, lat string, lon string, state string, county_values array<string>, zip string",
    )
    r = spark.createDataFrame(
        [(1, "35.1", "-77.0", "NC", "37049", "28560"), (2, "35.1", "-77.0", "NC", "37103", "99999"), (3, "35.1", "-77.0", "NC", None, "28562"),
         (4, "35.1", "-77.0", "NC", "00000", "28560"), (5, "36.0", "-80.0", "NC", "37049", "28560")],
        "rec int, lat string, lon string, state string, county string, zip string",
    )
    info, lookup = PrefixMatch(["lat", "lon", "state", "county", "zip"], 3, ["county"]).run(r, c, "rec", "id")
    got = {x["rec"]: x for x in info.collect()}
    assert [(got[k]["match_precision"], got[k]["num_matches"]) for k in range(1, 6)] == [(5, 1), (4, 2), (4, 1), (3, 3), (0, 0)]
    assert got[5]["match_key"] is None and got[3]["match_type"] == "lat+lon+state+zip"
    assert got[1]["match_key"].startswith("(lat==35.1)&(lon==-77.0)&")
    held = {}
    for x in lookup.collect():
        held.setdefault(x["match_key"], set()).add(x["id"])
    assert held[got[1]["match_key"]] == {"b1"} and held[got[2]["match_key"]] == {"b2", "b3"} and held[got[4]["match_key"]] == {"b1", "b2", "b3"}


def test_stock_from_flows(spark):
    p = spark.createDataFrame([("a", date(2009, 1, 2), date(2009, 1, 4), 2), ("a", date(2009, 1, 3), date(2009, 1, 5), 1), ("a", date(2008, 12, 31), date(2009, 1, 3), 5), ("a", None, date(2009, 1, 4), 9)], "g string, o date, c date, n int")
    out = timeseries.stock_from_flows(p, ["g"], "o", "c", "n", "2009-01-01", "2009-01-05").orderBy("date")
    assert [r["stock"] for r in out.collect()] == [0, 2, -2, -4, -5]


def test_presence_absence(spark):
    cases = [(3, 10, 50), (8, 5, 50), (12, 20, 10), (2, 20, 10), (0, 4, 3)]
    c = spark.createDataFrame([(1, k) for k, (n, _, _) in enumerate(cases) for _ in range(n)], "event int, key int")
    p = spark.createDataFrame([(1, k) for k, (_, n, _) in enumerate(cases) for _ in range(n)], "event int, key int")
    b = spark.createDataFrame([(k, n) for k, (_, _, n) in enumerate(cases)], "key int, num_buildings int")
    out = events.presence_absence(c, p, b, ["event", "key"], "key").orderBy("key").collect()
    assert [(r["num_presence"], r["num_absence"]) for r in out] == [(3, 7), (8, 0), (10, 0), (2, 8), (0, 3)]


def test_rolling_and_antecedent(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, None, 5.0, 1.0, 2.0])], "t int, v double").withColumn("g", F.lit(1))
    out = [r[0] for r in df.select(timeseries.full_window(F.col("v"), 3, ["g"], "t").alias("m"), "t").orderBy("t").collect()]
    assert out[:6] == [None, None, 2.0, None, None, None] and abs(out[6] - 8 / 3) < 1e-12
    d = spark.createDataFrame([(0, 10.0), (1, 0.0), (2, 5.0)], "t int, v double").withColumn("g", F.lit(1))
    api = d.select(timeseries.antecedent_index(F.col("v"), ["g"], "t", hours=3).alias("a"), "t").orderBy("t").collect()
    assert api[0]["a"] is None and abs(api[2]["a"] - 14.9126) < 1e-4


def test_keys(spark):
    values = [35.05, 35.15, -78.25, 76.95, 0.05, 1234.56]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(keys.tenth_key(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:.1f}" for v in values]
    z = spark.createDataFrame([("ae",), ("V1",), ("X",), (None,)], "z string").select(keys.zone_flag(F.col("z")), keys.coastal_flag(F.col("z"))).collect()
    assert [tuple(r) for r in z] == [(1, 0), (1, 1), (0, 0), (0, 0)]


def test_upstream_reach(spark):
    e = spark.createDataFrame([(1, 3, 2.0), (2, 3, 5.0), (3, 4, 1.0)], "src int, dst int, weight double")
    s = spark.createDataFrame([(4,)], "node int")
    at = lambda c: {r["node"]: r["dist"] for r in graph.reach(graph.reverse(e), s, c).collect()}
    assert at(0) == {4: 0} and at(3) == {4: 0, 3: 1, 1: 3} and at(6) == {4: 0, 3: 1, 1: 3, 2: 6}
    loop = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src int, dst int, weight double")
    assert graph.reach(loop, spark.createDataFrame([(1,)], "node int"), 100.0).count() == 2


def test_flow_path_strip(spark):
    cells = spark.createDataFrame([(0, j, 1, j == 3) for j in range(4)], "i int, j int, direction int, stop boolean")
    elev = spark.createDataFrame([(0, j, v) for j, v in enumerate([900, 700, 400, 300])], "i int, j int, value int")
    paths = raster.flow_paths(cells, 10.0, 10.0)
    assert [r["dist"] for r in paths.orderBy("j").collect()] == [30, 20, 10, 0]
    assert [r["hand"] for r in raster.height_above(paths, elev).orderBy("j").collect()] == [600, 400, 100, 0]
    cycle = spark.createDataFrame([(0, 0, 1, False), (0, 1, 16, False)], "i int, j int, direction int, stop boolean")
    assert [r["dist"] for r in raster.flow_paths(cycle, 1.0, 1.0, most=8).collect()] == [None, None]


def test_long_flow_paths_and_cycles(spark):
    n = 1300
    cells = spark.createDataFrame([(0, j, 1, False) for j in range(n)] + [(5, 0, 1, False), (5, 1, 16, False)], "i int, j int, direction int, stop boolean")
    got = {(r["i"], r["j"]): r["dist"] for r in raster.flow_paths(cells, 1.0, 1.0).collect()}
    assert got == {(0, j): n - 1.0 - j for j in range(n)} | {(5, 0): None, (5, 1): None}
    got = {(r["i"], r["j"]): r["dist"] for r in raster.flow_paths(cells, 1.0, 1.0, most=1000).collect()}
    assert got == {(0, j): n - 1.0 - j if n - 1 - j <= 1000 else None for j in range(n)} | {(5, 0): None, (5, 1): None}


def test_reach_refuses_negative_times(spark):
    e = spark.createDataFrame([(1, 2, -1.0)], "src int, dst int, weight double")
    with pytest.raises(ValueError):
        graph.reach(e, spark.createDataFrame([(1,)], "node int"), 3.0)


def test_polygons_meet_only_where_sides_do(spark):
    stairs = [(0, 0), (10, 0), (10, 1), (5, 1), (5, 2), (1, 2), (1, 10), (0, 10)]
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    shape = lambda *rings: [(0, k > 0, [(float(a), float(b)) for a, b in r]) for k, r in enumerate(rings)]
    rows = [(1, shape(stairs)), (2, shape(square(7, 2, 1))), (3, shape(square(9, 1, 1))), (4, shape(square(-5, -5, 30), square(6, 1.5, 4))), (5, shape(square(7, 2.5, 0.25))), (6, shape(square(10, 5, 1)))]
    df = spark.createDataFrame(rows, "id int, shape array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>")
    for tile in (3.0, 100.0):
        out = {r["id"]: r["o_values"] for r in spatial.polygon_lists(df, df.withColumnRenamed("id", "o"), "id", "o", tile).collect()}
        #: 4 surrounds all but 2 and 5, which lie in its hole; 3 crosses the hole's outline.
        assert out == {1: [1, 3, 4], 2: [2, 5], 3: [1, 3, 4], 4: [1, 3, 4, 6], 5: [2, 5], 6: [4, 6]}


def _star(rng, corners, x, y, far):
    turn = np.sort(rng.uniform(0, 2 * np.pi, corners))
    return [(float(x + f * np.cos(t)), float(y + f * np.sin(t))) for t, f in zip(turn, rng.uniform(far / 3, far, corners))]


def _odd(rings, x, y):
    sides = [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1])]
    return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in sides) % 2 == 1


def test_cells_give_the_same_as_whole_shapes(spark):
    rng = np.random.default_rng(8)
    shapes = []
    for k in range(25):
        x, y, far = *rng.uniform(-20, 20, 2), rng.uniform(0.5, 25)
        shapes.append((k, [_star(rng, 12, x, y, far), _star(rng, 7, x, y, far / 3)]))
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(-30, 30, (300, 2)))] + [(1000 + k, 2.0 * k, 2.0 * k) for k in range(-5, 6)]
    g = spark.createDataFrame([(k, [(0, n > 0, r) for n, r in enumerate(s)]) for k, s in shapes], "id int, shape array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>")
    p = spark.createDataFrame(points, "p int, x double, y double")
    want = {i: [k for k, s in shapes if _odd(s, x, y)] or None for i, x, y in points}
    for tile in (2.0, 13.0):
        assert {r["p"]: r["id_values"] for r in spatial.overlapping(p, g, "p", "id", "x", "y", tile).collect()} == want
    whole = {(r["p"], r["id"]): r["d"] for r in p.crossJoin(g).select("p", "id", spatial.distance_to_shape(F.col("shape"), F.col("x"), F.col("y")).alias("d")).collect()}
    got = {r["p"]: (r["id"], r["dist"]) for r in spatial.within_or_nearest(p, g, "p", "id", "x", "y", 2.0, 3.0).collect()}
    for i, _, _ in points:
        low = min((d, k) for (q, k), d in whole.items() if q == i)
        assert got[i] == (want[i][0], 0.0) if want[i] else got[i] == ((low[1], low[0]) if low[0] <= 3 else (None, None))
    near = {r["p"] for r in spatial.near_mask(p, g, "p", "x", "y", 1.5, 2.0).collect()}
    assert near == {i for i, _, _ in points if min(d for (q, _), d in whole.items() if q == i) <= 1.5}


def test_tiling_costs_the_outline_and_the_cells(spark):
    from siteflux.operators import tiling

    n = 4000
    ring = [(1000 * math.cos(2 * math.pi * k / n), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    g = spark.createDataFrame([(1, ring)], "id int, ring array<struct<x:double,y:double>>")
    for tile in (100.0, 25.0):
        cells, sides = tiling.parts(g, "id", tile).agg(F.count("*"), F.sum(F.size("sides"))).first()
        edge, edge_sides = tiling.borders(g, "id", tile).agg(F.count("*"), F.sum(F.size("sides"))).first()
        assert math.pi * (1000 / tile) ** 2 <= cells <= math.pi * (1000 / tile + 1.5) ** 2
        assert sides <= 1.2 * n + 4 * cells and edge <= 14 * 1000 / tile and edge_sides <= 1.2 * n
    area = lambda step: tiling.cell_areas(g, "id", 0.0, 0.0, step).agg(F.sum("overlap_area")).first()[0]
    assert area(30.0) == pytest.approx(n / 2 * 1e6 * math.sin(2 * math.pi / n))


def test_odd_shapes(spark):
    rows = [(1, None), (2, []), (3, [(0, False, [])]), (4, [(0, False, [(0.0, 0.0), (1.0, 1.0)])]), (5, [(0, False, [(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)])]), (None, [(0, False, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])])]
    g = spark.createDataFrame(rows, "id int, shape array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>")
    p = spark.createDataFrame([(1, 3.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0)], "p int, x double, y double")
    assert [(r["p"], r["id"]) for r in spatial.within(p, g, "p", "id", "x", "y", 1.0).collect()] == [(1, None)]
    assert spatial.within(p, g.limit(0), "p", "id", "x", "y", 1.0).count() == 0
    assert spatial.grid_overlap(g, "id", 0.0, 0.0, 1.0).agg(F.sum("overlap_area")).first()[0] == 8.0


def test_weights_and_quantile(spark):
    d = spark.createDataFrame([(1, 0.2), (1, 0.6)], "r int, p double")
    for y, want in ((1, [0.25, 0.75]), (0, [2 / 3, 1 / 3])):
        w = stats.normalized(d.withColumn("w", physics.bernoulli(F.col("p"), F.lit(y))), "r", "w").orderBy("p").collect()
        assert [r["w"] for r in w] == pytest.approx(want)
    zero = stats.normalized(spark.createDataFrame([(1, 0.0), (1, 0.0)], "r int, w double"), "r", "w")
    assert [r["w"] for r in zero.collect()] == [0.5, 0.5]


def test_monte_carlo_counts(spark):
    look = spark.createDataFrame([("k", i) for i in range(20)], "key string, item int")
    counts = spark.createDataFrame([("k", 3, 5)], "key string, num_presence int, num_absence int")
    out = sampling.assign(counts, look, "key", "item", 4, 1).groupBy("replicate").agg(F.sum("flooded").alias("f"), F.countDistinct("item").alias("n")).collect()
    assert {(r["f"], r["n"]) for r in out} == {(3, 8)} and len(out) == 4


def test_clip_and_intersections(spark):
    assert spatial.clip([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 1, 1, 3, 9) != []
    tri = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])], "id int, ring array<struct<x:double,y:double>>")
    cells = spatial.grid_overlap(tri, "id", 0.0, 0.0, 5.0).collect()
    assert sum(r["overlap_area"] for r in cells) == pytest.approx(50.0)
    assert {(r["i"], r["j"]): r["overlap_area"] for r in cells}[0, 1] == pytest.approx(12.5)


def test_gev_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    x = 10 + 2 / 0.1 * ((-np.log(rng.uniform(size=4000))) ** -0.1 - 1)
    df = spark.createDataFrame([(1, float(v)) for v in x], "g int, x double")
    m = stats.gev_return_level(stats.l_moments(df, ["g"], "x"), 2.0).first()
    assert abs(m["shape"] - 0.1) < 0.05 and abs(m["scale"] - 2) < 0.2
    want = 10 + 2 / 0.1 * (math.log(2) ** -0.1 - 1)
    assert abs(m["return_level"] - want) < 0.15
    assert abs(stats.gev_likelihood(df, ["g"], "x", 2.0).first()["return_level"] - want) < 0.15


def test_boosting_keeps_rows_with_nulls(spark, tmp_path):
    rows = [(i % 8, float(i % 13) if i % 4 else None, ["a", "b", None][i % 3], float(i % 13) * 0.5) for i in range(240)]
    d = spark.createDataFrame(rows, "b int, x double, c string, y double")
    make = lambda: models.BlockedBoosting(["x", "c"], "y", "b", None, ["c"], {**models.SETTINGS, "stepSize": 0.3, "minInstancesPerNode": 1, "minInfoGain": 0.0}, rounds=4, folds=2, patience=2, keep_held_out=True)
    m = make().fit(d)
    out = m.predict(d)
    assert out.count() == 240 and out.columns == [*d.columns, "prediction"] and m.held_out.count() == 240 and out.filter("prediction IS NULL").count() == 0
    m.save(str(tmp_path))
    again = make().load(str(tmp_path)).predict(d)
    assert sorted(r["prediction"] for r in again.collect()) == sorted(r["prediction"] for r in out.collect())


def test_impute_from_far(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1e6, 3.0, None), (3, None, 1.0, None), (4, 40.0, 0.0, None), (5, 50.0, 0.0, 7.0)], "k int, x double, y double, v double")
    out = {r["k"]: r["v"] for r in spatial.impute_nearest(d, "k", "x", "y", ["v"], 1.0).collect()}
    assert out == {1: 5.0, 2: 7.0, 3: None, 4: 7.0, 5: 7.0}
    assert spatial.impute_nearest(d.filter("v IS NULL"), "k", "x", "y", ["v"], 1.0).count() == 3


def test_events_by_day_equal_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(k, int(a), int(a + b)) for k, (a, b) in enumerate(zip(rng.integers(0, 4000, 40), rng.integers(0, 300, 40)))], "event int, a int, b int")
    hour = lambda c: F.timestamp_add("HOUR", F.col(c), F.lit("2020-01-01").cast("timestamp_ntz"))
    e = e.select("event", hour("a").alias("start"), hour("b").alias("end"))
    f = spark.createDataFrame([(i, int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 4000, 60), rng.integers(-5, 3000, 60)))], "id int, a int, b int").select("id", hour("a").alias("t"), hour("b").alias("u"))
    middle = F.col("start") + (F.col("end") - F.col("start")) / 2
    for most in (10_000, 0):
        monkeypatch.setattr(events, "SMALL_CATALOGUE", most)
        one, two = events.inside(f, "t", e), f.join(e, F.col("t").between(F.col("start"), F.col("end")))
        assert one.count() == two.count() and "BroadcastNestedLoopJoin" not in one._jdf.queryExecution().toString()
        assert events.in_force(f, "t", "u", e).count() == f.join(e, (F.col("t") <= middle) & (F.col("u") >= middle)).count()


def test_shapes(spark):
    cells = spark.createDataFrame([(i, j, 0.0) for i in range(3) for j in range(4)], "i int, j int, value double")
    assert raster.require_shape(cells, 3, 4) is cells
    for bad in (cells.filter("i + j > 0"), cells.unionByName(cells), cells.limit(0)):
        with pytest.raises(ValueError):
            raster.require_shape(bad, 3, 4)


def test_reach_equals_plain(spark):
    rng = np.random.default_rng(9)
    links = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 30, 70), rng.integers(0, 30, 70), rng.integers(0, 5, 70))}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src int, dst int, weight double")
    got = {(r["source"], r["node"]): r["dist"] for r in graph.reach(e, spark.range(30).select(F.col("id").cast("int").alias("node")), 6.0).collect()}
    want = {(s, s): 0.0 for s in range(30)}
    for _ in range(40):
        for (a, b), w in links.items():
            for s in range(30):
                if (s, a) in want and want[s, a] + w <= 6 and want[s, a] + w < want.get((s, b), 99):
                    want[s, b] = want[s, a] + w
    assert got == want


def test_folds_keep_blocks_whole(spark):
    f = spark.range(100).select((F.col("id") % 10).alias("b")).withColumn("f", models.fold_of("b", 5, 1))
    assert f.groupBy("b").agg(F.countDistinct("f").alias("n")).filter("n > 1").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, o date, c date, n int")
    assert timeseries.stock_from_flows(none, ["g"], "o", "c", "n", "2009-01-01", "2009-01-02").count() == 0
    cells = spark.createDataFrame([], "i int, j int, value double, site boolean")
    assert raster.distance_transform(cells, 1.0, 1.0).count() == 0
    dry = spark.createDataFrame([(0, 0, False)], "i int, j int, site boolean")
    assert raster.distance_transform(dry, 1.0, 1.0).first()["dist"] is None


def test_tiles_join_seamlessly(spark, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 5)
    rng = np.random.default_rng(3)
    z = {(i, j): None if rng.random() < 0.1 else float(rng.integers(0, 40)) for i in range(-3, 14) for j in range(17) if rng.random() > 0.05}
    cells = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()] + [(None, 1, 2.0)], "i long, j long, value double")
    at = lambda i, j: z.get((i, j))

    tpi = {(r["i"], r["j"]): r["tpi"] for r in raster.position_index(cells, 5).collect()}
    steep = {(r["i"], r["j"]): r["slope_x1000"] for r in raster.slope(cells, 2.0, 1.0).collect()}
    forms = {(r["i"], r["j"]): r["form"] for r in raster.landforms(cells, 3, 2.0, 1.0).collect()}
    assert set(tpi) == set(steep) == set(forms) == set(z)
    for (i, j), v in z.items():
        near = [x for a, b in raster.circle(5) if (x := at(i + a, j + b)) is not None]
        assert tpi[i, j] == (None if v is None else int((v - sum(near) / len(near)) * 100))
        ring = [at(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
        assert (steep[i, j] is None) == (None in ring)
        if v is None:
            assert forms[i, j] is None
            continue
        lower = higher = 0
        for a, b in raster.D8.values():
            seen = [math.degrees(math.atan((x - v) / math.hypot(a * r * 2.0, b * r))) for r in (1, 2, 3) if (x := at(i + a * r, j + b * r)) is not None]
            if seen and abs(max(seen) + min(seen)) >= 1:
                higher, lower = higher + (max(seen) > -min(seen)), lower + (max(seen) <= -min(seen))
        assert forms[i, j] == raster.FORMS[lower][higher]


def test_distances_equal_plain(spark):
    rng = np.random.default_rng(4)
    sites = {(int(i), int(j)) for i, j in zip(rng.integers(0, 20, 12), rng.integers(0, 50, 12))}
    cells = spark.createDataFrame([(i, j, (i, j) in sites) for i in range(20) for j in range(50) if rng.random() > 0.1 or (i, j) in sites], "i int, j int, site boolean")
    for r in raster.distance_transform(cells, 3.0, 2.0).collect():
        want = min(math.hypot(3 * (r["i"] - a), 2 * (r["j"] - b)) for a, b in sites)
        assert r["dist"] == pytest.approx(want) and (r["near_i"], r["near_j"]) in sites
    none = raster.distance_transform(cells.withColumn("site", F.lit(False)), 3.0, 2.0)
    assert none.filter("dist IS NULL AND near_i IS NULL").count() == cells.count()


def test_overlaps_add_up_to_areas(spark):
    rng = np.random.default_rng(5)
    rings = []
    for k in range(30):
        turn, far = np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(1, 9, 9)
        rings.append((k, [(float(20 + f * np.cos(t)), float(-3 + f * np.sin(t))) for t, f in zip(turn, far)]))
    shapes = spark.createDataFrame([*rings, (30, []), (31, None)], "id int, ring array<struct<x:double,y:double>>")
    parts = {r["id"]: r["a"] for r in spatial.grid_overlap(shapes, "id", 0.5, 0.5, 1.7).groupBy("id").agg(F.sum("overlap_area").alias("a")).collect()}
    whole = {r["id"]: r["a"] for r in shapes.filter("id < 30").select("id", spatial.area(F.col("ring")).alias("a")).collect()}
    assert set(parts) == set(whole) and all(parts[k] == pytest.approx(whole[k]) for k in whole)


SHAPES = "g int, shape array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>"


def _inside_rows(spark, shapes, points):
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "p int, x double, y double")
    held = p.crossJoin(shapes).filter(spatial.in_shape(F.col("shape"), F.col("x"), F.col("y")))
    return {(r["g"], r["p"]) for r in held.select("g", "p").collect()}


def test_dissolved_shapes_hold_what_their_polygons_hold(spark):
    rng = np.random.default_rng(11)
    rows, points = [], rng.uniform(-12, 12, (400, 2))
    for k in range(14):
        x, y, far = *rng.uniform(-8, 8, 2), rng.uniform(1, 6)
        rows.append((k % 3 if k % 3 else None, [_star(rng, 9, x, y, far)]))
    square = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]
    rows += [(7, [square, [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]), (7, [square[::-1]]), (8, [square, [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]), (9, [])]
    df = spark.createDataFrame([(g, [(0, n > 0, r) for n, r in enumerate(s)]) for g, s in rows], SHAPES)
    out = overlay.dissolve(df, "g")
    want = {(g, k) for g, s in rows for k, (x, y) in enumerate(points) if s and _odd(s, x, y)}
    assert _inside_rows(spark, out, points) == want
    areas = {r["g"]: r["a"] for r in out.select("g", spatial.shape_area(F.col("shape")).alias("a")).collect()}
    assert areas[7] == 36 and areas[8] == 32 and set(areas) == {None, 1, 2, 7, 8}
    assert out.select(F.explode("shape.ring").alias("r")).filter(F.size("r") < 3).count() == 0


def test_shared_sides_cancel_though_their_corners_differ(spark):
    box = lambda a, b, c, d: [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]
    rows = [(1, [(0, False, r)]) for r in (box(0, 0, 2, 1), box(0, 1, 1, 2), box(1, 1, 2, 3), box(0, 2, 1, 3), box(5, 5, 6, 6))]
    shape = overlay.dissolve(spark.createDataFrame(rows, SHAPES), "g").first()["shape"]
    assert sorted(sorted((p["x"], p["y"]) for p in r["ring"]) for r in shape) == [[(0, 0), (0, 3), (2, 0), (2, 3)], [(5, 5), (5, 6), (6, 5), (6, 6)]]


def test_buffers_hold_what_is_near(spark):
    rng = np.random.default_rng(12)
    shapes = [(k, [_star(rng, 8, *rng.uniform(-8, 8, 2), rng.uniform(2, 6))]) for k in range(5)]
    shapes.append((5, [[(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)], [(-4.0, -4.0), (-4.0, 4.0), (4.0, 4.0), (4.0, -4.0)]]))
    df = spark.createDataFrame([(g, [(0, n > 0, r) for n, r in enumerate(s)]) for g, s in shapes], SHAPES)
    points, radius = rng.uniform(-13, 13, (400, 2)), 1.5
    got = _inside_rows(spark, overlay.buffer(df, "g", radius, quarter=64), points)
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "p int, x double, y double")
    far = p.crossJoin(df).select("g", "p", spatial.distance_to_shape(F.col("shape"), F.col("x"), F.col("y")).alias("d")).collect()
    clear = {(r["g"], r["p"]) for r in far if abs(r["d"] - radius) > 2e-3}
    assert len(clear) > 2390 and got & clear == {(r["g"], r["p"]) for r in far if r["d"] <= radius} & clear
    closed = overlay.buffer(df.filter("g = 5"), "g", 4.5).first()["shape"]
    assert [r["hole"] for r in closed] == [False]  # the hole is filled


def test_unions_of_nothing(spark):
    none = spark.createDataFrame([], SHAPES)
    assert overlay.dissolve(none, "g").count() == 0 and overlay.buffer(none, "g", 1.0).count() == 0
    flat = spark.createDataFrame([(1, None), (2, []), (3, [(0, False, [(1.0, 1.0), (2.0, 2.0)])])], SHAPES)
    assert overlay.dissolve(flat, "g").count() == 0 and overlay.buffer(flat, "g", 1.0).count() == 0


def test_albers_there_and_back(spark):
    rng = np.random.default_rng(13)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(20, 55, 300), rng.uniform(-130, -60, 300))] + [(23.0, -96.0)], "lat double, lon double")
    x, y = physics.albers(F.col("lat"), F.col("lon"))
    lat, lon = physics.albers_inverse(F.col("x"), F.col("y"))
    again = d.select("lat", "lon", x.alias("x"), y.alias("y")).select("*", lat.alias("lat2"), lon.alias("lon2"))
    x2, y2 = physics.albers(F.col("lat2"), F.col("lon2"))
    worst = again.select(F.max(F.hypot(F.col("x") - x2, F.col("y") - y2)), F.max(F.abs(F.col("lat") - F.col("lat2"))), F.max(F.abs(F.col("lon") - F.col("lon2")))).first()
    assert worst[0] < 1e-6 and worst[1] < 1e-11 and worst[2] < 1e-11
    far = spark.createDataFrame([(0.0, 3e7)], "x double, y double").select(*physics.albers_inverse(F.col("x"), F.col("y"))).first()
    assert far[0] is None


def test_warp_of_a_plane_is_exact(spark):
    cells = spark.createDataFrame([(i, j, 3.0 * i - 2.0 * j) for i in range(12) for j in range(9)], "i int, j int, value double")
    template = spark.createDataFrame([(i, j) for i in range(8) for j in range(8)], "i int, j int")
    out = raster.warped(cells, raster.Grid(0, 12, 1, 1), template, raster.Grid(1, 11, 0.9, 1.1), lambda x, y: (x, y), bilinear=True).collect()
    for r in out:
        row, column = 12 - (11 - (r["i"] + 0.5) * 1.1) - 0.5, 1 + (r["j"] + 0.5) * 0.9 - 0.5
        assert r["value"] == pytest.approx(3 * row - 2 * column)
    none = raster.warped(cells, raster.Grid(0, 12, 1, 1), template, raster.Grid(500, 11, 1, 1), lambda x, y: (x, y), bilinear=True)
    assert none.count() == 64 and none.filter("value IS NOT NULL").count() == 0
    assert raster.warped(cells, raster.Grid(0, 12, 1, 1), template.limit(0), raster.Grid(0, 12, 1, 1), lambda x, y: (x, y)).count() == 0


def _plain_tree(bins, g, h, s, widths):
    """Best-first growth with every split of every leaf tried row by row."""
    score = lambda a, b: max(abs(a) - s.l1, 0.0) ** 2 / (b + s.l2)
    value = lambda m: float(-s.rate * np.sign(g[m].sum()) * max(abs(g[m].sum()) - s.l1, 0.0) / (h[m].sum() + s.l2))
    leaves = [(np.ones(len(g), bool), 0)]
    while len(leaves) < s.leaves:
        best = (s.least_gain, None)
        for n, (m, deep) in enumerate(leaves):
            if deep == s.depth:
                continue
            for f, width in enumerate(widths):
                for cut_ in range(1, width):
                    for missing in (False, True):
                        left = m & (((bins[:, f] > 0) & (bins[:, f] <= cut_)) | ((bins[:, f] == 0) & missing))
                        right = m & ~left
                        if min(left.sum(), right.sum()) >= s.least_rows:
                            gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[m].sum(), h[m].sum())
                            if gain > best[0] + 1e-9:
                                best = (gain, n, left, right, deep + 1)
        if best[1] is None:
            break
        _, n, left, right, deep = best
        leaves[n : n + 1] = [(left, deep), (right, deep)]
    out = np.zeros(len(g))
    for m, _ in leaves:
        out[m] = value(m) if len(leaves) > 1 else 0.0
    return out, len(leaves)


def test_leafwise_trees_equal_a_plain_search(spark):
    rng = np.random.default_rng(14)
    n = 160
    bins = np.stack([rng.integers(0, 6, n), rng.integers(1, 5, n), rng.integers(0, 3, n)], 1)
    y, w = bins[:, 0] * 1.5 + np.where(bins[:, 1] > 2, 7, 0) + rng.normal(size=n), rng.uniform(0.5, 2, n)
    rows = spark.createDataFrame([(k, [int(b) for b in bins[k]], float(y[k]), float(w[k]), False) for k in range(n)], "id long, bins array<int>, y double, w double, held boolean")
    for leaves, depth, l1, l2, gain in ((5, 4, 1.0, 10.0, 0.1), (5, 2, 0.0, 1.0, 0.0), (4, 4, 30.0, 5.0, 40.0), (2, 4, 1e9, 1.0, 0.0)):
        s = leafwise.with_settings(rate=0.5, leaves=leaves, depth=depth, least_rows=9, l1=l1, l2=l2, least_gain=gain, rows=1.0, columns=1.0)
        made = leafwise.Booster([False] * 3, [6, 5, 3], s, 1).fit(rows, 3)
        pred = np.full(n, (w * y).sum() / w.sum())
        for tree in made.trees:
            step, count = _plain_tree(bins, (pred - y) * w, w, s, [6, 5, 3])
            assert tree.predict(bins) == pytest.approx(step) and tree.feature.count(-1) == count
            pred += step
        assert len(made.trees) == (3 if l1 < 1e9 else 0)


def test_leafwise_boosting_of_blocks(spark):
    rng = np.random.default_rng(15)
    rows = [(int(k % 12), float(rng.uniform()) if k % 9 else None, ["a", "b", None][k % 3], k) for k in range(600)]
    d = spark.createDataFrame([(b, x, c, (x or 0.5) * 4 + (c == "a") * 2.0) for b, x, c, _ in rows] + [(1, 0.5, "a", None)], "block int, x double, c string, y double")
    make = lambda **k: leafwise.LeafwiseBoosting(["x", "c"], "y", "block", None, ["c"], leafwise.with_settings(rate=0.4, least_rows=5, l2=1.0, least_gain=0.0), rounds=8, folds=3, patience=3, **k)
    one, many = make(threads=1, keep_held_out=True).fit(d), make(threads=3).fit(d)
    assert one.best == many.best and len(one.best) == 3
    first, second = one.predict(d).collect(), many.predict(d).collect()
    assert sorted(r["prediction"] for r in first) == pytest.approx(sorted(r["prediction"] for r in second))
    assert len(first) == 601 and one.held_out.count() == 601
    known = [r for r in first if r["y"] is not None]
    assert np.mean([(r["prediction"] - r["y"]) ** 2 for r in known]) < 0.2 * np.var([r["y"] for r in known])
    unseen = spark.createDataFrame([(1, None, "zz", 0.0)], d.schema)
    assert one.predict(unseen).first()["prediction"] is not None


def test_side_by_side_keeps_order_and_stops_at_a_failure(spark):
    import time

    assert parallel.side_by_side([lambda k=k: spark.range(k).count() for k in (5, 3, 8)], 3) == [5, 3, 8]
    began = time.time()

    def bad():
        raise ValueError("no")

    slow = lambda: spark.range(4).repartition(2).mapInPandas(lambda b: (time.sleep(60), b)[1], "id long").count()
    with pytest.raises(ValueError):
        parallel.side_by_side([slow, bad, slow, slow], 2)
    assert time.time() - began < 50


def _asof(left, right, direction, within=None):
    out = []
    for i, k, t in left:
        near = [(abs(t - u), u, v) for j, u, v in right if j == k and u is not None and (direction == "nearest" or (u <= t if direction == "backward" else u >= t))] if k is not None and t is not None else []
        best = min(near, default=None)
        out.append((i, k, t, best[2] if best and (within is None or best[0] <= within) else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["4", "23"])
def test_nearest_rows_equal_plain(spark, parts):
    rng = np.random.default_rng(16)
    left = [(i, int(k), float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 200), rng.integers(0, 400, 200)))] + [(900, None, 3.0), (901, 2, None), (902, 77, 5.0)]
    #: One key holds most rows, so that it spans parts without a row of the other side.
    left += [(1000 + i, 9, float(1000 + i)) for i in range(300)]
    places = sorted({(int(k), float(t)) for k, t in zip(rng.integers(0, 6, 60), rng.integers(0, 400, 60))}) + [(9, 1001.5), (9, 1250.25)]
    right = [(k, t, i) for i, (k, t) in enumerate(places)] + [(None, 3.0, 99), (3, None, 98)]
    a, b = spark.createDataFrame(left, "i int, k int, t double"), spark.createDataFrame(right, "k int, t double, v int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for direction, within in (("backward", None), ("forward", None), ("nearest", None), ("nearest", 2.5), ("backward", 40.0)):
            got = nearest.nearest_rows(a, b, ["k"], "t", ["v"], direction, within)
            assert sorted(((r["i"], r["k"], r["t"], r["near_v"]) for r in got.collect()), key=repr) == _asof(left, right, direction, within)
        assert nearest.nearest_rows(a, b.limit(0), ["k"], "t", ["v"]).filter("near_v IS NULL").count() == len(left)
        assert nearest.nearest_rows(a.limit(0), b, ["k"], "t", ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_exact_quantiles_of_groups(spark):
    rng = np.random.default_rng(17)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0], 700), "c": np.array([5.0]), "d": np.exp(rng.normal(size=2500) * 40), None: np.arange(100.0), "e": np.array([-1.7e308, 1.7e308, 3.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", float("nan")), ("a", None), ("a", float("inf")), ("z", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    for bins, small in ((1024, 4096), (16, 10), (2, 1)):
        got = {(r["g"], r["share"]): r["value"] for r in stats.exact_quantiles(d.filter("g IS NULL OR g != 'd'") if bins == 2 else d, ["g"], "x", shares, bins, small).collect()}
        for (g, p), v in got.items():
            s, at = np.sort(groups[g]), (len(groups[g]) - 1) * p
            k = int(at)
            assert v == pytest.approx(s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (at - k), rel=1e-12) or abs(s[-1]) > 1e300
        assert len(got) == 5 * (len(groups) - (bins == 2))
    assert stats.exact_quantiles(d, [], "x", [0.5], 8, 10).count() == 1 and stats.exact_quantiles(d.limit(0), ["g"], "x", shares).count() == 0


def test_likelihood_slopes_equal_differences():
    rng = np.random.default_rng(18)
    x, there = rng.gumbel(size=(6, 30)), np.ones((6, 30), bool)
    there[2, 20:] = False
    q = np.array([[0.1, 0.05, xi] for xi in (0.0, 1e-4, 0.1, -0.1, 0.02, -0.003)])
    loss, g, h = stats._gev_terms(x, there, q)
    assert np.isfinite(loss).all()
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-5
        up, down = stats._gev_terms(x, there, q + d), stats._gev_terms(x, there, q - d)
        assert g[:, k] == pytest.approx((up[0] - down[0]) / 2e-5, rel=1e-5, abs=1e-5)
        assert h[:, k] == pytest.approx((up[1] - down[1]) / 2e-5, rel=1e-5, abs=1e-4)


def test_likelihood_of_many_cells(spark):
    import time

    n = 100_000
    cells = spark.range(n * 40).select((F.col("id") / 40).cast("long").alias("cell"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0 + 1e-9).alias("u"))
    xi = F.pmod(F.col("cell"), F.lit(5)) * 0.06 - 0.1
    x = cells.select("cell", (10 + F.when(xi == 0, -F.log(-F.log("u"))).otherwise((F.pow(-F.log("u"), -xi) - 1) / xi)).alias("x")).persist()
    assert x.count() == n * 40
    began = time.time()
    r = stats.gev_likelihood(x, ["cell"], "x", 2.0).agg(F.count("*"), F.count("shape"), F.avg("scale"), F.avg("location")).first()
    took = time.time() - began
    x.unpersist()
    assert r[0] == n and r[1] > 0.99 * n and abs(r[2] - 1) < 0.05 and abs(r[3] - 10) < 0.05
    assert took < 30 * max(1.0, _slowness())


def _slowness():
    """How much slower than usual this machine is just now."""
    import time

    began = time.thread_time()
    sum(range(2_000_000))
    return (time.thread_time() - began) / 0.04


def test_crowded_cells_are_parted(spark):
    rng = np.random.default_rng(19)
    near = rng.uniform(0, 1, (60, 2)) * 3  # many small shapes in one corner, few large ones elsewhere
    shapes = [(k, _star(rng, 20, x, y, 0.2)) for k, (x, y) in enumerate(near)] + [(100 + k, _star(rng, 9, *rng.uniform(0, 200, 2), 60)) for k in range(4)]
    g = spark.createDataFrame(shapes, "id int, ring array<struct<x:double,y:double>>")
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate([*rng.uniform(0, 3, (150, 2)), *rng.uniform(-20, 200, (100, 2))])]
    p = spark.createDataFrame(points, "p int, x double, y double")
    plain = {r["p"]: r["id_values"] for r in spatial.overlapping(p, g, "p", "id", "x", "y", 64.0).collect()}
    fine = {r["p"]: r["id_values"] for r in spatial.overlapping(p, g, "p", "id", "x", "y", 64.0, dense=100).collect()}
    assert fine == plain == {i: [k for k, s in shapes if _odd([s], x, y)] or None for i, x, y in points}
    most = lambda dense: spatial._indexed(p, g, "id", "x", "y", 64.0, dense)[1].groupBy("_lv", "_tx", "_ty").agg(F.sum(F.size("sides")).alias("n")).agg(F.max("n")).first()[0]
    assert most(None) > 1000 and most(100) <= 300


def test_numbers_of_sorted_rows(spark):
    d = spark.createDataFrame([(k % 37, k) for k in range(200)] + [(None, 500)], "a int, b int").repartition(5)
    got = timeseries.numbered(d, ["a", "b"], "n", 7).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 202)) and [(r["a"], r["b"]) for r in got[1:]] == sorted((k % 37, k) for k in range(200)) and got[0]["a"] is None
    assert timeseries.numbered(d.limit(0), ["a"], "n").count() == 0


def test_grid_over_no_points(spark):
    assert spatial.grid_over(spark.createDataFrame([(None, 1.0)], "x double, y double"), "x", "y", 1.0).count() == 0
