"""Small cases that failed before a finding was mended."""

import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from siteflux.operators import leafwise, matching, nearest, overlay, sampling, spatial, stats, tiling
from siteflux.plans.catalogue import ORACLES, QUERIES


def test_lone_convex_shapes_are_never_cut(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("a convex shape by itself needs no cuts")

    monkeypatch.setattr(overlay, "_noded", fail)
    n = F.col("id").cast("double")
    boxes = spark.range(50).select("id", spatial.box(n * 3, n, n * 3 + 10, n + 5).alias("ring"))
    area = F.round(spatial.shape_area(F.col("shape")), 6)
    assert {r[0] for r in overlay.dissolve(boxes, "id").select(area).collect()} == {50.0}
    want = round(50 + 30 * 2 + 32 * 2 * 2 * math.sin(math.pi / 32), 6)
    got = overlay.buffer(boxes, "id", 2.0, step=1e-9).select(area).collect()
    assert len(got) == 50 and all(abs(r[0] - want) < 1e-5 for r in got)


def test_buffered_mask_holds_points_between_the_corners_of_arcs(spark, tmp_path):
    con, rows = duckdb.connect(), []
    for k in range(-12, 13):
        tenth = -10 + k
        rows.append((10 * len(rows) + tenth % 10, -1500 - math.sqrt(1.69 - (k / 10) ** 2) + 4e-6, tenth // 10))
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["buffered_mask"]).fetchall())
    assert len(want) == 25 and sorted(tuple(r) for r in QUERIES["buffered_mask"](spark, str(tmp_path)).collect()) == want


def test_draws_sort_few_rows_and_stay_the_same(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("item"))
    counts = spark.createDataFrame([("0", 3, 4), ("1", 0, 2), ("2", 9000, 0), ("9", 1, 1)], "k string, num_presence int, num_absence int")
    drawn = sampling.assign(counts, rows, "k", "item", 2, 5)
    got = sorted(tuple(r) for r in drawn.collect())
    plain = {}
    for r in (1, 2):
        for k, p, a in (("0", 3, 4), ("1", 0, 2), ("2", 9000, 0)):
            order = sorted((hashlib.md5(f"5|{r}|{k}|{i}".encode()).hexdigest(), i) for i in range(20_000) if str(i % 3) == k)
            plain |= {(r, k, i): int(n < p) for n, (_, i) in enumerate(order[: p + a])}
    assert got == sorted((*k, v) for k, v in plain.items())
    #: Where the share that is let through is too small, the groups that miss rows are drawn from all of theirs.
    monkeypatch.setattr(sampling, "_share", lambda n, of: F.lit(1e-4))
    assert sorted(tuple(r) for r in sampling.assign(counts, rows, "k", "item", 2, 5).collect()) == got
    kept = []
    monkeypatch.undo()
    monkeypatch.setattr(sampling, "cut", lambda df, real=sampling.cut: kept.append(real(df)) or kept[-1])
    sampling.assign(counts.filter("k < '2'"), rows, "k", "item", 2, 5)
    assert 0 < max(k.count() for k in kept) < 1000


def test_quantiles_of_huge_groups_need_no_sort_by_group(spark, monkeypatch):
    d = spark.range(30_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 30_000).cast("double").alias("x"))
    known = d.select(F.struct("g").alias("g"), "x")
    state = spark.createDataFrame([((g,), 0.0, 30_000.0, n) for g, n in ((0, 15_000), (1, 5))], "g struct<g:long>, lo double, hi double, n long")
    held = stats._inside(known, state)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and held.count() == 30_000
    monkeypatch.setattr(stats, "BROADCAST", 1)
    monkeypatch.setattr(stats, "WIDE", 1000)
    assert stats._inside(known, state).count() == 30_000
    got = {(r["g"], r["share"]): r["value"] for r in stats.exact_quantiles(d, ["g"], "x", [0.0, 0.5, 1.0], 8, 10).collect()}
    assert got == {(0, 0.0): 0, (0, 0.5): 14_999, (0, 1.0): 29_998, (1, 0.0): 1, (1, 0.5): 15_000, (1, 1.0): 29_999}


def test_places_that_many_rows_share_ask_once(spark):
    rows = [(k, float(k % 3), 0.0, None if k < 3000 else float(k)) for k in range(6000)] + [(9000, 1000.0, -0.0, None), (9001, None, 0.0, None)]
    d = spark.createDataFrame(rows, "k long, x double, y double, v double")
    out = {r["k"]: r["v"] for r in spatial.impute_nearest(d, "k", "x", "y", ["v"], 500.0).collect()}
    assert out == {k: float(k) if 3000 <= k < 6000 else 3000.0 + k % 3 if k < 6000 else 3002.0 if k == 9000 else None for k, *_ in rows}


def test_both_neighbours_take_two_walks(spark, monkeypatch):
    walks = []
    monkeypatch.setattr(nearest, "_filled", lambda *a, real=nearest._filled: walks.append(1) or real(*a))
    e = spark.createDataFrame([(1, 1, 10), (2, 1, 14), (3, 1, 30), (4, 2, 5), (5, None, 5)], "id int, k int, t long")
    p = spark.createDataFrame([(1, 11, 100), (1, 18, 101), (1, 10, 102)], "k int, t long, b int")
    out = {r["id"]: (r["before_b"], r["after_b"], r["near_b"], r["near_t"]) for r in nearest.nearest_rows(e, p, ["k"], "t", ["b"], "both").collect()}
    assert out == {1: (102, 102, 102, 10), 2: (100, 101, 100, 11), 3: (101, None, 101, 18), 4: (None,) * 4, 5: (None,) * 4} and len(walks) == 2


def test_pairs_of_a_hot_polygon_are_dealt_out(spark, tmp_path):
    n = F.col("id")
    spark.range(3000).coalesce(1).select(n.alias("c_custkey"), F.lit(7).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).coalesce(1).select(n.alias("s_suppkey"), F.lit(7).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = QUERIES["candidate_expansion"](spark, str(tmp_path))
        of = pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("record") * 3000 + F.col("candidate")).alias("s")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = 3000 * 3000
    assert sum(r["n"] for r in of) == whole and sum(r["s"] for r in of) == whole * (whole - 1) // 2 and max(r["n"] for r in of) < whole
    small = matching.blocked_join(*[spark.range(40).select((n % 3).alias("k"), n.alias(c)) for c in "ab"], ["k"], "a", "b", 4)
    assert sorted((r["a"], r["b"]) for r in small.collect()) == [(a, b) for a in range(40) for b in range(40) if a % 3 == b % 3]


def test_boxes_are_compared_by_bounds_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    corners = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    boxes = [(k, *map(float, (*rng.integers(-40, 40, 2), *rng.integers(0, 9, 2) * 20 ** (k % 40 == 0)))) for k in range(300)]
    rings = [(k, corners(*b)[:: 1 if k % 2 else -1] + corners(*b)[:1][: k % 3 == 1 and k % 2]) for k, *b in boxes] + [(500, None), (None, corners(0.0, 0.0, 5.0, 5.0))]
    df = spark.createDataFrame(rings, "id long, ring array<struct<x:double,y:double>>")
    far = spark.createDataFrame([(900, corners(1e6, 1e6, 1.0, 1.0))], "id long, ring array<struct<x:double,y:double>>")
    meet = lambda a, b: a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]
    want = {k: [m for m, *c in boxes if meet(b, c)] for k, *b in boxes} | {500: None, 900: None, None: None}
    other = df.withColumnRenamed("id", "o")
    by_sides = {r["id"]: r["o_values"] for r in spatial._met(df, other, "id", "o", 7.0).groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("o_values")).collect()}
    real = spatial._met
    monkeypatch.setattr(spatial, "_met", lambda l, r, *a: real(l, r, *a) if l.isEmpty() or r.isEmpty() or l.count() == 1 or r.count() == 1 else 1 / 0)  # only the row without a ring
    monkeypatch.setattr(spatial, "BLOCK", 16)
    out = spatial.polygon_lists(df.unionByName(far).unionByName(df.filter("id = 7")), other, "id", "o", 7.0).collect()
    assert len(out) == 304 and {r["id"]: r["o_values"] for r in out} == want
    assert by_sides | {500: None, 900: None, None: None} == want


def test_deep_piles_are_united_in_batches_first(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(None if k % 3 else "a", *map(int, (*rng.integers(0, 25, 2), *rng.integers(4, 12, 2)))) for k in range(90)]
    kept = []
    monkeypatch.setattr(overlay, "_noded", lambda *a, real=overlay._noded: kept.append(real(*a)) or kept[-1])
    monkeypatch.setattr(overlay, "FAN", 3, raising=False)
    c = {n: F.col(n).cast("double") for n in ("x", "y", "w", "h")}
    box = lambda m: spatial.box(c["x"] + m, c["y"] + m, c["x"] + c["w"] - m, c["y"] + c["h"] - m)
    df = spark.createDataFrame(rows, "g string, x int, y int, w int, h int").select("g", tiling.polygon(box(0), box(1)).alias("shape"))
    got = {r["g"]: r["a"] for r in overlay.dissolve(df, "g", 1.0).select("g", spatial.shape_area(F.col("shape")).alias("a")).collect()}
    for g in (None, "a"):
        on = np.zeros((40, 40), bool)
        for name, x, y, w, h in rows:
            if name == g:
                rim = np.ones((w, h), bool)
                rim[1:-1, 1:-1] = False
                on[x : x + w, y : y + h] |= rim
        assert got[g] == on.sum()
    assert len(kept) > 1


def test_boosting_rows_are_packed_by_cells(spark):
    n = F.col("id")
    rows = spark.range(0, 1000, 1, 1).select("id", F.array((n % 5).cast("int"), (n % 3).cast("int")).alias("bins"), n.cast("double").alias("y"), F.lit(2.0).alias("w"), (n % 2).cast("int").alias("fold"))
    blocks = leafwise.packed(rows, [5, 3]).collect()
    assert len(blocks) == 1
    cells, at, ids = (np.frombuffer(blocks[0][c], k) for c, k in (("cells", "int32"), ("at", "int32"), ("id", "int64")))
    assert len(cells) == 15 * 2 and [tuple(c) for c in cells.reshape(-1, 2)[at]] == [(k % 5, k % 3) for k in ids] and sorted(ids) == list(range(1000))
    assert leafwise.fold_sums(leafwise.packed(rows, [5, 3])) == {0: (2.0 * 249_500, 1000.0), 1: (2.0 * 250_000, 1000.0)}
