"""Unions of polygons: dissolving by a column, and buffers.

All outlines of a group are cut where they meet, and sides that two of them share in opposite senses cancel by grouping
on the undirected side. The rest has a winding number on either hand: how many polygons are there. Sides with
some on one hand and none on the other bound the union; each is followed by the next one at its end, and pointer doubling
turns them into rings.

Where many polygons lie one over the other, neighbours along a curve that fills the plane are united first, so many at a time, then
those unions, until few lie over a place: outlines that others cover are gone before they are cut by all of these.

Coordinates lie on a lattice of ``step`` metres, so that crossings meet exactly; sides that come nearer to a
corner than that are cut there, again and again until none does. A union's corners are so right to a few steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut
from .spatial import _edges, _signed, bounds
from .tiling import with_shape
from .timeseries import numbered

#: Lattice in metres.
STEP = 1e-4
#: Sides of an arc in a quarter of a circle.
QUARTER = 16
#: A side is cut at a corner that comes nearer than so many steps.
NEAR = 0.75
#: Polygons that are united at a time where more than that lie over a place.
FAN = 16


def _group(by: str) -> Column:
    """A group's name as a struct, which a null value doesn't keep from joins."""
    return F.struct(F.col(by).alias("name")).alias("g")


def _directed(polygons: DataFrame, by: str) -> DataFrame:
    """g, piece, ring of all rings, piece being the polygon: parts run counterclockwise, holes clockwise, so that the inside is on the left."""
    #: The number comes first: beside explode() in one select it would be the ring's.
    named = with_shape(polygons).select(_group(by), F.monotonically_increasing_id().alias("piece"), "shape")
    rings = named.select("g", "piece", F.explode("shape").alias("r")).repartition("g", "piece")
    wrong = (_signed(F.col("r.ring")) > 0) == F.col("r.hole")
    return rings.select("g", "piece", F.when(wrong, F.reverse("r.ring")).otherwise(F.col("r.ring")).alias("ring"))


def _neighbours(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the corners before and after each one of rings that lie one behind the other."""
    ends, at = np.cumsum(sizes), np.arange(len(x))
    before, after, some = at - 1, at + 1, sizes > 0
    before[(ends - sizes)[some]], after[ends[some] - 1] = ends[some] - 1, (ends - sizes)[some]
    return before, after


def _on_lattice(rings: DataFrame, step: float) -> DataFrame:
    """rings in whole steps, without repeated corners, and whether one is convex, which makes it its own union and costs it the corners
    on straight lines."""
    kind = dict(rings.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype("int64")
            x, y = (np.sign(v) * np.floor(abs(v) / step + 0.5) for v in (c.to_numpy(zero_copy_only=False).astype(float) for c in b.column(2).flatten().flatten()))
            of, (before, _) = np.repeat(np.arange(len(sizes)), sizes), _neighbours(x, sizes)
            new = (x != x[before]) | (y != y[before])
            x, y, of = x[new], y[new], of[new]
            sizes = np.bincount(of, minlength=len(sizes))
            before, after = _neighbours(x, sizes)
            dx, dy, ex, ey = x - x[before], y - y[before], x[after] - x, y[after] - y
            turn, on = dx * ey - dy * ex, dx * ex + dy * ey
            bad = np.bincount(of, ~((turn > 0) | ((turn == 0) & (on > 0))), len(sizes))
            once = np.bincount(of, np.arctan2(turn, on), len(sizes)) < 2 * np.pi + 0.1
            convex = (bad == 0) & once & (sizes > 2)
            kept = (turn != 0) | ~convex[of]
            x, y, sizes = x[kept], y[kept], np.bincount(of[kept], minlength=len(sizes))
            corners = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), "int32"), corners)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(convex)], ["g", "piece", "ring", "convex"])

    return rings.select("g", "piece", "ring").mapInArrow(run, f"g {kind}, piece long, ring array<struct<x:double,y:double>>, convex boolean")


def _net(s: DataFrame) -> DataFrame:
    """Undirected sides, from the lesser corner, and m, how often they are passed that way less how often the other way."""
    swap = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for a, b, n in (("ax", "bx", "ax"), ("ay", "by", "ay"), ("bx", "ax", "bx"), ("by", "ay", "by"))]
    m = F.when(swap, -F.col("m")).otherwise(F.col("m"))
    return s.select("g", *ends, m.alias("m")).groupBy("g", "ax", "ay", "bx", "by").agg(F.sum("m").alias("m")).filter("m != 0")


def _cells(s: DataFrame, size: float) -> DataFrame:
    """Sides once for each cell that they pass, by pieces no longer than a cell."""
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / size)).cast("int")
    s = s.withColumn("_n", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda c, k: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * k / F.col("_n")
    for c in "xy":
        u, v = at(c, F.col("_k")), at(c, F.col("_k") + 1)
        low, high = F.floor((F.least(u, v) - 2) / size).cast("long"), F.floor((F.greatest(u, v) + 2) / size).cast("long")
        s = s.withColumn(f"_t{c}", F.explode(F.sequence(low, high)))
    return s.drop("_n", "_k").distinct()


def _cuts(s: DataFrame, size: float) -> DataFrame:
    """id, px, py: where sides (id, ...) have to be cut, which is where they cross others and where others' corners lie."""
    t = _cells(s.select("id", "g", "ax", "ay", "bx", "by"), size)
    u = t.select("g", "_tx", "_ty", *[F.col(c).alias(f"o_{c}") for c in ("id", "ax", "ay", "bx", "by")])
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by", "o_ax", "o_ay", "o_bx", "o_by")}
    bounds = F.lit(True)
    for k in "xy":
        bounds = bounds & (F.greatest(c[f"a{k}"], c[f"b{k}"]) + 1 >= F.least(c[f"o_a{k}"], c[f"o_b{k}"])) & (F.greatest(c[f"o_a{k}"], c[f"o_b{k}"]) + 1 >= F.least(c[f"a{k}"], c[f"b{k}"]))
    pairs = t.join(u, ["g", "_tx", "_ty"]).filter(bounds & (F.col("id") < F.col("o_id")))
    dx, dy, ex, ey = c["bx"] - c["ax"], c["by"] - c["ay"], c["o_bx"] - c["o_ax"], c["o_by"] - c["o_ay"]
    turn = dx * ey - dy * ex
    along = F.try_divide((c["o_ax"] - c["ax"]) * ey - (c["o_ay"] - c["ay"]) * ex, turn)
    other = F.try_divide((c["o_ax"] - c["ax"]) * dy - (c["o_ay"] - c["ay"]) * dx, turn)
    meet = along.between(0, 1) & other.between(0, 1)
    point = lambda i, x, y: F.struct(i.alias("id"), x.alias("px"), y.alias("py"))
    px, py = F.round(c["ax"] + along * dx), F.round(c["ay"] + along * dy)
    here, there = F.col("id"), F.col("o_id")
    found = [F.when(meet, point(i, px, py)) for i in (here, there)]
    for i, a, b, ends in ((here, ("ax", "ay"), ("bx", "by"), ("o_ax", "o_ay", "o_bx", "o_by")), (there, ("o_ax", "o_ay"), ("o_bx", "o_by"), ("ax", "ay", "bx", "by"))):
        for x, y in (ends[:2], ends[2:]):
            vx, vy, wx, wy = c[b[0]] - c[a[0]], c[b[1]] - c[a[1]], c[x] - c[a[0]], c[y] - c[a[1]]
            square, dot = vx * vx + vy * vy, vx * wx + vy * wy
            close = (F.abs(vx * wy - vy * wx) <= NEAR * F.sqrt(square)) & (dot > 0) & (dot < square)
            found.append(F.when(close, point(i, c[x], c[y])))
    cuts = pairs.select(F.explode(F.array(*found)).alias("c")).filter("c IS NOT NULL").select("c.*").distinct()
    whole = s.select("id", "ax", "ay", "bx", "by")
    return cuts.join(whole, "id").filter("NOT (px = ax AND py = ay) AND NOT (px = bx AND py = by)").select("id", "px", "py")


def _noded(s: DataFrame, size: float) -> DataFrame:
    """Undirected sides that meet at corners only."""
    s = cut(_net(s).select(F.monotonically_increasing_id().alias("id"), "*"))
    while True:
        cuts = cut(_cuts(s, size))
        if cuts.isEmpty():
            return s
        along = (F.col("px") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("py") - F.col("ay")) * (F.col("by") - F.col("ay"))
        points = cuts.join(s, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(along.alias("t"), "px", "py"))).alias("c"))
        corner = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
        inner = F.transform("c", lambda p: F.struct(p["px"].alias("x"), p["py"].alias("y")))
        path = F.concat(corner("ax", "ay"), F.coalesce(inner, F.array().cast("array<struct<x:double,y:double>>")), corner("bx", "by"))
        paths = s.join(points, "id", "left").select("g", "m", path.alias("p"))
        steps = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda k: F.struct(F.get("p", k).alias("a"), F.get("p", k + 1).alias("b")))
        e = paths.select("g", "m", F.explode(steps).alias("e")).select("g", "m", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
        s = cut(_net(e.filter("ax != bx OR ay != by")).select(F.monotonically_increasing_id().alias("id"), "*"))


def _bounding(s: DataFrame) -> DataFrame:
    """g, ax, ay, bx, by of the sides with polygons on one hand only, those on the left.

    A ray from a side's middle counts, with their senses, the sides to the right that it crosses, in bands of a group's
    height: about as many as the root of its number of sides. Just right of the middle are so many polygons, and across
    the side so many more or fewer as it is passed."""
    ends = s.groupBy("g").agg(F.min(F.least("ay", "by")).alias("_low"), (F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("_tall"), F.ceil(F.sqrt(F.count("*"))).alias("_bands"))
    s = s.join(ends.withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")))
    band = lambda y: F.floor((y - F.col("_low")) * F.col("_bands") / F.greatest(F.col("_tall"), F.lit(1.0))).cast("long")
    middle_x, middle_y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    asked = s.select("id", F.xxhash64("g").alias("h"), "g", middle_x.alias("x"), middle_y.alias("y"), band(middle_y).alias("band"))
    wall = s.filter("ay != by").select(F.xxhash64("g").alias("h"), F.col("g").alias("o_g"), F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in ("ax", "ay", "bx", "by", "m")],
        F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))).alias("band"))
    beyond = F.col("x") < F.col("o_ax") + (F.col("y") - F.col("o_ay")) * (F.col("o_bx") - F.col("o_ax")) / (F.col("o_by") - F.col("o_ay"))
    crossed = asked.join(wall, ["h", "band"]).filter(((F.col("o_ay") > F.col("y")) != (F.col("o_by") > F.col("y"))) & beyond & (F.col("id") != F.col("o_id")) & (F.col("g") == F.col("o_g")))
    winding = crossed.groupBy("id").agg(F.sum(F.when(F.col("o_by") > F.col("o_ay"), F.col("o_m")).otherwise(-F.col("o_m"))).alias("w"))
    both = s.join(winding, "id", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    #: Level sides have above, their left, what the ray counts; others have their right hand there if they rise.
    left = F.when(F.col("by") > F.col("ay"), F.col("w") + F.col("m")).otherwise(F.col("w"))
    both = both.withColumn("_l", left > 0).withColumn("_r", left - F.col("m") > 0).filter("_l != _r")
    return both.select("g", *[F.when(F.col("_l"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])


def _rings(edges: DataFrame) -> DataFrame:
    """g, ring: closed paths along directed sides. Where several sides leave a corner, the leftmost follows."""
    e = cut(edges.select(F.monotonically_increasing_id().alias("id"), "*"))
    f = e.select(F.col("id").alias("next"), F.col("g").alias("_g"), F.col("ax").alias("_x"), F.col("ay").alias("_y"), F.col("bx").alias("_bx"), F.col("by").alias("_by"))
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("_bx") - F.col("_x"), F.col("_by") - F.col("_y")
    turn = F.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    after = e.join(f, (F.col("g") == F.col("_g")) & (F.col("bx") == F.col("_x")) & (F.col("by") == F.col("_y")))
    after = cut(after.groupBy("id").agg(F.max_by("next", F.struct(turn, "next")).alias("next")))
    n, ahead = e.count(), after.agg(F.count("*"), F.count_distinct("next")).first()
    if tuple(ahead) != (n, n):
        raise ValueError("an outline doesn't close; take a longer step")
    #: low: the least id among the sides that follow, and how far off it is.
    state, away, changed = after.select("id", "next", F.col("id").alias("low"), F.lit(0).cast("long").alias("off")), 1, True
    while changed:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"), (F.col("off") + away).alias("_off"))
        lower = F.col("_low") < F.col("low")
        state = cut(state.join(ahead, "next").select("id", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), F.when(lower, F.col("_off")).otherwise(F.col("off")).alias("off"), lower.alias("_new")))
        away, changed = 2 * away, not state.filter("_new").isEmpty()
    placed = e.join(state.select("id", "low", "off"), "id")
    order = F.struct(F.when(F.col("off") == 0, F.lit(None)).otherwise(-F.col("off")).alias("k"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    rings = placed.groupBy("low").agg(F.first("g").alias("g"), F.sort_array(F.collect_list(order)).alias("ring"))
    return rings.select("g", F.col("low").alias("id"), _straightened(F.col("ring")).alias("ring"))


def _straightened(ring: Column) -> Column:
    """A ring less the corners at which it goes straight on."""
    n = F.size(ring)

    def turns(p: Column, k: Column) -> Column:
        a, b = F.get(ring, F.pmod(k - 1, n)), F.get(ring, F.pmod(k + 1, n))
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])

    return F.transform(F.filter(ring, turns), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def _shaped(rings: DataFrame, by: str, step: float) -> DataFrame:
    """by and shape of rings (g, id, ring) in steps."""
    scaled = F.transform("ring", lambda p: F.struct((p["x"] * step).alias("x"), (p["y"] * step).alias("y")))
    flat = rings.select("g", "id", (_signed(F.col("ring")) < 0).alias("hole"), scaled.alias("ring"))
    one = F.struct("hole", "id", F.lit(None).cast("int").alias("part"), "ring")
    shapes = flat.groupBy("g").agg(F.sort_array(F.collect_list(one)).alias("s"))
    return shapes.select(F.col("g.name").alias(by), F.transform("s", lambda r: F.struct(r["part"].alias("part"), r["hole"].alias("hole"), r["ring"].alias("ring"))).alias("shape"))


def _united(rings: DataFrame, by: str, step: float) -> DataFrame:
    """by and shape: the union of what rings (g, piece, ring) wind around. A convex ring that has a group to itself is that
    group's union; only the others are cut and followed."""
    rings = cut(_on_lattice(rings, step))
    alone = rings.groupBy("g").agg(F.count("*").alias("n")).filter("n = 1").select("g")
    ready = rings.filter("convex").join(alone, "g", "left_semi")
    done = _shaped(ready.select("g", F.lit(0).cast("long").alias("id"), "ring"), by, step)
    rest = rings.join(ready.select("g"), "g", "left_anti")
    sides = rest.select("g", "piece", F.explode(_edges(F.col("ring"))).alias("e"))
    s = cut(sides.select("g", "piece", *[F.col(f"e.{c}").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), ("ax", "ay", "bx", "by"))]))
    if s.isEmpty():
        return done
    depth = _depth(rest)
    if depth > FAN:
        s = s.join(_along_curve(rest), "piece")
    while depth > FAN:
        batch = s.select(F.struct("g", F.floor(F.col("n") / FAN).alias("n")).alias("g"), "ax", "ay", "bx", "by")
        s, depth = cut(_bounds_of(batch)).select("g.g", "g.n", "ax", "ay", "bx", "by"), depth / FAN
    return done.unionByName(_shaped(_rings(_bounds_of(s)), by, step))


def _depth(rings: DataFrame) -> float:
    """How many rings lie over a place of their group's bounds, by their bounds' areas; the largest of all groups."""
    box = rings.select("g", *bounds(F.col("ring")))
    covered = F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    whole = (F.max("xmax") - F.min("xmin")) * (F.max("ymax") - F.min("ymin"))
    of = box.groupBy("g").agg(F.try_divide(covered, whole).alias("d"))
    return of.agg(F.max("d")).first()[0] or 0.0


def _along_curve(rings: DataFrame) -> DataFrame:
    """piece and n: numbers of the pieces along a Z-order curve over their lower left corners, group by group."""
    d = rings.select("g", "piece", *bounds(F.col("ring"))).groupBy("g", "piece").agg(F.min("xmin").alias("x"), F.min("ymin").alias("y"))
    x0, y0, x1, y1 = d.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    scale = max(x1 - x0, y1 - y0, 1.0) / ((1 << 31) - 1)

    def spread(v: Column) -> Column:
        """Bits of a number with a free one between each two."""
        for k, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, k)).bitwiseAND(F.lit(mask))
        return v

    x, y = (spread(F.floor((F.col(c) - low) / scale).cast("long")) for c, low in (("x", x0), ("y", y0)))
    placed = d.select(F.xxhash64("g").alias("h"), x.bitwiseOR(F.shiftleft(y, 1)).alias("z"), "piece")
    return numbered(placed, ["h", "z"], "n").select("piece", "n")


def _bounds_of(s: DataFrame) -> DataFrame:
    """The directed sides that bound each group's union."""
    s = s.withColumn("m", F.lit(1).cast("long"))
    length = s.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
    return _bounding(_noded(s, max(8.0, 2 * length)))


def dissolve(polygons: DataFrame, by: str, step: float = STEP) -> DataFrame:
    """by and shape: the union of the polygons (shape or ring) that share a value of by, null being one. Polygons may
    share sides, touch or overlap. Parts come before holes, each ring without corners on straight lines; part is null, as
    parts aren't told apart. Values of by whose polygons have no area give no rows."""
    return _united(_directed(polygons, by), by, step)


def _offset(ring: np.ndarray, radius: float, quarter: int) -> np.ndarray:
    """Sides of a ring (inside on its left) moved out by radius, joined by arcs at corners that stick out and by way of the
    corner itself at others."""
    d = np.roll(ring, -1, 0) - ring
    ring = ring[(d != 0).any(1)]
    if len(ring) < 3:
        return ring[:0]
    d = np.roll(ring, -1, 0) - ring
    out = np.stack([d[:, 1], -d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None] * radius
    before = np.roll(out, 1, 0)
    turn = np.arctan2(before[:, 0] * out[:, 1] - before[:, 1] * out[:, 0], (before * out).sum(1))
    steps = np.where(turn > 0, np.ceil(turn / (np.pi / 2 / quarter) - 1e-9), 2).astype("int64")
    corner = np.repeat(np.arange(len(ring)), steps + 1)
    k = np.arange(len(corner)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    angle = np.arctan2(before[corner, 1], before[corner, 0]) + turn[corner] * k / steps[corner]
    arc = np.stack([np.cos(angle), np.sin(angle)], 1) * radius
    bent = np.where((k == 0)[:, None], before[corner], np.where((k == 2)[:, None], out[corner], 0.0))
    return ring[corner] + np.where((turn > 0)[corner][:, None], arc, bent)


def buffer(polygons: DataFrame, key: str, radius: float, quarter: int = QUARTER, step: float = STEP) -> DataFrame:
    """key and shape: what lies within radius, above 0, of each polygon, those that share a key being one. Arcs have quarter
    sides in a quarter circle, with their corners on the circle. Parts and holes as in dissolve()."""
    rings = _directed(polygons, key).filter(_signed(F.col("ring")) != 0)
    kind = dict(polygons.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (c.to_numpy(zero_copy_only=False) for c in b.column(2).flatten().flatten())
                ends = np.cumsum([0, *b.column(2).value_lengths().to_pylist()])
                moved = [_offset(np.stack([x[i:j], y[i:j]], 1), radius, quarter) for i, j in zip(ends[:-1], ends[1:])]
                sizes, flat = np.cumsum([0, *map(len, moved)]), np.concatenate(moved)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(sizes, "int32"), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))], ["g", "piece", "ring"])

    return _united(rings.mapInArrow(run, f"g struct<name:{kind}>, piece long, ring array<struct<x:double,y:double>>"), key, step)
