"""Polygons cut at the cells of a square grid, a batch of them at a time.

A shape is an array of rings with part and hole flags; points are inside by even-odd over all of its rings. An outline
is halved along a grid line again and again until each piece lies in one cell, so its cost is its
length and the cells that it covers, not one times the other. Rings with a coordinate that isn't finite are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>"
SIDES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
#: Cells are widened by this share for clipping, as a point's cell is a rounded quotient.
SLACK = 1e-6


def polygon(ring: Column, *holes: Column) -> Column:
    """A shape of one part."""
    kind = SHAPE.removeprefix("array<").removesuffix(">")
    return F.array(*[F.struct(F.lit(0).alias("part"), F.lit(k > 0).alias("hole"), r.alias("ring")).cast(kind) for k, r in enumerate((ring, *holes))])


def with_shape(polygons: DataFrame) -> DataFrame:
    """polygons with a column shape; a table that has a column ring instead has shapes of one ring."""
    return polygons if "shape" in polygons.columns else polygons.withColumn("shape", polygon(F.col("ring")))


def halved(x: np.ndarray, y: np.ndarray, ends: np.ndarray, level: np.ndarray, across: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of each ring on one side of its line: at level on the x axis where across is true, else on the y
    axis; above it for sign 1, below for -1. Rings lie one behind the other between successive ends."""
    sizes = np.diff(ends)
    of, before, some = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - 1, sizes > 0
    before[ends[:-1][some]] = ends[1:][some] - 1
    b = sign * (np.where(across[of], x, y) - level[of])
    a = b[before]
    stays, crosses = b >= 0, (a >= 0) != (b >= 0)
    t = a / np.where(crosses, a - b, 1.0)
    keep = np.stack([crosses, stays], 1).ravel()
    x, y = (np.stack([c[before] + t * (c - c[before]), c], 1).ravel()[keep] for c in (x, y))
    return x, y, np.concatenate([[0], np.cumsum(np.bincount(of, crosses.astype(int) + stays, len(sizes)))]).astype("int64")


def picked(x: np.ndarray, y: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rings that mask marks."""
    sizes = np.diff(ends)
    keep = np.repeat(mask, sizes)
    return x[keep], y[keep], np.concatenate([[0], np.cumsum(sizes[mask])]).astype("int64")


def celled(x: np.ndarray, y: np.ndarray, ends: np.ndarray, tile: float, x0: float, y0: float, slack: float) -> tuple[np.ndarray, ...]:
    """number of the ring, column, row, and the pieces x, y, ends: each ring in each cell that it meets."""
    rows: list[tuple[np.ndarray, ...]] = []
    good = np.diff(ends) > 2
    good[np.searchsorted(ends, np.flatnonzero(~(np.isfinite(x) & np.isfinite(y))), "right") - 1] = False
    owner = np.flatnonzero(good)
    x, y, ends = picked(x, y, ends, good)
    far = np.iinfo("int64").max
    limits = [np.full(len(owner), v) for v in (-far, far, -far, far)]
    while len(owner):
        c0, c1, r0, r1 = (
            f(limit, np.floor((g.reduceat(c, ends[:-1]) - o) / tile).astype("int64"))
            for limit, f, g, c, o in zip(limits, (np.maximum, np.minimum) * 2, (np.minimum, np.maximum) * 2, (x, x, y, y), (x0, x0, y0, y0))
        )
        one = (c0 >= c1) & (r0 >= r1)
        if one.any():
            px, py, pe = picked(x, y, ends, one)
            rows.append((owner[one], c0[one], r0[one], px, py, np.diff(pe)))
        x, y, ends = picked(x, y, ends, ~one)
        owner, c0, c1, r0, r1 = (v[~one] for v in (owner, c0, c1, r0, r1))
        if not len(owner):
            break
        across = c1 - c0 >= r1 - r0
        middle = np.where(across, c0 + (c1 - c0) // 2, r0 + (r1 - r0) // 2)
        level = np.where(across, x0, y0) + (middle + 1) * tile
        below, above = halved(x, y, ends, level + slack, across, -1.0), halved(x, y, ends, level - slack, across, 1.0)
        limits = [
            np.concatenate([c0, np.where(across, middle + 1, c0)]), np.concatenate([np.where(across, middle, c1), c1]),
            np.concatenate([r0, np.where(across, r0, middle + 1)]), np.concatenate([np.where(across, r1, middle), r1]),
        ]
        owner = np.concatenate([owner, owner])
        x, y, ends = np.concatenate([below[0], above[0]]), np.concatenate([below[1], above[1]]), np.concatenate([below[2], above[2][1:] + below[2][-1]])
        some = np.diff(ends) > 2
        x, y, ends = picked(x, y, ends, some)
        owner, limits = owner[some], [v[some] for v in limits]
    if not rows:
        none = np.zeros(0, "int64")
        return none, none, none, np.zeros(0), np.zeros(0), np.zeros(1, "int64")
    owner, column, row, x, y, sizes = (np.concatenate(c) for c in zip(*rows))
    return owner, column, row, x, y, np.concatenate([[0], np.cumsum(sizes)]).astype("int64")


def _rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, ends of all rings of a column of arrays of rings, and the row of each."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rings = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in rings.flatten().flatten())
    return x, y, np.concatenate([[0], np.cumsum(sizes)]).astype("int64"), np.repeat(np.arange(len(counts)), counts)


def _sides(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x2, y2 of the side that begins at each corner, and its ring."""
    sizes = np.diff(ends)
    after = np.arange(len(x)) + 1
    after[ends[1:][sizes > 0] - 1] = ends[:-1][sizes > 0]
    return x[after], y[after], np.repeat(np.arange(len(sizes)), sizes)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by the keys, the first place of each group there, and the group of each item there."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _side_lists(row, column, line, x1, y1, x2, y2, key: pa.Array) -> pa.RecordBatch:
    """Sides by polygon and cell; the sides of a group lie in one list."""
    order, first, _ = _groups(row, column, line)
    ends = pa.array(np.append(first, len(order)), "int32")
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(v[order]) for v in (x1, y1, x2, y2)], ["x1", "y1", "x2", "y2"]))
    at = order[first]
    return pa.RecordBatch.from_arrays([key.take(pa.array(row[at])), pa.array(column[at]), pa.array(line[at]), lists], ["k", "_tx", "_ty", "sides"])


def _mapped(polygons: DataFrame, key: str, run: Callable[[pa.Array, pa.Array, pa.Array], pa.RecordBatch], result: str) -> DataFrame:
    """run(keys, arrays of rings, arrays of hole flags) of the shapes that are there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield run(b.column(0), b.column(1), b.column(2))

    shaped = with_shape(polygons).filter(F.col("shape").isNotNull())
    given = shaped.select(F.col(key).alias("k"), F.transform("shape", lambda s: s["ring"]).alias("rings"), F.transform("shape", lambda s: s["hole"]).alias("holes"))
    return given.mapInArrow(each, f"k {dict(polygons.dtypes)[key]}, {result}").withColumnRenamed("k", key)


def parts(polygons: DataFrame, key: str, tile: float) -> DataFrame:
    """key, _tx, _ty and sides of each polygon in each cell that it meets: sides of the outline cut at the cell, closed
    along it. A point of the cell is inside if an odd number of them crosses its ray. Level sides don't count and
    are left out."""

    def run(keys: pa.Array, rings: pa.Array, holes: pa.Array) -> pa.RecordBatch:
        x, y, ends, row = _rings(rings)
        owner, column, line, x, y, ends = celled(x, y, ends, tile, 0.0, 0.0, SLACK * tile)
        x2, y2, of = _sides(x, y, ends)
        some = y != y2
        of = of[some]
        return _side_lists(row[owner][of], column[of], line[of], x[some], y[some], x2[some], y2[some], keys)

    return _mapped(polygons, key, run, f"_tx long, _ty long, sides {SIDES}")


def borders(polygons: DataFrame, key: str, tile: float, margin: float = 0.0) -> DataFrame:
    """key, _tx, _ty and whole sides of each polygon that come within margin of each cell. A long side is listed where it
    passes, not all over its bounds."""

    def run(keys: pa.Array, rings: pa.Array, holes: pa.Array) -> pa.RecordBatch:
        x, y, ends, row = _rings(rings)
        x2, y2, of = _sides(x, y, ends)
        fine = np.isfinite(x) & np.isfinite(y) & np.isfinite(x2) & np.isfinite(y2)
        x, y, x2, y2, row = x[fine], y[fine], x2[fine], y2[fine], row[of][fine]
        steps = np.maximum(1, np.ceil(np.maximum(abs(x2 - x), abs(y2 - y)) / tile)).astype("int64")
        side = np.repeat(np.arange(len(x)), steps)
        k = np.arange(len(side)) - np.repeat(np.cumsum(steps) - steps, steps)
        a, b = k / steps[side], (k + 1) / steps[side]
        wide = margin + SLACK * tile
        span = []
        for p, q in ((x, x2), (y, y2)):
            u, v = p[side] + a * (q - p)[side], p[side] + b * (q - p)[side]
            span += [np.floor((np.minimum(u, v) - wide) / tile).astype("int64"), np.floor((np.maximum(u, v) + wide) / tile).astype("int64")]
        c0, c1, r0, r1 = span
        wide_by, tall = c1 - c0 + 1, r1 - r0 + 1
        piece = np.repeat(np.arange(len(side)), wide_by * tall)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(wide_by * tall) - wide_by * tall, wide_by * tall)
        column, line, side = c0[piece] + at % wide_by[piece], r0[piece] + at // wide_by[piece], side[piece]
        order, first, _ = _groups(side, column, line)
        column, line, side = (v[order[first]] for v in (column, line, side))
        return _side_lists(row[side], column, line, x[side], y[side], x2[side], y2[side], keys)

    return _mapped(polygons, key, run, f"_tx long, _ty long, sides {SIDES}")


def cell_areas(polygons: DataFrame, key: str, x0: float, y0: float, step: float) -> DataFrame:
    """key, i, j, overlap_area: the positive areas that each polygon, less its holes, covers of a grid's cells."""

    def run(keys: pa.Array, rings: pa.Array, holes: pa.Array) -> pa.RecordBatch:
        x, y, ends, row = _rings(rings)
        sign = np.where(holes.flatten().fill_null(False).to_numpy(zero_copy_only=False), -1.0, 1.0)
        owner, column, line, x, y, ends = celled(x, y, ends, step, x0, y0, 0.0)
        x2, y2, of = _sides(x, y, ends)
        left, low = (x0 + column * step)[of], (y0 + line * step)[of]  # from the cell's corner, so that digits aren't lost
        area = abs(np.bincount(of, (x - left) * (y2 - low) - (x2 - left) * (y - low), len(owner))) / 2 * sign[owner]
        order, first, group = _groups(row[owner], line, column)
        total, at = np.bincount(group, area[order], len(first)), order[first]
        at, total = at[total > 0], total[total > 0]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row[owner[at]])), pa.array(line[at]), pa.array(column[at]), pa.array(total)], ["k", "i", "j", "overlap_area"])

    return _mapped(polygons, key, run, "i long, j long, overlap_area double")
