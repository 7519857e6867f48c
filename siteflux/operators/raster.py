"""Rasters as cell tables (i, j, value): one row for each cell, row and column from 0, nodata null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: D8 codes to row and column steps (1 east, then clockwise by doubling).
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def masked(value: Column, nodata: int = -999999) -> Column:
    return F.when(value != nodata, value)


def scaled(value: Column, factor: float = 100.0) -> Column:
    """An integer raster, truncated toward zero."""
    return (value * factor).cast("int")


def shape_of(cells: DataFrame) -> DataFrame:
    """One row: rows, columns, cells and repeats (cells that share a place); an empty raster has none."""
    one = cells.groupBy("i", "j").agg(F.count("*").alias("_n"))
    return one.agg(
        (F.coalesce(F.max("i") - F.min("i") + 1, F.lit(0))).cast("long").alias("rows"), (F.coalesce(F.max("j") - F.min("j") + 1, F.lit(0))).cast("long").alias("columns"),
        F.count("*").alias("cells"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("repeats"),
    )


def require_shape(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """cells, if they are a whole raster of that shape; one aggregate, else an error."""
    got = shape_of(cells).first()
    if (got["rows"], got["columns"], got["cells"], got["repeats"]) != (rows, columns, rows * columns, 0):
        raise ValueError(f"expected {rows} x {columns} cells, found {got.asDict()}")
    return cells


def step_of(direction: Column, dy: float, dx: float) -> tuple[Column, Column, Column]:
    """Row step, column step and length of a D8 direction; other codes stay in place."""
    table = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for c, s in D8.items() for v in (c, s[k])]), direction), F.lit(0))
    di, dj = table(0), table(1)
    return di, dj, F.sqrt(F.pow(di * F.lit(dy), F.lit(2.0)) + F.pow(dj * F.lit(dx), F.lit(2.0)))


#: Cells across a tile: with a halo of 4 a cell is dealt out 1.03 times on average, with one of 33 1.27 times.
TILE = 512


def by_tile(cells: DataFrame, halo: int, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """i, j and, as a double, what kernel gives for each cell from its neighbours up to halo cells off.

    A cell goes to its own tile and to those in whose halo it lies: one shuffle and no self-join. kernel gets part
    of a tile with its halo, NaN where there is no value, and gives the part without the halo, NaN for null.
    Cells without a place are left out; NaN counts as no value; of cells that repeat a place one counts."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        own = (i // TILE == key[0]) & (j // TILE == key[1])
        if not own.any():
            return pd.DataFrame({"i": i[own], "j": j[own], name: np.zeros(0)})
        top, left = i[own].min() - halo, j[own].min() - halo
        z = np.full((i[own].max() + halo + 1 - top, j[own].max() + halo + 1 - left), np.nan)
        inside = (i >= top) & (i < top + z.shape[0]) & (j >= left) & (j < left + z.shape[1])
        z[i[inside] - top, j[inside] - left] = pdf["value"].to_numpy(float)[inside]
        return pd.DataFrame({"i": i[own], "j": j[own], name: kernel(z)[i[own] - top - halo, j[own] - left - halo]})

    kinds = dict(cells.dtypes)
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / TILE), F.floor((F.col(c) + halo) / TILE)))
    dealt = cells.select("i", "j", F.col("value").cast("double").alias("value")).withColumn("_ti", touched("i")).withColumn("_tj", touched("j"))
    return dealt.groupBy("_ti", "_tj").applyInPandas(run, f"i {kinds['i']}, j {kinds['j']}, {name} double")


def moved(z: np.ndarray, halo: int, a: int, b: int) -> np.ndarray:
    """What lies a rows and b columns from each cell of an array without its halo."""
    return z[halo + a : z.shape[0] - halo + a, halo + b : z.shape[1] - halo + b]


def circle(cells: int) -> list[tuple[int, int]]:
    """Offsets inside a circle that is so many cells wide."""
    r = cells // 2
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r + 0.25]


def position_index(cells: DataFrame, width: int = 9, factor: float = 100.0) -> DataFrame:
    """tpi: the cell less the mean of the circle around it, as a scaled integer; null cells stay null."""
    halo = width // 2

    def above(z: np.ndarray) -> np.ndarray:
        known = ~np.isnan(z)
        value, total, n = np.where(known, z, 0.0), 0.0, 0
        for a, b in circle(width):
            total, n = total + moved(value, halo, a, b), n + moved(known, halo, a, b)
        return moved(z, halo, 0, 0) - total / np.maximum(n, 1)

    return by_tile(cells, halo, above, "_d").select("i", "j", scaled(F.col("_d"), factor).alias("tpi"))


def slope(cells: DataFrame, dy: float, dx: float) -> DataFrame:
    """slope_x1000 by third-order differences of the eight neighbours, null at edges."""

    def steepest(z: np.ndarray) -> np.ndarray:
        at = lambda a, b: moved(z, 1, a, b)
        gx = ((at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))) / (8 * dx)
        gy = ((at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))) / (8 * dy)
        return np.sqrt(gx * gx + gy * gy)

    return by_tile(cells, 1, steepest, "_s").select("i", "j", scaled(F.col("_s"), 1000.0).alias("slope_x1000"))


def sampled(points: DataFrame, cells: DataFrame, x: str, y: str, left: float, top: float, dx: float, dy: float) -> DataFrame:
    """points with value of the cell that each lies in, null off the raster and at nodata."""
    p = points.withColumn("i", F.floor((top - F.col(y)) / dy).cast("long")).withColumn("j", F.floor((F.col(x) - left) / dx).cast("long"))
    return p.join(cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value"), ["i", "j"], "left")


def resampled(cells: DataFrame, template: DataFrame, ratio_y: float, ratio_x: float, shift_y: float = 0.0, shift_x: float = 0.0) -> DataFrame:
    """The template's cells with the value at the nearest source cell: centres map by ratio and shift."""
    src = lambda k, ratio, shift: F.floor((F.col(k) + 0.5) * ratio + shift).cast("long")
    t = template.select("i", "j", src("i", ratio_y, shift_y).alias("_i"), src("j", ratio_x, shift_x).alias("_j"))
    s = cells.select(F.col("i").cast("long").alias("_i"), F.col("j").cast("long").alias("_j"), "value")
    return t.join(s, ["_i", "_j"], "left").select("i", "j", "value")


@dataclass(frozen=True)
class Grid:
    """Where a raster's cells lie: the left edge of column 0, the top edge of row 0, and a cell's width and height."""

    left: float
    top: float
    dx: float
    dy: float

    def centre(self) -> tuple[Column, Column]:
        return self.left + (F.col("j") + 0.5) * self.dx, self.top - (F.col("i") + 0.5) * self.dy

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column with fractions; whole numbers are centres of cells."""
        return (self.top - y) / self.dy - 0.5, (x - self.left) / self.dx - 0.5


def warped(cells: DataFrame, grid: Grid, template: DataFrame, to: Grid, to_source: Callable[[Column, Column], tuple[Column, Column]], bilinear: bool = False) -> DataFrame:
    """i, j and value of the template's cells, on the grid to, from cells on another grid and in another projection.

    to_source turns x and y of the template's projection into those of the cells'. Only cells within the bounds of what
    the template asks for are read on. Nearest: the cell that a centre falls in. Bilinear: the four cells around it by
    distance, of which those without a value don't count; each cell goes to the four blocks of two by two that it is in,
    so that a template's cell meets one row. Null where no cell counts or no place projects there."""
    v, u = grid.place(*to_source(*to.centre()))
    asked = template.select("i", "j", v.alias("_v"), u.alias("_u"))
    half = 0.0 if bilinear else 0.5
    known = F.col("_v").isNotNull() & F.col("_u").isNotNull()
    asked = asked.withColumns({n: F.when(known, F.floor(F.col(c) + half)).cast("long") for n, c in (("_i", "_v"), ("_j", "_u"))})
    top, bottom, left, right = asked.agg(F.min("_i"), F.max("_i"), F.min("_j"), F.max("_j")).first()
    if top is None:
        return template.select("i", "j", F.lit(None).cast("double").alias("value"))
    near = cells.filter(F.col("i").between(top, bottom + 1) & F.col("j").between(left, right + 1))
    near = near.select(F.col("i").cast("long").alias("_i"), F.col("j").cast("long").alias("_j"), F.col("value").cast("double").alias("_value"))
    if not bilinear:
        return asked.join(near, ["_i", "_j"], "left").select("i", "j", F.col("_value").alias("value"))
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners])).alias("_c")
    blocks = near.filter("_value IS NOT NULL").select("_i", "_j", "_value", moves)
    blocks = blocks.groupBy((F.col("_i") - F.col("_c.a")).alias("_i"), (F.col("_j") - F.col("_c.b")).alias("_j")).agg(
        *[F.max(F.when((F.col("_c.a") == a) & (F.col("_c.b") == b), F.col("_value"))).alias(f"_{a}{b}") for a, b in corners]
    )
    fv, fu = F.col("_v") - F.col("_i"), F.col("_u") - F.col("_j")
    share = {(a, b): (fv if a else 1 - fv) * (fu if b else 1 - fu) for a, b in corners}
    total = weight = F.lit(0.0)
    for (a, b), w in share.items():
        there = F.col(f"_{a}{b}").isNotNull()
        total, weight = total + F.when(there, w * F.col(f"_{a}{b}")).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    return asked.join(blocks, ["_i", "_j"], "left").select("i", "j", F.when(weight > 0, total / weight).alias("value"))


def mosaic(frames: list[DataFrame]) -> DataFrame:
    """The first valid value of each cell, by the frames' order."""
    ranked = None
    for k, f in enumerate(frames):
        part = f.select("i", "j", "value", F.lit(k).alias("k"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("i", "j").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("k"))).alias("value"))


def rasterized(shapes: DataFrame, shape: str, burn: str, cells: DataFrame, left: float, top: float, dx: float, dy: float, tile: float, fill=None) -> DataFrame:
    """cells with the burn value of the last shape that holds their centre, else fill; holes burn nothing."""
    from . import spatial

    centres = cells.select("i", "j", (left + (F.col("j") + 0.5) * dx).alias("x"), (top - (F.col("i") + 0.5) * dy).alias("y"))
    #: The burn value travels with the shape's id, one key for both.
    named = shapes.withColumn("_named", F.struct(F.col(shape).alias("id"), F.col(burn).alias("burn")))
    last = spatial._hits(centres, named, "_named", "x", "y", tile).groupBy("i", "j").agg(F.max_by("_named.burn", "_named.id").alias("value"))
    return cells.select("i", "j").join(last, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(fill)).alias("value"))


def flow_paths(cells: DataFrame, dy: float, dx: float, most: int | None = None) -> DataFrame:
    """i, j, dist, end_i, end_j: the length of the flow path of each cell down to its stream or sink.

    cells has direction (D8) and stop (true at streams). Successors double: after k rounds a cell knows
    its 2^k-th successor, and rounds go on until every path has ended or none ends that hadn't before, which is a
    cycle. Paths off the raster end at their last cell; cycles have null, as do paths of over ``most`` steps where
    that is given."""
    di, dj, length = step_of(F.col("direction"), dy, dx)
    moved = cells.select("i", "j", (F.col("i") + F.when(F.col("stop"), 0).otherwise(di)).alias("ni"), (F.col("j") + F.when(F.col("stop"), 0).otherwise(dj)).alias("nj"), F.when(F.col("stop"), 0.0).otherwise(length).alias("dist"))
    here = cells.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.lit(True).alias("_in"))
    state = moved.join(here, ["ni", "nj"], "left").select(
        "i", "j", F.when(F.col("_in"), F.col("ni")).otherwise(F.col("i")).alias("ni"), F.when(F.col("_in"), F.col("nj")).otherwise(F.col("j")).alias("nj"),
        F.when(F.col("_in"), F.col("dist")).otherwise(0.0).alias("dist"),
    )
    state = cut(state)
    #: True ends step nowhere from the start; a cycle only comes back to itself.
    ends = cut(state.filter("i = ni AND j = nj").select("ni", "nj", F.lit(True).alias("_end")))
    state, left, before = state.withColumn("_n", ((F.col("i") != F.col("ni")) | (F.col("j") != F.col("nj"))).cast("long")), None, None
    while left is None or (left and left != before):
        #: A longer path's later cells have paths of every shorter length, so a round in which none ends leaves only cycles.
        nxt = state.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("ni").alias("_i"), F.col("nj").alias("_j"), F.col("dist").alias("_d"), F.col("_n").alias("_m"))
        state = cut(state.join(nxt, ["ni", "nj"]).select("i", "j", F.col("_i").alias("ni"), F.col("_j").alias("nj"), (F.col("dist") + F.col("_d")).alias("dist"), (F.col("_n") + F.col("_m")).alias("_n")))
        before, left = left, state.join(ends, ["ni", "nj"], "left_anti").count()
    joined = state.join(ends, ["ni", "nj"], "left")
    ok = F.col("_end").isNotNull() & (F.lit(most is None) | (F.col("_n") <= F.lit(most or 0)))
    return joined.select("i", "j", F.when(ok, F.col("dist")).alias("dist"), F.when(ok, F.col("ni")).alias("end_i"), F.when(ok, F.col("nj")).alias("end_j"))


def height_above(paths: DataFrame, elevation: DataFrame) -> DataFrame:
    """hand: elevation above the path's end, not below 0."""
    end = elevation.select(F.col("i").alias("end_i"), F.col("j").alias("end_j"), F.col("value").alias("_e"))
    joined = paths.join(elevation, ["i", "j"]).join(end, ["end_i", "end_j"], "left")
    return joined.select("i", "j", F.when(F.col("_e").isNotNull(), F.greatest(F.col("value") - F.col("_e"), F.lit(0))).alias("hand"))


def _lower_envelope(f: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the least f[q] + (step * (p - q))^2 and its q."""
    good = np.flatnonzero(np.isfinite(f))
    n, s2 = len(f), step * step
    if not len(good):
        return np.full(n, np.inf), np.full(n, -1)
    v, z = [int(good[0])], [-np.inf]
    for q in good[1:]:
        while True:
            p = v[-1]
            x = ((f[q] + s2 * q * q) - (f[p] + s2 * p * p)) / (2 * s2 * (q - p))
            if x > z[-1]:
                break
            v.pop(), z.pop()
        v.append(int(q)), z.append(x)
    own = np.array(v)[np.searchsorted(np.array(z), np.arange(n), "left").clip(1) - 1]
    return f[own] + s2 * (np.arange(n) - own) ** 2, own


#: Columns of a raster that one task holds at a time.
STRIP = 16


def distance_transform(cells: DataFrame, dy: float, dx: float) -> DataFrame:
    """i, j, dist, near_i, near_j: exact distance of each cell to the nearest one with site true.

    Down the columns the nearest site is the last one before or the first one after a cell, STRIP columns at a
    time; along the rows, one at a time, it follows from a lower envelope. Holes of the raster take part in
    between. Without any site dist is null. Equal distances may name either site; cells without a place are
    left out; a place that repeats counts once."""

    typed = cells.select(F.col("i").cast("long"), F.col("j").cast("long"), F.coalesce("site", F.lit(False)).alias("site")).filter("i IS NOT NULL AND j IS NOT NULL")
    low, high = typed.agg(F.min("i"), F.max("i")).first()
    low, high = low or 0, high or 0

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        left, i = pdf["j"].min(), pdf["i"].to_numpy() - low
        j = pdf["j"].to_numpy() - left
        have, site = (np.zeros((high + 1 - low, j.max() + 1), bool) for _ in range(2))
        have[i, j] = True
        yes = pdf["site"].to_numpy(bool)
        site[i[yes], j[yes]] = True
        at = np.arange(len(site), dtype=float)[:, None]
        before = np.maximum.accumulate(np.where(site, at, -np.inf), 0)
        after = np.minimum.accumulate(np.where(site, at, np.inf)[::-1], 0)[::-1]
        near = np.where(at - before <= after - at, before, after)
        i, j = np.nonzero(have | np.isfinite(near))
        near = near[i, j]
        found = np.isfinite(near)
        near = np.where(found, near, -1).astype("int64")
        return pd.DataFrame({"i": i + low, "j": j + left, "own": have[i, j], "d": np.where(found, (dy * (i - near)) ** 2, np.inf), "near_i": near + low})

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        left, k = pdf["j"].min(), (pdf["j"] - pdf["j"].min()).to_numpy()
        f, near = np.full(k.max() + 1, np.inf), np.zeros(k.max() + 1, "int64")
        f[k], near[k] = pdf["d"], pdf["near_i"]
        d, own = _lower_envelope(f, dx)
        k = k[pdf["own"].to_numpy(bool)]
        return pd.DataFrame({"i": pdf["i"].iloc[0], "j": k + left, "dist": np.sqrt(d[k]), "near_i": near[own[k]], "near_j": own[k] + left})

    down = typed.groupBy(F.floor(F.col("j") / STRIP)).applyInPandas(columns, "i long, j long, own boolean, d double, near_i long")
    out = down.groupBy("i").applyInPandas(row, "i long, j long, dist double, near_i long, near_j long")
    ok = F.col("dist") < float("inf")
    return out.select("i", "j", F.when(ok, F.col("dist")).alias("dist"), F.when(ok, F.col("near_i")).alias("near_i"), F.when(ok, F.col("near_j")).alias("near_j"))


def allocated(distances: DataFrame, sites: DataFrame) -> DataFrame:
    """i, j and the value of the nearest site."""
    s = sites.select(F.col("i").cast("long").alias("near_i"), F.col("j").cast("long").alias("near_j"), "value")
    return distances.join(s, ["near_i", "near_j"], "left").select("i", "j", "value")


def flood_fill(cells: DataFrame) -> DataFrame:
    """i, j of the cells inside mask that four-neighbour steps reach from a seed.

    Labels spread to neighbours and then jump to their label's label, so the rounds follow the
    logarithm of a region's width rather than the width. They go on until no label changes."""
    inside = cut(cells.filter("mask").select("i", "j", "seed", F.struct("i", "j").alias("p")))
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])).alias("s")
    links = inside.select("p", offsets, "i", "j").select("p", F.struct((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).alias("q"))
    links = cut(links.join(inside.select(F.col("p").alias("q")), "q").select("p", "q"))
    label = inside.select("p", F.col("p").alias("l"))
    while True:
        seen = links.join(label.select(F.col("p").alias("q"), "l"), "q").groupBy("p").agg(F.min("l").alias("m"))
        low = label.join(seen, "p", "left").select("p", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        low = cut(low)
        #: The old label's cell may have found a lower one too.
        hook = low.groupBy(F.col("l").alias("r")).agg(F.min("m").alias("n"))
        jump = low.join(hook, low["l"] == hook["r"]).select("p", "l", F.least("m", "n").alias("m"))
        up = jump.select(F.col("p").alias("m"), F.col("m").alias("mm"))
        new = cut(jump.join(up, "m", "left").select("p", "l", F.least("m", F.coalesce("mm", "m")).alias("m")))
        if not new.filter("l != m").take(1):
            label = new.select("p", F.col("m").alias("l"))
            break
        label = new.select("p", F.col("m").alias("l"))
    wet = label.join(inside.filter("seed").select("p"), "p").select("l").distinct()
    return label.join(wet, "l", "left_semi").select("p.i", "p.j")


#: The ternary form table, by number of lower (rows) and higher (columns) directions.
FORMS = (
    ("flat", "flat", "flat", "footslope", "footslope", "valley", "valley", "valley", "pit"),
    ("flat", "flat", "footslope", "footslope", "footslope", "valley", "valley", "valley"),
    ("flat", "shoulder", "slope", "slope", "hollow", "hollow", "valley"),
    ("shoulder", "shoulder", "slope", "slope", "slope", "hollow"),
    ("shoulder", "shoulder", "spur", "slope", "slope"),
    ("ridge", "ridge", "spur", "spur"),
    ("ridge", "ridge", "ridge"),
    ("ridge", "ridge"),
    ("summit",),
)


def landforms(cells: DataFrame, reach: int, dy: float, dx: float, flat_degrees: float = 1.0) -> DataFrame:
    """form of each cell: in eight lines of sight, the steepest rise and fall within reach cells tell
    whether the ground lies higher, level or lower; the two counts name the form. Lines in which no cell has a
    value count as neither; cells without a value have no form."""

    def counted(z: np.ndarray) -> np.ndarray:
        here = moved(z, reach, 0, 0)
        lower, higher = np.zeros(here.shape), np.zeros(here.shape)
        for a, b in D8.values():
            up, down = np.full(here.shape, -np.inf), np.full(here.shape, -np.inf)
            for r in range(1, reach + 1):
                rise = (moved(z, reach, a * r, b * r) - here) / np.hypot(a * r * dy, b * r * dx)
                up, down = np.fmax(up, rise), np.fmax(down, -rise)
            seen = np.isfinite(up)
            up, down = (np.degrees(np.arctan(np.where(seen, x, 0.0))) for x in (up, down))
            level = np.abs(up - down) < flat_degrees
            higher += seen & ~level & (up > down)
            lower += seen & ~level & (up <= down)
        return np.where(np.isnan(here), np.nan, lower * 9 + higher)

    counts = by_tile(cells, reach, counted, "_c").withColumn("_c", F.col("_c").cast("int"))
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in FORMS])
    return counts.select("i", "j", F.get(F.get(table, F.floor(F.col("_c") / 9).cast("int")), F.col("_c") % 9).alias("form"))
