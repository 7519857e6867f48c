"""GeoTIFF, NetCDF classic and Zarr in and out of cell and grid tables, without extra libraries.

Files are read as binary by Spark's own reader, so any store that Spark reaches will do, and decoded in
Arrow batches, one file or chunk to a task's row. Zarr arrays are found by listing their chunk files.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of TIFF: tag numbers, and codes of field types.
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "packing", 273: "strips", 278: "rows", 279: "sizes", 317: "predictor", 322: "tile_w", 323: "tile_h", 324: "tiles", 325: "tile_sizes", 339: "kind", 33550: "scale", 33922: "tie", 42113: "nodata"}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


Reader = Callable[[int, int], bytes]


def _of(data: bytes) -> Reader:
    """Reads (offset, size) of a whole file that is there."""
    return lambda at, size: data[at : at + size]


def tiff_layout(read: Reader) -> dict:
    """What the head of a classic TIFF says of its first band: shape, kind, blocks (row, column, rows, columns, offset, size),
    packing, predictor, scale (pixel size), tie (raster and map point), nodata. Only the head is read."""
    end = "<" if read(0, 2) == b"II" else ">"
    if struct.unpack(end + "H", read(2, 2))[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(end + "I", read(4, 4))[0]
    count = struct.unpack(end + "H", read(at, 2))[0]
    entries = read(at + 2, 12 * count)
    tags: dict = {"packing": (1,), "predictor": (1,), "kind": (1,)}
    for p in range(0, 12 * count, 12):
        tag, code, n = struct.unpack(end + "HHI", entries[p : p + 8])
        if tag in _TAGS and code in _TYPES:
            fmt = f"{end}{n}s" if code == 2 else end + _TYPES[code] * n
            size = struct.calcsize(fmt)
            tags[_TAGS[tag]] = struct.unpack(fmt, entries[p + 8 : p + 8 + size] if size <= 4 else read(struct.unpack(end + "I", entries[p + 8 : p + 12])[0], size))
    w, h, kind = tags["width"][0], tags["height"][0], f"{end}{_KINDS[tags['kind'][0]]}{tags['bits'][0] // 8}"
    if tags["packing"][0] not in (1, 5, 8, 32946):
        raise ValueError("only plain, LZW-packed and deflated TIFFs are read")
    if "tiles" in tags:
        tw, th = tags["tile_w"][0], tags["tile_h"][0]
        places = [(i * th, j * tw, th, tw) for i in range(-(-h // th)) for j in range(-(-w // tw))]
        where = zip(tags["tiles"], tags["tile_sizes"])
    else:
        rows = min(tags.get("rows", (h,))[0], h)
        places, where = [(i, 0, min(rows, h - i), w) for i in range(0, h, rows)], zip(tags["strips"], tags["sizes"])
    nodata = tags.get("nodata")
    return {
        "shape": (h, w), "kind": kind, "blocks": [(*p, *q) for p, q in zip(places, where)], "packing": tags["packing"][0], "predictor": tags["predictor"][0],
        "scale": tags.get("scale"), "tie": tags.get("tie"), "nodata": float(nodata[0].strip(b"\0 ")) if nodata else None,
    }


def tiff_block(layout: dict, block: tuple[int, ...], raw: bytes) -> np.ndarray:
    """The cells of one block, less what lies beyond the raster's edges."""
    i, j, rows, columns = block[:4]
    unpack = {1: bytes, 5: unpack_lzw}.get(layout["packing"], zlib.decompress)
    part = np.frombuffer(unpack(raw), layout["kind"])[: rows * columns].reshape(rows, columns)
    if layout["predictor"] == 2:
        part = np.cumsum(part, 1, dtype=part.dtype)
    h, w = layout["shape"]
    return part[: h - i, : w - j]


def decode_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """The first band of a plain, LZW-packed or deflated TIFF in strips or tiles, and its scale, tie and nodata."""
    layout = tiff_layout(_of(data))
    out = np.zeros(layout["shape"], layout["kind"])
    for block in layout["blocks"]:
        part = tiff_block(layout, block, data[block[4] : block[4] + block[5]])
        out[block[0] : block[0] + part.shape[0], block[1] : block[1] + part.shape[1]] = part
    return out, {k: layout[k] for k in ("scale", "tie", "nodata")}


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from their high bits on, which grow one code early."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    out, known, last, width, bits, held = bytearray(), list(start), b"", 9, 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code, bits = bits >> held, bits & (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                known, last, width = list(start), b"", 9
                continue
            entry = known[code] if code < len(known) else last + last[:1]
            if last:
                known.append(last + entry[:1])
            out += entry
            last = entry
            width = 9 + sum(len(known) >= n for n in (511, 1023, 2047))
    return bytes(out)


def tiff_tiles(cells: DataFrame, left: float, top: float, dx: float, dy: float, tile: int = 512, nodata: float = -999999.0, name: str = "tile") -> DataFrame:
    """path and content of GeoTIFFs of a cell table (i, j, value), one for each tile that has cells; missing
    and null cells are nodata. A task holds one tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        a = np.full((tile, tile), nodata, "float64")
        v = pdf["value"].to_numpy(float)
        a[pdf["i"] - ti * tile, pdf["j"] - tj * tile] = np.where(np.isnan(v), nodata, v)
        data = encode_tiff(a, (dx, dy), (left + tj * tile * dx, top - ti * tile * dy), nodata)
        return pd.DataFrame({"path": [f"{name}_{ti}_{tj}.tif"], "content": [data]})

    at = lambda c: F.floor(F.col(c) / tile).cast("long").alias(f"t{c}")
    typed = cells.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("value").cast("double"), at("i"), at("j"))
    return typed.groupBy("ti", "tj").applyInPandas(run, "path string, content binary")


def encode_tiff(cells: np.ndarray, scale: tuple[float, float], origin: tuple[float, float], nodata: float | None = None) -> bytes:
    """A little-endian TIFF with one deflated strip."""
    a = np.ascontiguousarray(cells.astype(cells.dtype.newbyteorder("<")))
    body = zlib.compress(a.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    text = b"" if nodata is None else (f"{nodata:g}".encode() + b"\0").ljust(5, b"\0")
    fields = [(256, 4, [a.shape[1]]), (257, 4, [a.shape[0]]), (258, 3, [a.itemsize * 8]), (259, 3, [8]), (273, 4, [0]), (277, 3, [1]), (278, 4, [a.shape[0]]), (279, 4, [len(body)]), (339, 3, [kind]),
              (33550, 12, [*scale, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0])]
    fields += [(42113, 2, text)] if text else []
    tail, entries, at = b"", b"", 8 + 2 + 12 * len(fields) + 4
    size = sum(len(v) if t == 2 else struct.calcsize("<" + _TYPES[t] * len(v)) for _, t, v in fields if (len(v) if t == 2 else struct.calcsize("<" + _TYPES[t] * len(v))) > 4)
    for tag, t, v in fields:
        v = [at + size] if tag == 273 else v
        raw = bytes(v) if t == 2 else struct.pack("<" + _TYPES[t] * len(v), *v)
        entries += struct.pack("<HHI", tag, t, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + entries + b"\0\0\0\0" + tail + body


def read_tiffs(spark: SparkSession, path: str) -> DataFrame:
    """file, i, j, x, y (cell centres) and value of each cell of each file; nodata is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                a, meta = decode_tiff(bytes(content))
                sx, sy = (meta["scale"] or (1.0, 1.0))[:2]
                tie = meta["tie"] or (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
                rows = max(1, 1_000_000 // a.shape[1])
                for first in range(0, a.shape[0], rows):
                    part = a[first : first + rows]
                    i, j = (x.ravel() for x in np.mgrid[first : first + len(part), 0 : a.shape[1]])
                    v = part.astype("float64").ravel()
                    v[(v == meta["nodata"]) | ~np.isfinite(v)] = np.nan
                    yield pd.DataFrame({"file": name, "i": i, "j": j, "x": tie[3] + (j + 0.5 - tie[0]) * sx, "y": tie[4] - (i + 0.5 - tie[1]) * sy, "value": v})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInPandas(run, "file string, i long, j long, x double, y double, value double")
    return cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def decode_netcdf(data: bytes) -> dict[str, tuple[tuple[str, ...], np.ndarray]]:
    """Dimensions and values of the variables of a NetCDF classic file (CDF-1 or CDF-2)."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    wide, pos = data[3] == 2, 4
    kinds = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}

    def integer() -> int:
        nonlocal pos
        pos += 4
        return struct.unpack(">I", data[pos - 4 : pos])[0]

    def name() -> str:
        nonlocal pos
        n = integer()
        pos += n + -n % 4
        return data[pos - n - -n % 4 : pos - -n % 4].decode()

    def attributes() -> None:
        nonlocal pos
        _, count = integer(), integer()
        for _ in range(count):
            name()
            kind, n = integer(), integer()
            size = n * np.dtype(kinds[kind]).itemsize
            pos += size + -size % 4

    records = integer()
    _, count = integer(), integer()
    dims = [(name(), integer()) for _ in range(count)]
    attributes()
    _, count = integer(), integer()
    out, found = {}, []
    for _ in range(count):
        label, axes = name(), None
        axes = [integer() for _ in range(integer())]
        attributes()
        kind, size = integer(), integer()
        pos += 8 if wide else 4
        begin = int.from_bytes(data[pos - (8 if wide else 4) : pos], "big")
        found.append((label, axes, kinds[kind], size, begin))
    moving = [f for f in found if f[1] and dims[f[1][0]][1] == 0]
    stride = sum(f[3] for f in moving)
    for label, axes, kind, _, begin in found:
        shape = [dims[a][1] or records for a in axes]
        if axes and dims[axes[0]][1] == 0:
            n = int(np.prod(shape[1:], dtype=int))
            values = np.stack([np.frombuffer(data, kind, n, begin + r * stride) for r in range(records)]) if records else np.zeros((0, n), kind)
        else:
            values = np.frombuffer(data, kind, int(np.prod(shape, dtype=int)), begin)
        out[label] = tuple(dims[a][0] for a in axes), values.reshape(shape)
    return out


def read_netcdf(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """file, index (position on each axis) and value of one variable, in long form; NaN is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                _, values = decode_netcdf(bytes(content))[variable]
                yield from _long(name, values, (0,) * values.ndim)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _nan_null(files.mapInPandas(run, "file string, index array<long>, value double"))


def _long(name: str, values: np.ndarray, origin: tuple[int, ...], most: int = 500_000) -> Iterator[pd.DataFrame]:
    flat = values.reshape(-1)
    for first in range(0, len(flat), most):
        part = flat[first : first + most].astype("float64")
        at = np.stack(np.unravel_index(np.arange(first, first + len(part)), values.shape), 1) + np.array(origin)
        yield pd.DataFrame({"file": name, "index": list(at), "value": part})


def _nan_null(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _hidden_text(spark: SparkSession, path: str) -> str:
    """A small file whose name begins with a dot, which Spark's readers pass over."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(context._jsc.hadoopConfiguration()).open(at)
    try:
        return context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """file, index and value of one Zarr (version 2) array, plain or zlib-packed, from its chunks; cells
    of missing chunks are absent, fill values and NaN null."""
    meta = json.loads(_hidden_text(spark, f"{path}/.zarray"))
    packing = (meta.get("compressor") or {}).get("id")
    if packing not in (None, "zlib", "gzip"):
        raise ValueError("only plain and zlib-packed chunks are read")
    shape, chunks, kind, fill, order = meta["shape"], meta["chunks"], meta["dtype"], meta.get("fill_value"), meta.get("order", "C")
    mark = meta.get("dimension_separator", ".")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                at = [int(x) for x in re.split(r"[./]", name)[-len(shape) :]]
                raw = bytes(content)
                raw = raw if packing is None else zlib.decompress(raw, 47)
                a = np.frombuffer(raw, kind).reshape(chunks, order=order).astype("float64")
                origin = tuple(i * c for i, c in zip(at, chunks))
                a = a[tuple(slice(0, max(0, n - o)) for n, o in zip(shape, origin))]
                if isinstance(fill, int | float):
                    a = np.where(a == fill, np.nan, a)
                yield from _long(name, a, origin)

    pattern = mark.join(["*"] * len(shape)) if mark == "." else "/".join(["*"] * len(shape))
    files = spark.read.format("binaryFile").load(f"{path}/{'[0-9]' + pattern}" if mark == "." else f"{path}/{pattern}").select("path", "content")
    return _nan_null(files.mapInPandas(run, "file string, index array<long>, value double"))


def zarr_template(shape: list[int], chunks: list[int], kind: str = "<f8") -> bytes:
    """The description of an array that regions are written into later; cells that are never written read as missing."""
    return json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "C", "filters": None}).encode()


def zarr_chunks(cells: DataFrame, axes: list[str], chunks: list[int], kind: str = "<f8") -> DataFrame:
    """path and content of the chunks that a table of cells (positions on the axes, value) touches: a region
    write, if its edges are the chunks'. A task holds one chunk; missing cells are NaN."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [int(pdf[f"_c{k}"].iloc[0]) for k in range(len(axes))]
        a = np.full(chunks, np.nan)
        a[tuple(pdf[x].to_numpy() - c * n for x, c, n in zip(axes, at, chunks))] = pdf["value"]
        return pd.DataFrame({"path": [".".join(map(str, at))], "content": [zlib.compress(a.astype(kind).tobytes(), 1)]})

    places = [F.floor(F.col(x) / n).cast("long").alias(f"_c{k}") for k, (x, n) in enumerate(zip(axes, chunks))]
    typed = cells.select(*[F.col(x).cast("long").alias(x) for x in axes], F.col("value").cast("double"), *places)
    return typed.groupBy(*[f"_c{k}" for k in range(len(axes))]).applyInPandas(run, "path string, content binary")


def zarr_shape(spark: SparkSession, path: str) -> list[int]:
    """Cells on each axis of a Zarr (version 2) array, from its description."""
    return json.loads(_hidden_text(spark, f"{path}/.zarray"))["shape"]


def combined(frames: list[DataFrame], coordinates: dict[str, list[float] | DataFrame], lengths: list[int] | None = None) -> DataFrame:
    """The cells (index, value) of several arrays of one grid, with the coordinates of their axes as columns. The arrays
    follow each other on the first axis, each with the length of its own: lengths (see zarr_shape()), else
    one more than the last position that has a cell. An axis' coordinates are a list or a table (position, coordinate) and
    are joined by position. Those of the first axis must be as many as the arrays' lengths together."""
    spark = frames[0].sparkSession
    lengths = lengths or [(f.agg(F.max(F.get("index", F.lit(0)))).first()[0] or -1) + 1 for f in frames]
    tables = {}
    for name, values in coordinates.items():
        listed = values if isinstance(values, DataFrame) else spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "position long, coordinate double")
        tables[name] = listed.select(F.col("position").cast("long").alias(f"_at_{name}"), F.col("coordinate").alias(name))
    first = tables[next(iter(tables))].count()
    if first != sum(lengths):
        raise ValueError(f"{first} coordinates for arrays of {lengths} cells")
    out, before = None, 0
    for f, n in zip(frames, lengths):
        at = [(F.get("index", F.lit(k)).cast("long") + (before if not k else 0)).alias(f"_at_{name}") for k, name in enumerate(tables)]
        whole = f.select(*at, "value")
        out, before = whole if out is None else out.unionByName(whole), before + n
    for name, listed in tables.items():
        out = out.join(listed, f"_at_{name}", "left")
    return out.select(*tables, "value")


def write_zarr(values: np.ndarray, chunks: tuple[int, ...]) -> dict[str, bytes]:
    """File names and contents of a Zarr (version 2) array, zlib-packed."""
    meta = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "C", "filters": None}
    out = {".zarray": json.dumps(meta).encode()}
    for at in itertools.product(*[range(-(-n // c)) for n, c in zip(values.shape, chunks)]):
        block = np.zeros(chunks, values.dtype)
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        out[".".join(map(str, at))] = zlib.compress(block.tobytes(), 1)
    return out
