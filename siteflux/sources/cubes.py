"""Spark data sources of arrays: cells of Zarr (version 2) arrays and of GeoTIFFs, block by block.

A partition of a scan is some chunks of an array or some blocks of a file, and a task reads just their bytes. Bounds on
axes, given as options or as filters that Spark pushes down, choose the chunks and blocks; Spark still applies the filters. A
write puts whole chunks beside the array and moves them in when all tasks are done, so that a failed one leaves
the array as it was. Files are reached by pyarrow's file systems: a path that all executors share, or a URI.
"""

from __future__ import annotations

import itertools
import json
import threading
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .rasters import tiff_block, tiff_layout, zarr_template

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Cells in a partition of a scan, about, and in an Arrow batch.
CELLS, BATCH = 4_000_000, 500_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def bounds_of(filters: list[Filter], names: list[str]) -> dict[str, tuple[float, float]]:
    """The least and largest value of each column that the filters, all together, let through; no entry where they say nothing."""
    out = {n: (-np.inf, np.inf) for n in names}
    for f in filters:
        name = getattr(f, "attribute", ("",))
        if len(name) != 1 or name[0] not in out:
            continue
        low, high = out[name[0]]
        if isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
            low, high = max(low, f.value), min(high, f.value)
        elif isinstance(f, In):
            known = [v for v in f.value if v is not None]
            low, high = (max(low, min(known)), min(high, max(known))) if known else (np.inf, -np.inf)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = max(low, f.value)
        elif isinstance(f, LessThan | LessThanOrEqual):
            high = min(high, f.value)
        out[name[0]] = low, high
    return {n: b for n, b in out.items() if b != (-np.inf, np.inf)}


@dataclass
class Blocks(InputPartition):
    """Blocks that a task reads, one after the other."""

    items: list


class _Bounded(DataSourceReader):
    """What both readers share: bounds by column, from the option within and from filters."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.within = {n: tuple(b) for n, b in json.loads(options.get("within", "{}")).items()}
        self.group = int(options.get("cells", CELLS))

    def _narrow(self, filters: list[Filter]) -> list[Filter]:
        for n, (low, high) in bounds_of(filters, self.names).items():
            a, b = self.within.get(n, (-np.inf, np.inf))
            self.within[n] = (max(a, low), min(b, high))
        return filters

    def _grouped(self, items: list, size) -> list[Blocks]:
        out, held = [], self.group
        for x in items:
            if held + size(x) > self.group:
                out.append(Blocks([]))
                held = 0
            out[-1].items.append(x)
            held += size(x)
        return out or [Blocks([])]


def _batches(columns: list[np.ndarray], names: list[str], value: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(value), BATCH):
        v = value[a : a + BATCH]
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + BATCH]) for c in columns] + [pa.array(v, "float64", mask=np.isnan(v))], [*names, "value"])


# --- Zarr -----------------------------------------------------------------------------------------------


def _axes(options: dict) -> list[tuple[str, float, float] | tuple[str, None, None]]:
    """Name, first coordinate and step of each axis; without those two its positions are the coordinates."""
    return [(a[0], *(a[1:] or (None, None))) for a in json.loads(options["axes"])]


def _meta(path: str) -> dict:
    store, at = _store(path)
    with store.open_input_file(f"{at}/.zarray") as f:
        meta = json.loads(f.read())
    if (meta.get("compressor") or {}).get("id") not in (None, "zlib", "gzip") or meta.get("filters"):
        raise ValueError("only plain and zlib-packed chunks are read and written")
    return meta


def _chunk_name(meta: dict, at: tuple[int, ...]) -> str:
    return meta.get("dimension_separator", ".").join(map(str, at))


def _chunk(store: fs.FileSystem, path: str, meta: dict) -> np.ndarray | None:
    """A chunk's cells as doubles, fill values as NaN; None where it was never written."""
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(path) as f:
        raw = f.read()
    raw = zlib.decompress(raw, 47) if meta.get("compressor") else raw
    a = np.frombuffer(raw, meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C")).astype("float64")
    fill = meta.get("fill_value")
    return np.where(a == fill, np.nan, a) if isinstance(fill, int | float) else a


class ZarrReader(_Bounded):
    def __init__(self, options: dict):
        self.axes = _axes(options)
        super().__init__(options, [a[0] for a in self.axes])

    def partitions(self) -> list[Blocks]:
        meta, ranges = _meta(self.path), []
        for (name, first, step), n, size in zip(self.axes, meta["shape"], meta["chunks"]):
            low, high = self.within.get(name, (-np.inf, np.inf))
            if first is not None:
                low, high = sorted(((low - first) / step, (high - first) / step))
            low, high = max(0, int(max(low, -1)) if np.isfinite(low) else 0), min(n - 1, int(np.ceil(high)) if np.isfinite(high) else n - 1)
            ranges.append(range(low // size, high // size + 1) if low <= high else range(0))
        return self._grouped([*itertools.product(*ranges)], lambda at: int(np.prod(meta["chunks"])))

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        meta = _meta(self.path)
        store, root = _store(self.path)
        for at in partition.items:
            a = _chunk(store, f"{root}/{_chunk_name(meta, at)}", meta)
            if a is None:
                continue
            origin = [c * k for c, k in zip(at, meta["chunks"])]
            a = a[tuple(slice(0, max(0, n - o)) for n, o in zip(meta["shape"], origin))]
            places = [g.ravel() + o for g, o in zip(np.indices(a.shape), origin)]
            yield from _batches([p if first is None else first + step * p for p, (_, first, step) in zip(places, self.axes)], self.names, a.ravel())


class PushedZarrReader(ZarrReader):
    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self._narrow(filters)


@dataclass
class Written(WriterCommitMessage):
    """Chunks of one task: the file beside the array, and its name in it."""

    files: list[tuple[str, str]]


class ZarrWriter(DataSourceArrowWriter):
    """Chunks are written whole; cells that a chunk had before stay where the rows say nothing."""

    def __init__(self, options: dict):
        self.path, self.names, self.job = options["path"], [a[0] for a in _axes(options)], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        meta, attempt = _meta(self.path), uuid.uuid4().hex
        store, root = _store(self.path)
        store.create_dir(f"{root}/.writing-{self.job}", recursive=True)
        done: dict[tuple[int, ...], str] = {}
        at, a = None, None

        def put() -> None:
            target = f"{root}/.writing-{self.job}/{attempt}-{len(done)}"
            raw = a.astype(meta["dtype"]).tobytes(order=meta.get("order", "C"))
            with store.open_output_stream(target) as f:
                f.write(zlib.compress(raw, 1) if meta.get("compressor") else raw)
            done[at] = target

        for b in iterator:
            places = np.stack([b.column(n).to_numpy() for n in self.names], 1).astype("int64")
            if ((places < 0) | (places >= np.array(meta["shape"]))).any():
                raise ValueError("a cell lies outside the array")
            value = b.column("value").to_numpy(zero_copy_only=False).astype("float64")
            value = np.where(np.isnan(value) & isinstance(meta.get("fill_value"), int | float), meta.get("fill_value") or 0, value)
            chunks = places // np.array(meta["chunks"])
            edges = np.flatnonzero((chunks[1:] != chunks[:-1]).any(1)) + 1
            for i, j in zip([0, *edges], [*edges, len(value)]):
                if i == j:
                    continue
                here = tuple(chunks[i].tolist())
                if here != at:
                    if at is not None:
                        put()
                    if here in done:
                        raise ValueError("the rows of a chunk must follow each other, in one task; see write_cube()")
                    at, old = here, _chunk(store, f"{root}/{_chunk_name(meta, here)}", meta)
                    fill = meta.get("fill_value")
                    empty = float(fill) if isinstance(fill, int | float) else np.nan
                    a = np.full(meta["chunks"], empty) if old is None else np.where(np.isnan(old), empty, old)
                a[tuple((places[i:j] - np.array(here) * np.array(meta["chunks"])).T)] = value[i:j]
        if at is not None:
            put()
        return Written([(f, _chunk_name(meta, k)) for k, f in done.items()])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for file, name in (x for m in messages if m for x in m.files):
            if "/" in name:
                store.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            store.move(file, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/.writing-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/.writing-{self.job}")


class ZarrCells(DataSource):
    """Options: path; axes, a JSON list of [name] or [name, first coordinate, step]; within, JSON of [least, largest] by axis;
    cells, about so many to a partition."""

    @classmethod
    def name(cls) -> str:
        return "zarr_cells"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {'bigint' if first is None else 'double'}" for n, first, _ in _axes(self.options)) + ", value double"

    def reader(self, schema) -> DataSourceReader:
        return (PushedZarrReader if self.options.get("pushed") == "true" else ZarrReader)(self.options)

    def writer(self, schema, overwrite: bool) -> ZarrWriter:
        return ZarrWriter(self.options)


# --- GeoTIFF --------------------------------------------------------------------------------------------


class TiffReader(_Bounded):
    """Blocks of all files; bounds on x and y choose among them from the files' heads."""

    def __init__(self, options: dict):
        super().__init__(options, ["i", "j", "x", "y"])

    def partitions(self) -> list[Blocks]:
        store, root = _store(self.path)
        if store.get_file_info(root).type == fs.FileType.Directory:
            files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.lower().endswith((".tif", ".tiff")))
        else:
            files = [root]
        items = []
        for file in files:
            with store.open_input_file(file) as f:
                layout = tiff_layout(lambda at, size: f.read_at(size, at))
            blocks = layout.pop("blocks")
            items += [(file, layout, b) for b in blocks if self._asked(layout, b)]
        return self._grouped(items, lambda x: x[2][2] * x[2][3])

    def _asked(self, layout: dict, block: tuple[int, ...]) -> bool:
        i, j, rows, columns = block[:4]
        x, y = _centres(layout, np.array([i, i + rows - 1]), np.array([j, j + columns - 1]))
        ends = {"i": (i, i + rows - 1), "j": (j, j + columns - 1), "x": (min(x), max(x)), "y": (min(y), max(y))}
        return all(ends[n][0] <= high and low <= ends[n][1] for n, (low, high) in self.within.items())

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for file, layout, block in partition.items:
            with store.open_input_file(file) as f:
                a = tiff_block(layout, block, f.read_at(block[5], block[4]))
            i, j = (g.ravel() + o for g, o in zip(np.indices(a.shape), block[:2]))
            v = a.astype("float64").ravel()
            v[(v == layout["nodata"]) | ~np.isfinite(v)] = np.nan
            x, y = _centres(layout, i, j)
            for b in _batches([i, j, x, y], ["i", "j", "x", "y"], v):
                yield pa.RecordBatch.from_arrays([pa.array([file] * b.num_rows), *b.columns], ["file", *b.schema.names])


def _centres(layout: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sx, sy = (layout["scale"] or (1.0, 1.0))[:2]
    tie = layout["tie"] or (0.0,) * 6
    return tie[3] + (j + 0.5 - tie[0]) * sx, tie[4] - (i + 0.5 - tie[1]) * sy


class PushedTiffReader(TiffReader):
    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self._narrow(filters)


class TiffCells(DataSource):
    """Options: path of a file or a folder; within, JSON of [least, largest] of i, j, x or y; cells, about so many to a partition."""

    @classmethod
    def name(cls) -> str:
        return "tiff_cells"

    def schema(self) -> str:
        return "file string, i bigint, j bigint, x double, y double, value double"

    def reader(self, schema) -> DataSourceReader:
        return (PushedTiffReader if self.options.get("pushed") == "true" else TiffReader)(self.options)


# --- what a user calls ----------------------------------------------------------------------------------


_REGISTERING = threading.Lock()


def _register(spark: SparkSession, source: type[DataSource]) -> None:
    """Once for each session, as registering anew takes the source away for a moment."""
    spark.createDataFrame([], "a int")  # which makes the session the active one of a thread that has none; sources are looked up there
    with _REGISTERING:
        known = spark.__dict__.setdefault("_siteflux_sources", set())
        if source not in known:
            spark.dataSource.register(source)
            known.add(source)


def _loaded(spark: SparkSession, source: type[DataSource], path: str, within: dict | None, cells: int, **more: str) -> DataFrame:
    _register(spark, source)
    pushed = spark.conf.get(PUSHDOWN, "false") == "true"
    return spark.read.format(source.name()).options(path=path, pushed=str(pushed).lower(), within=json.dumps(within or {}), cells=str(cells), **more).load()


def read_cube(spark: SparkSession, path: str, axes: list, within: dict | None = None, cells: int = CELLS) -> DataFrame:
    """The axes' columns and value of the cells of a Zarr array's chunks; fill values and NaN are null, cells of chunks that were
    never written absent. axes: names, or (name, first coordinate, step). within: (least, largest) of axes; it and, in a session with
    spark.sql.python.filterPushdown.enabled, filters choose the chunks that are read."""
    named = [[a] if isinstance(a, str) else list(a) for a in axes]
    df = _loaded(spark, ZarrCells, path, within, cells, axes=json.dumps(named))
    return _kept(df, within)


def read_tiff_cells(spark: SparkSession, path: str, within: dict | None = None, cells: int = CELLS) -> DataFrame:
    """file, i, j, x, y (cell centres) and value of the cells of a GeoTIFF or a folder of them, nodata null; only the blocks that within
    and pushed filters ask for are read."""
    return _kept(_loaded(spark, TiffCells, path, within, cells), within)


def _kept(df: DataFrame, within: dict | None) -> DataFrame:
    for n, (low, high) in (within or {}).items():
        df = df.filter(F.col(n).between(low, high))
    return df


def create_cube(path: str, shape: list[int], chunks: list[int], kind: str = "<f8") -> None:
    """An array without cells, for regions to be written into."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/.zarray") as f:
        f.write(zarr_template(shape, chunks, kind))


def write_cube(cells: DataFrame, path: str, axes: list[str]) -> None:
    """Writes cells (positions on the axes, value) into a Zarr array that is there; see create_cube(). A null value
    empties its cell. All of it is there afterwards or nothing; regions whose edges are the chunks' may be written side by side."""
    spark, size = cells.sparkSession, _meta(path)["chunks"]
    _register(spark, ZarrCells)
    chunk = [F.floor(F.col(a) / n) for a, n in zip(axes, size)]
    typed = cells.select(*[F.col(a).cast("long").alias(a) for a in axes], F.col("value").cast("double").alias("value"))
    dealt = typed.repartition(*chunk).sortWithinPartitions(*chunk)
    dealt.write.format("zarr_cells").options(path=path, axes=json.dumps([[a] for a in axes])).mode("append").save()
