"""Boosted regression trees that grow leaf by leaf, on binned features.

Rows stay where they are. For each leaf that may be split, tasks add up gradients and weights by feature and bin and
Spark adds what the tasks found, so that the driver sees one small histogram for a leaf, whatever the table holds;
its sibling's is what is left of the parent's. The leaf with the largest gain is split next (best first), until the tree
has its leaves or no gain is enough. Leaf values and gains have L1 and L2 penalties.

A row's leaf and its prediction since the last checkpoint are worked out from the trees, which are small, and predictions
are written to the shared folder every few trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut
from .models import fold_of
from .parallel import side_by_side

#: Trees between two checkpoints of the predictions.
KEEP = 16
#: Rows of a block.
PACK = 1 << 18
LEAST_WEIGHT = 1e-3


@dataclass(frozen=True)
class Settings:
    """The settings of the reference."""

    rate: float = 0.01
    leaves: int = 5
    depth: int = 4
    least_rows: int = 1000
    l1: float = 1.0
    l2: float = 10.0
    least_gain: float = 0.1
    rows: float = 0.7
    columns: float = 0.7
    bins: int = 255


@dataclass
class Tree:
    """Nodes from the root, 0. A split has a feature, the bins that go left, and two children; a leaf (feature -1) a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[np.ndarray | None] = field(default_factory=lambda: [None])
    children: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, leaf: int, feature: int, left_bins: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        two = (len(self.feature), len(self.feature) + 1)
        self.feature[leaf], self.left_bins[leaf], self.children[leaf] = feature, left_bins, two
        for v in values:
            self.feature.append(-1), self.left_bins.append(None), self.children.append((0, 0)), self.value.append(v)
        return two

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), "int64")
        for node, (f, mask, (left, right)) in enumerate(zip(self.feature, self.left_bins, self.children)):
            if f >= 0:  # children come after their parent
                here = np.flatnonzero(at == node)
                at[here] = np.where(mask[bins[here, f]], left, right)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


def shrunk(g: np.ndarray | float, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score(g: np.ndarray | float, h: np.ndarray | float, s: Settings) -> np.ndarray:
    return shrunk(g, s.l1) ** 2 / (h + s.l2)


def best_split(hist: np.ndarray, categorical: bool, s: Settings) -> tuple[float, np.ndarray | None]:
    """Gain and left bins of the best split of one feature's histogram (bin; gradient, weight, rows). Bin 0 has the
    missing values, which go to the better side. Categories are taken in the order of their mean gradient."""
    total, missing, known = hist.sum(0), hist[0], hist[1:]
    order = np.arange(len(known))
    if categorical:
        order = np.lexsort((order, known[:, 0] / (known[:, 1] + s.l2)))
        order = order[known[order, 2] > 0]
    left = known[order].cumsum(0)
    best, bins = 0.0, None
    for with_missing in (False, True) if missing[2] else (False,):
        l = left + missing if with_missing else left  # noqa: E741
        r = total - l
        ok = (l[:, 2] >= max(1, s.least_rows)) & (r[:, 2] >= max(1, s.least_rows)) & (l[:, 1] >= LEAST_WEIGHT) & (r[:, 1] >= LEAST_WEIGHT)
        gain = np.where(ok, score(l[:, 0], l[:, 1], s) + score(r[:, 0], r[:, 1], s) - score(total[0], total[1], s), -np.inf)
        if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > max(best, s.least_gain):
            best, bins = float(gain[k]), np.zeros(len(hist), bool)
            bins[1 + order[: k + 1]] = True
            bins[0] = with_missing
    return best, bins


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A share of 1 for each row, from its id."""
    with np.errstate(over="ignore"):
        h = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(11)) / float(1 << 53)


def _of(b: pa.RecordBatch, name: str, k: int, kind: str) -> np.ndarray:
    """The array that a binary value holds."""
    return np.frombuffer(b.column(name)[k].as_buffer(), kind)


def packed(rows: DataFrame, widths: list[int]) -> DataFrame:
    """Rows (id, bins, y, w, fold) as blocks of arrays, about PACK rows each: the distinct bins are cells, and each row has the
    number of its own, so that trees are worked out once a cell."""
    names, kinds = ["id", "y", "w", "fold"], ["int64", "float64", "float64", "int32"]

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        bins = t["bins"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(widths))
        if math.prod(widths) < 1 << 62:
            key = np.zeros(len(bins), "int64")
            for f, n in enumerate(widths):
                key = key * n + bins[:, f]
            _, first, at = np.unique(key, return_index=True, return_inverse=True)
            cells = bins[first]
        else:
            cells, at = np.unique(bins, axis=0, return_inverse=True)
        held = [t[n].to_numpy().astype(k) for n, k in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], "binary") for v in (cells.astype("int32"), at.ravel().astype("int32"), *held)], ["cells", "at", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for b in batches:
            parts.append(b)
            if sum(p.num_rows for p in parts) >= PACK:
                yield block(parts)
                parts = []
        if sum(p.num_rows for p in parts):
            yield block(parts)

    return rows.select("bins", *names).mapInArrow(run, ", ".join(f"{n} binary" for n in ("cells", "at", *names)))


def fold_sums(blocks: DataFrame) -> dict[int, tuple[float, float]]:
    """Sums of weighted outcomes and of weights by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w, (folds, at) = _of(b, "w", k, "float64"), np.unique(_of(b, "fold", k, "int32"), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(folds), pa.array(np.bincount(at, w * _of(b, "y", k, "float64"))), pa.array(np.bincount(at, w))], ["fold", "wy", "w"])

    sums = blocks.mapInArrow(run, "fold int, wy double, w double").groupBy("fold").agg(F.sum("wy"), F.sum("w"))
    return {r[0]: (r[1], r[2]) for r in sums.collect()}  # one row a fold


class Booster:
    """Trees over blocks of binned rows; rows that are held out are only scored."""

    def __init__(self, categorical: list[bool], widths: list[int], settings: Settings, seed: int):
        self.categorical, self.widths, self.settings, self.seed = categorical, widths, settings, seed
        self.trees: list[Tree] = []
        self.start = 0.0
        self.errors: list[float] = []
        self.hold: int | None = None

    def fit(self, rows: DataFrame, rounds: int, stop: Callable[[list[float]], bool] = lambda errors: False) -> Booster:
        """grown() over rows (id, bins, y, w, held)."""
        blocks = cut(packed(rows.withColumn("fold", F.col("held").cast("int")), self.widths))
        wy, w = fold_sums(blocks).get(0, (0.0, 0.0))
        return self.grown(blocks, rounds, wy / w if w else 0.0, 1, stop)

    def grown(self, blocks: DataFrame, rounds: int, start: float, hold: int | None = None, stop: Callable[[list[float]], bool] = lambda errors: False) -> Booster:
        """blocks as of packed(). The rows of fold hold are only scored. errors[t] is their mean square error after t + 1 trees;
        stop(errors) ends the growth."""
        self.start, self.hold = start, hold
        state, since = blocks.withColumn("pred", F.lit(None).cast("binary")), 0
        for t in range(rounds):
            if t - since == KEEP:
                state, since = cut(self._kept(state, self.trees[since:])), t
            tree, error = self._grown(state, self.trees[since:], t)
            if t and error is not None:
                self.errors.append(error)
                if stop(self.errors):
                    return self
            if tree is None:
                return self
            self.trees.append(tree)
        self.errors.append(self._histogram(state, self.trees[since:], Tree(), 0, [], rounds)[1])
        return self

    def _cells(self, b: pa.RecordBatch, k: int, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        """Bins and predictions of the cells of a batch's block k."""
        cells, known = _of(b, "cells", k, "int32").reshape(-1, len(self.widths)), b.column("pred")[k].is_valid
        return cells, (_of(b, "pred", k, "float64") if known else self.start) + sum((t.predict(cells) for t in trees), np.zeros(len(cells)))

    def _kept(self, state: DataFrame, trees: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pred = pa.array([self._cells(b, k, trees)[1].tobytes() for k in range(b.num_rows)], "binary")
                yield pa.RecordBatch.from_arrays([pred if n == "pred" else b.column(n) for n in b.schema.names], b.schema.names)

        return state.mapInArrow(run, state.schema)

    def _predicted(self, state: DataFrame, trees: list[Tree]) -> DataFrame:
        width = len(self.widths)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = b.column("bins").flatten().to_numpy().reshape(-1, width)
                pred = b.column("pred").to_numpy() + sum(t.predict(bins) for t in trees)
                yield pa.RecordBatch.from_arrays([pa.array(pred) if n == "pred" else b.column(n) for n in b.schema.names], b.schema.names)

        return state.mapInArrow(run, state.schema)

    def _histogram(self, state: DataFrame, trees: list[Tree], tree: Tree, leaf: int, columns: list[int], t: int) -> tuple[dict[int, np.ndarray], float | None]:
        """The histograms of a leaf's bagged rows, and the held-out error before this tree."""
        widths, share, seed = self.widths, self.settings.rows, self.seed * 1_000_003 + t

        hold = self.hold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {f: np.zeros((widths[f], 3)) for f in columns}
            error = np.zeros(3)
            for b in batches:
                for k in range(b.num_rows):
                    cells, pred = self._cells(b, k, trees)
                    at, fold = _of(b, "at", k, "int32"), _of(b, "fold", k, "int32")
                    y, w, id_ = _of(b, "y", k, "float64"), _of(b, "w", k, "float64"), _of(b, "id", k, "int64")
                    held = np.flatnonzero(fold == hold) if hold is not None else at[:0]
                    if len(held) and len(tree.feature) == 1:
                        off = pred[at[held]] - y[held]
                        error += (float((w[held] * off * off).sum()), float(w[held].sum()), len(held))
                    if not columns:
                        continue
                    on = _mixed(id_, seed) < share
                    if len(tree.feature) > 1:
                        on &= (tree.leaf_of(cells) == leaf)[at]
                    on[held] = False
                    at, w = at[on], w[on]
                    g, h, n = (np.bincount(at, v, len(cells)) for v in ((pred[at] - y[on]) * w, w, None))
                    for f in columns:
                        found[f] += np.stack([np.bincount(cells[:, f], v, widths[f]) for v in (g, h, n)], 1)
            rows = [(f, k, *v) for f, hist in found.items() for k, v in enumerate(hist) if v[2]] + [(-1, 0, *error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["f", "bin", "g", "h", "n"])

        parts = state.mapInArrow(run, "f long, bin long, g double, h double, n double")
        out, error = {f: np.zeros((widths[f], 3)) for f in columns}, None
        for r in parts.groupBy("f", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():  # at most features times bins
            if r[0] >= 0:
                out[r[0]][r[1]] = r[2:]
            elif r[4]:
                error = r[2] / r[3] if r[3] else 0.0
        return out, error

    def _grown(self, state: DataFrame, trees: list[Tree], t: int) -> tuple[Tree | None, float | None]:
        s, tree = self.settings, Tree()
        take = max(1, math.ceil(s.columns * len(self.widths) - 1e-9))
        columns = sorted(np.random.default_rng([self.seed, t]).permutation(len(self.widths))[:take].tolist())
        hist, error = self._histogram(state, trees, tree, 0, columns, t)
        open_, hists, depth = {0: self._candidate(hist)}, {0: hist}, {0: 0}
        for n in range(1, s.leaves):
            leaf = max(open_, key=lambda k: (open_[k][0], -k))
            gain, f, left_bins = open_.pop(leaf)
            if f < 0:
                break
            parent = hists.pop(leaf)
            sums = [parent[f][m].sum(0) for m in (left_bins, ~left_bins)]
            two = tree.split(leaf, f, left_bins, tuple(float(-s.rate * shrunk(x[0], s.l1) / (x[1] + s.l2)) for x in sums))
            if n == s.leaves - 1:
                break
            small = int(sums[0][2] > sums[1][2])
            deep = depth[leaf] + 1
            if deep < s.depth:
                first, _ = self._histogram(state, trees, tree, two[small], columns, t)
                for k, h in ((two[small], first), (two[1 - small], {c: parent[c] - first[c] for c in columns})):
                    hists[k], depth[k], open_[k] = h, deep, self._candidate(h)
            if not open_:
                break
        return (tree if len(tree.feature) > 1 else None), error

    def _candidate(self, hist: dict[int, np.ndarray]) -> tuple[float, int, np.ndarray | None]:
        best = (0.0, -1, None)
        for f, h in hist.items():
            gain, bins = best_split(h, self.categorical[f], self.settings)
            if bins is not None and gain > best[0]:
                best = (gain, f, bins)
        return best


@dataclass
class LeafwiseBoosting:
    """As models.BlockedBoosting, with trees that grow leaf by leaf: fit() finds, for each fold of blocks, the round from
    which the held-out error no longer falls by min_delta within patience rounds, and refits all rows with the mean of
    those rounds, cut to a whole number. Folds are fitted side by side, threads at a time.

    Nulls and NaN are a bin of their own, as are categories that training never saw. Rows without an outcome or a positive
    weight teach nothing. Numbers have up to settings.bins bins at their quantiles."""

    features: list[str]
    outcome: str
    block: str
    weight: str | None = None
    categorical: list[str] = field(default_factory=list)
    settings: Settings = Settings()
    rounds: int = 2000
    folds: int = 5
    patience: int = 100
    min_delta: float = 1e-5
    seed: int = 1
    threads: int = 4
    keep_held_out: bool = False
    edges: list = field(default_factory=list)
    best: list = field(default_factory=list)
    model: Booster | None = None
    held_out: DataFrame | None = None

    def _learn_bins(self, data: DataFrame) -> None:
        numbers = [f for f in self.features if f not in self.categorical]
        known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        shares = F.array(*[F.lit(k / self.settings.bins) for k in range(1, self.settings.bins)])
        found = data.agg(F.lit(0), *[F.percentile_approx(known(f), shares, F.lit(20_000)).alias(f) for f in numbers]).first()
        levels = {f: sorted(r[0] for r in data.select(F.col(f).cast("string")).filter(F.col(f).isNotNull()).distinct().limit(1 << 16).collect()) for f in self.categorical}
        if any(len(v) == 1 << 16 for v in levels.values()):
            raise ValueError("a categorical feature has more than 65,535 levels")
        self.edges = [np.array(levels[f]) if f in levels else np.unique(np.array(found[f] or [], float)) for f in self.features]

    def _widths(self) -> list[int]:
        return [len(e) + (1 if f in self.categorical else 2) for f, e in zip(self.features, self.edges)]

    def _binned(self, data: DataFrame, keep: list) -> DataFrame:
        """keep's columns and bins, an array of the features' bins."""
        given = data.select(*keep, *[F.col(f).cast("string" if f in self.categorical else "double").alias(f"_f{k}") for k, f in enumerate(self.features)])
        edges, categorical, n = self.edges, [f in self.categorical for f in self.features], len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = np.zeros((b.num_rows, len(edges)), "int32")
                for k, (e, c) in enumerate(zip(edges, categorical)):
                    v = b.column(n + k)
                    if c:
                        v = np.array([x or "" for x in v.to_pylist()], str) if len(e) else np.zeros(0, str)
                        at = np.searchsorted(e, v).clip(0, max(0, len(e) - 1)) if len(e) else np.zeros(0, int)
                        out[:, k] = np.where(e[at] == v, at + 1, 0) if len(e) else 0
                        out[b.column(n + k).is_null().to_numpy(zero_copy_only=False), k] = 0
                    else:
                        v = v.to_numpy(zero_copy_only=False).astype(float)
                        out[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype="int32") * len(edges)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], lists], [*b.schema.names[:n], "bins"])

        kept = given.select(*given.columns[:n])
        return given.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in kept.dtypes] + ["bins array<int>"]))

    def _stop(self, errors: list[float]) -> bool:
        return len(errors) - self._best_round(errors) >= self.patience

    def _best_round(self, errors: list[float]) -> int:
        low, at = float("inf"), 0
        for k, e in enumerate(errors):
            if e < low - self.min_delta:
                low, at = e, k
        return at + 1

    def _booster(self) -> Booster:
        return Booster([f in self.categorical for f in self.features], self._widths(), self.settings, self.seed)

    def fit(self, data: DataFrame) -> LeafwiseBoosting:
        self._learn_bins(data)
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        keep = [F.col(self.outcome).cast("double").alias("y"), w.alias("w"), fold_of(self.block, self.folds, self.seed).alias("fold")]
        rows = self._binned(data, keep).filter("w > 0 AND y IS NOT NULL AND NOT isnan(y)")
        blocks = cut(packed(rows.withColumn("id", F.monotonically_increasing_id()), self._widths()))
        sums = fold_sums(blocks)
        folds = sorted(sums)

        def start(hold: int | None) -> float:
            wy, w = (math.fsum(s[k] for f, s in sums.items() if f != hold) for k in (0, 1))
            return wy / w if w else 0.0

        def one(k: int) -> tuple[int, Booster]:
            booster = self._booster().grown(blocks, self.rounds, start(k), k, self._stop)
            return self._best_round(booster.errors), booster

        found = side_by_side([lambda k=k: one(k) for k in folds], self.threads) if len(folds) > 1 else []
        self.best = [r for r, _ in found]
        rounds = max(1, sum(self.best) // len(self.best)) if self.best else self.rounds
        self.model = self._booster().grown(blocks, rounds, start(None))
        if self.keep_held_out:
            self.held_out = None
            for k, (n, booster) in zip(folds, found):
                booster.trees = booster.trees[:n]
                part = self._scored(data.filter(fold_of(self.block, self.folds, self.seed) == k), booster)
                self.held_out = part if self.held_out is None else self.held_out.unionByName(part)
        return self

    def _scored(self, data: DataFrame, booster: Booster) -> DataFrame:
        whole = self._binned(data, [F.struct(*[F.col(c) for c in data.columns]).alias("_whole")]).withColumn("pred", F.lit(booster.start))
        return booster._predicted(whole, booster.trees).select("_whole.*", F.col("pred").alias("prediction"))

    def predict(self, data: DataFrame) -> DataFrame:
        """Every row of data with its prediction, also those with nulls."""
        return self._scored(data, self.model)


def with_settings(**changes) -> Settings:
    return replace(Settings(), **changes)
