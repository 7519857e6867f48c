"""Approximate nearest neighbours by inner product over balanced posting lists.

Equal vectors form one class, which keeps its smallest distinct ids, as many as a result can name, and
the number of rows of each. Inner
products become Euclidean distances by one more component, sqrt(M^2 - |x|^2), M the largest norm.

The index is fitted on a bounded sample of classes: halving it again and again at the median along the
line between two centres gives lists of equal size, whose means are the centroids. A graph joins each
centroid with its nearest ones, and a beam walk over it finds the centroids near a vector. Every class
goes to its nearest list and, if it lies near a boundary, to up to three more whose distance is within
a ratio of the nearest. A query reads the lists whose distance is within a wider ratio of its nearest.
Each list is a group of its own; scores are exact inner products of the original vectors in double
precision. The best rows of each list meet once more for each query class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 20
QUERY_EVERY = 20
LIST_SIZE = 192
#: Documented bounds of what the driver holds: centroids, and numbers in the sample.
MOST_LISTS = 16_384
SAMPLE_NUMBERS = 16_000_000
COPIES = 4
#: About so many vectors, and so many queries, of a list meet in one group.
MOST_HELD, MOST_ASKING = 8192, 65_536
COPY_RATIO = 1.10
DEGREE = 16
COPY_BEAM = 16
READ_BEAM = 128
READ_RATIO = 1.5


def halve(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of x in groups of about equal size, none above size."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = x[rows]
        a, b = part[rng.integers(len(rows))], part[rng.integers(len(rows))]
        for _ in range(4):
            side = ((part - a) ** 2).sum(1) <= ((part - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = part[side].mean(0), part[~side].mean(0)
        along = part @ (a - b)
        order = np.argsort(along, kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entry: np.ndarray  # where walks start
    largest: float  # norm

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows of the index, in units of the largest norm: one more component makes all norms equal."""
        x = x.astype("float64") / self.largest
        rest = np.sqrt(np.maximum(1 - (x**2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1).astype("float32")

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Queries in the same units."""
        return np.pad((x.astype("float64") / self.largest).astype("float32"), ((0, 0), (0, 1)))

    def near(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids that the walk finds for each row, nearest first, and their distances."""
        n, beam = len(x), min(beam, len(self.centroids))
        d = distances(x, self.centroids[self.entry])
        first = np.argsort(d, 1, kind="stable")[:, :beam]
        ids, dist = self.entry[first], np.take_along_axis(d, first, 1)
        if ids.shape[1] < beam:
            gap = beam - ids.shape[1]
            ids, dist = np.pad(ids, ((0, 0), (0, gap)), constant_values=-1), np.pad(dist, ((0, 0), (0, gap)), constant_values=np.inf)
        done = np.zeros(ids.shape, bool)
        square, norm = (self.centroids**2).sum(1), (x**2).sum(1)
        for _ in range(64):
            open_ = ~done & (ids >= 0)
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                break
            at = open_[live].argmax(1)  # the nearest that is not expanded yet
            done[live, at] = True
            more = self.graph[ids[live, at]]
            gap = norm[live, None] + square[more] - 2 * np.einsum("nd,nkd->nk", x[live], self.centroids[more])
            gap[(more[:, :, None] == ids[live][:, None, :]).any(2)] = np.inf
            all_ids = np.concatenate([ids[live], np.where(np.isinf(gap), -1, more)], 1)
            all_d = np.concatenate([dist[live], np.maximum(gap, 0)], 1)
            all_done = np.concatenate([done[live], np.zeros(more.shape, bool)], 1)
            keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids[live], dist[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_d, all_done))
        return ids, dist

    def lists(self, x: np.ndarray, ratio: float, beam: int, most: int) -> list[np.ndarray]:
        """For each row of x, the lists whose distance is within a ratio of the nearest's."""
        out = []
        for i in range(0, len(x), 512):
            ids, dist = self.near(x[i : i + 512], beam)
            fit = (np.sqrt(dist) <= ratio * np.sqrt(dist[:, :1]) + 1e-6) & (ids >= 0)
            out += [row[ok][:most] for row, ok in zip(ids, fit)]
        return out


def build(sample: np.ndarray, classes: int, largest: float, seed: int = 3) -> Index:
    """sample: a bounded part of the classes; the number of lists follows all of them."""
    rng = np.random.default_rng(seed)
    lists = int(np.clip(-(-classes // LIST_SIZE), 1, min(MOST_LISTS, len(sample))))
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), largest)
    x = index.lift(sample)
    groups = halve(x, max(1, -(-len(x) // lists)), rng)
    c = np.stack([x[g].mean(0) for g in groups]).astype("float32")
    degree = min(DEGREE, len(c))
    near = np.concatenate([np.argpartition(distances(c[i : i + 1024], c), degree - 1, 1)[:, :degree] for i in range(0, len(c), 1024)])
    far = rng.integers(len(c), size=(len(c), 4))  # a few long edges join what lies apart
    index.centroids, index.graph = c, np.concatenate([near, far], 1)
    index.entry = rng.permutation(len(c))[: max(1, 4 * int(np.sqrt(len(c))))]
    return index


def _finite(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def enough(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Which places (ids and their numbers of rows, best first) can be among the k best rows when those of any
    one id don't count: at most k rows of an id matter, and k rows of the others before a place end it."""
    by = np.argsort(ids, kind="stable")
    total = np.cumsum(rows[by])
    first = np.flatnonzero(np.concatenate(([True], ids[by][1:] != ids[by][:-1]))[: len(by)])
    own = np.empty(len(by), "int64")
    own[by] = total - np.repeat((total - rows[by])[first], np.diff(np.append(first, len(by))))
    left = np.clip(k - (own - rows), 0, rows)
    most = np.concatenate(([0], np.maximum.accumulate(np.minimum(own, k))))[: len(by)]
    return (left > 0) & (np.cumsum(left) - left - most < k)


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each row whose vec_id is divisible by
    every, over all other rows, by (vec_id, embedding).

    Null and zero vectors, and those with a null or non-finite component, take no part, nor do rows
    without an id. Of vectors of several lengths the shorter count as padded with zeros. Rows that repeat
    an id are rows of their own, and only rows with another id are a query's candidates. Ties go to the
    smaller vec_id. Fewer than k candidates give fewer rows, and an empty table none.
    """
    spark = vectors.sparkSession
    #: Float vectors stay as they are; all others are doubles, so that scores are those of the original numbers.
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    code = "<f4" if kind == "float" else "<f8"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(_finite(F.col("v")))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(kind)).alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    distinct = rows.groupBy("a", "b", "vec_id").agg(F.count("*").alias("_rows"), F.first("v").alias("v"))
    ranked = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    #: At most k + 1 distinct ids of each class; a query leaves out its own and reads at most k rows.
    ranked = ranked.select("a", "b", "v", F.struct("vec_id", F.least("_rows", F.lit(k)).alias("rows")).alias("_id"))
    classes = ranked.groupBy("a", "b").agg(F.sort_array(F.collect_list("_id")).alias("_ids"), F.first("v").alias("v"))
    classes = classes.select("a", "b", "v", F.col("_ids.vec_id").alias("ids"), F.col("_ids.rows").alias("rows"))
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb"))
    asking = asked.select(F.col("qa").alias("a"), F.col("qb").alias("b")).distinct().withColumn("asked", F.lit(True))
    classes = cut(classes.join(asking, ["a", "b"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = classes.agg(F.count("*").alias("n"), F.max(norm).alias("m"), F.max(F.size("v")).alias("d"), F.count_if("asked").alias("q")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not found["n"]:
        return spark.createDataFrame([], result)
    dim = found["d"]
    most = max(1024, SAMPLE_NUMBERS // dim)
    picked = classes.select("v", F.xxhash64("a", "b").alias("h"))
    if found["n"] > most:
        picked = picked.filter(F.pmod(F.col("h"), F.lit(1 << 20)) < int((1 << 20) * most / found["n"]))
    made = build(_matrix(picked.orderBy("h").toPandas()["v"], dim, code), found["n"], found["m"])
    index = spark.sparkContext.broadcast(made)  # at most MOST_LISTS centroids
    #: Beyond MOST_LISTS lists grow with the input: each then meets its askers in several groups of bounded size.
    lists = len(made.centroids)
    parts = max(1, -(-found["n"] * COPIES // (lists * MOST_HELD)))
    sides = max(1, -(-found["q"] * READ_BEAM // (lists * MOST_ASKING)))

    def assign(batches):
        for b in batches:
            x, asks = _matrix(b["v"], dim, code), b["asked"].to_numpy(bool)
            copies = index.value.lists(index.value.lift(x), COPY_RATIO, COPY_BEAM, COPIES)
            reads = index.value.lists(index.value.asked(x[asks]), READ_RATIO, READ_BEAM, READ_BEAM)
            blob = [r.tobytes() for r in x.astype(code)]
            copies, reads = [_spread(c, b["a"].iat[i], parts, sides, 0) for i, c in enumerate(copies)], [_spread(r, q, sides, parts, 1) for r, q in zip(reads, b["a"].to_numpy()[asks])]
            sizes = [len(c) for c in copies]
            yield pd.DataFrame(
                {
                    "list": np.concatenate(copies), "a": np.repeat(b["a"].to_numpy(), sizes), "b": np.repeat(b["b"].to_numpy(), sizes),
                    "ids": np.repeat(b["ids"].to_numpy(), sizes), "rows": np.repeat(b["rows"].to_numpy(), sizes), "v": np.repeat(np.array(blob, object), sizes), "asks": False,
                }
            )
            q = b[asks]
            sizes = [len(r) for r in reads]
            if sum(sizes):
                blob = np.array(blob, object)[asks]
                yield pd.DataFrame(
                    {
                        "list": np.concatenate(reads), "a": np.repeat(q["a"].to_numpy(), sizes), "b": np.repeat(q["b"].to_numpy(), sizes),
                        "ids": [None] * sum(sizes), "rows": [None] * sum(sizes), "v": np.repeat(blob, sizes), "asks": True,
                    }
                )

    def read(group: pd.DataFrame) -> pd.DataFrame:
        """The best rows of one list for each class that asks it."""
        held, asks = group[~group["asks"]], group[group["asks"]]
        out = {"qa": [], "qb": [], "ca": [], "cb": [], "vec_id": [], "rows": [], "score": []}
        if len(held) and len(asks):
            x = np.frombuffer(b"".join(held["v"]), code).reshape(len(held), -1).astype("float64")
            sizes = held["ids"].map(len).to_numpy()
            ids, of = np.concatenate(held["ids"].to_numpy()), np.repeat(np.arange(len(held)), sizes)
            rows = np.concatenate(held["rows"].to_numpy())
            repeated = len(np.unique(ids)) < len(ids)
            for i in range(0, len(asks), 256):
                part = asks.iloc[i : i + 256]
                q = np.frombuffer(b"".join(part["v"]), code).reshape(len(part), -1).astype("float64")
                scores = q @ x.T
                for j in range(len(part)):
                    s = scores[j][of]
                    if len(s) > 4 * k and not repeated:  # all rows that tie with the last place stay for the sort
                        top = np.flatnonzero(s >= -np.partition(-s, k)[k])
                    else:
                        top = np.arange(len(s))
                    top = top[np.lexsort((ids[top], -s[top]))]
                    top = top[enough(ids[top], rows[top], k)]
                    out["qa"].append(np.full(len(top), part["a"].iat[j])), out["qb"].append(np.full(len(top), part["b"].iat[j]))
                    out["ca"].append(held["a"].to_numpy()[of[top]]), out["cb"].append(held["b"].to_numpy()[of[top]])
                    out["vec_id"].append(ids[top]), out["rows"].append(rows[top]), out["score"].append(s[top])
        return pd.DataFrame({n: np.concatenate(c) if c else np.zeros(0, "float64" if n == "score" else "int64") for n, c in out.items()})

    placed = classes.select("a", "b", "ids", "rows", "v", "asked").mapInPandas(assign, "list long, a long, b long, ids array<long>, rows array<long>, v binary, asks boolean")
    best = placed.groupBy("list").applyInPandas(read, "qa long, qb long, ca long, cb long, vec_id long, rows long, score double")
    best = best.groupBy("qa", "qb", "ca", "cb", "vec_id").agg(F.max("score").alias("score"), F.max("rows").alias("rows"))
    #: What enough() keeps, by the best rows of all lists.
    order = [F.desc("score"), F.col("vec_id"), F.col("ca"), F.col("cb")]
    own = Window.partitionBy("qa", "qb", "vec_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("_own", F.sum("rows").over(own)).filter(F.col("_own") - F.col("rows") < k)
    best = best.withColumn("rows", F.least("rows", k - F.col("_own") + F.col("rows"))).withColumn("_own", F.least("_own", F.lit(k)))
    place = Window.partitionBy("qa", "qb").orderBy(*order)
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    others = F.coalesce(F.sum("rows").over(before) - F.max("_own").over(before), F.lit(0))
    best = best.withColumn("_n", F.row_number().over(place)).withColumn("_others", others).filter(F.col("_others") < k)
    #: A bounded row of places for each class; many queries of one class then share it.
    best = best.groupBy("qa", "qb").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score", "rows"))).alias("_best"))
    best = best.select(F.concat_ws(":", "qa", "qb").alias("_q"), "_best")
    joined = asked.select("query_id", F.concat_ws(":", "qa", "qb").alias("_q")).join(best, "_q")
    others = F.filter("_best", lambda x: x["vec_id"] != F.col("query_id"))
    others = F.slice(F.flatten(F.transform(others, lambda x: F.array_repeat(x, x["rows"].cast("int")))), 1, k)
    return joined.select("query_id", F.posexplode(others)).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score")
    )


def _spread(lists: np.ndarray, key: int, own: int, other: int, which: int) -> np.ndarray:
    """The groups of a row in lists of own x other groups: one of own by its key, and all of other, so that
    every vector of a list meets every query that reads it once."""
    mine = int(key) % own
    if own == other == 1:
        return lists.astype("int64")
    cells = [mine * other + k if not which else k * own + mine for k in range(other)]
    return (lists.astype("int64")[:, None] * (own * other) + np.array(cells)).ravel()


def _matrix(column: pd.Series, dim: int, code: str = "<f4") -> np.ndarray:
    out = np.zeros((len(column), dim), code)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() over embeddings: every vec_id divisible by 20 against all rows."""
    return search(table(spark, sf_dir, "embeddings"))
