"""Embedding whitening: exact covariances by a digit-slice GEMM, then an eigendecomposition.

Each component c becomes the integer x = floor(64 * c) + 1000000. The fit list is each distinct vector once: n vectors
with sums S in each dimension. y = n * x - S is centred exactly, as it adds up to zero, and its products give the
covariance V = sum(y y') / n^3.

The products are exact. y is cut into limbs of ``LIMB`` bits, the last one with the sign, and limb matrices of at
most ``BLOCK`` rows are multiplied in doubles by BLAS: 2 * LIMB bits a product and BLOCK of them stay
within 53 bits. Shifted and added as integers of any size, they are the block's products, and a task adds its
blocks. Tasks send rows of their triangle cut into digits of ``DIGIT`` bits, which Spark adds by place, and the driver
puts d * d numbers together: the covariance itself, whatever the table holds. One division of integers rounds
each entry, and the eigenvectors of that matrix are the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import finite, largest, matrix
from .common import cut, frugal, table
from .textbatch import lean

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMB, BLOCK = 20, 4096
DIGIT = 30
#: Rows of whitened numbers that are made at a time.
ROWS = 4096


def limbs(y: np.ndarray, most: int) -> list[np.ndarray]:
    """y, of magnitude most or less, as doubles of LIMB bits, the lowest first; the last has the sign."""
    out, count = [], max(1, -(-(most.bit_length()) // LIMB))
    for k in range(count):
        high = y >> LIMB if k < count - 1 else y * 0
        out.append((y - (high << LIMB)).astype("float64"))
        y = high
    return out


def products(y: np.ndarray, most: int) -> np.ndarray:
    """y' y as integers of any size."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a in range(0, len(y), BLOCK):
        parts = limbs(y[a : a + BLOCK], most)
        for k in range(len(parts)):
            for m in range(k, len(parts)):
                got = (parts[k].T @ parts[m]).astype("int64").astype(object)
                total += (got if k == m else got + got.T) << (LIMB * (k + m))
    return total


def digits(values: np.ndarray) -> list[np.ndarray]:
    """Integers of any size as places of DIGIT bits; each place has its number's sign."""
    out, sign, left = [], np.where(values < 0, -1, 1), abs(values)
    while (left > 0).any() or not out:
        out.append((sign * (left & ((1 << DIGIT) - 1))).astype("int64"))
        left = left >> DIGIT
    return out


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = frugal(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    return rows.filter(finite(F.col("v")))


def _centred(x: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """n * x - S; wide: as integers of any size."""
    return n * x.astype(object) - sums if wide else n * x - sums.astype("int64")


class Fit:
    """What the fit list comes to: n, sums, the bound of n * x - S, eigenvalues and components (as columns)."""

    def __init__(self, n: int, sums: list[int], most: int, products: np.ndarray):
        self.n, self.sums, self.most = n, np.array(sums, object), most
        d = len(sums)
        self.v = np.array([[int(c) / n**3 for c in row] for row in products], "float64").reshape(d, d)
        values, vectors = np.linalg.eigh(self.v)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        #: Either sign is right; the entry of the largest magnitude is positive.
        top = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[top, np.arange(d)] < 0, -1.0, 1.0)
        self.trace = float(np.trace(self.v))
        self.values, self.vectors = values[:COMPONENTS], vectors[:, :COMPONENTS]
        #: Variance that is only the rounding of the largest counts as none.
        self.some = self.values > max(d, 1) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)

    @property
    def wide(self) -> bool:
        return self.most * self.most * max(1, len(self.sums)) >= 1 << 63

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of n * x - S on the components, over the roots of the eigenvalues; 0 on those without variance."""
        root = np.sqrt(np.where(self.some, self.values, 1.0))
        return np.where(self.some, (y / self.n).astype("float64") @ self.vectors / root, 0.0)


def _fit_list(rows: DataFrame, dim: int) -> DataFrame:
    """x: each distinct vector of integers once, as longs."""
    padded = F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).otherwise(F.col("v"))
    x = F.transform(padded, lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)
    return rows.select(x.alias("x")).distinct()


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """n, S, and a bound of |n * x - S|."""

    def run(batches):
        n, sums, low, high = 0, np.zeros(dim, object), None, None
        for b in batches:
            if b.num_rows:
                x = _integers(b.column(0), dim)
                n, sums = n + len(x), sums + sum(x[a : a + BLOCK].astype(object).sum(0) for a in range(0, len(x), BLOCK))
                low, high = (f(([] if o is None else [o]) + [g]) for f, o, g in ((min, low, int(x.min())), (max, high, int(x.max()))))
        if n:
            at = digits(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] + [0] * (len(at) - 1)), pa.array([low] * len(at)), pa.array([high] * len(at)), pa.array(range(len(at))), pa.array([*at], pa.list_(pa.int64()))], ["n", "low", "high", "place", "row"]
            )

    found = fit.mapInArrow(lean(run), "n long, low long, high long, place long, row array<long>")
    ends = found.agg(F.sum("n"), F.min("low"), F.max("high")).first()
    added = found.select("place", F.posexplode("row").alias("j", "x")).groupBy("place", "j").agg(F.sum("x").alias("x")).collect()
    sums = [0] * dim
    for r in added:
        sums[r["j"]] += r["x"] << (DIGIT * r["place"])
    n, low, high = ends
    return n, sums, max([abs(n * e - s) for e in (low, high) for s in sums])


def _covariances(fit: DataFrame, n: int, sums: list[int], most: int, dim: int) -> np.ndarray:
    """Sums of products of n * x - S over the fit list, as integers of any size."""

    def run(batches):
        total, some = np.zeros((dim, dim), object), False
        for b in batches:
            x = _integers(b.column(0), dim)
            for a in range(0, len(x), BLOCK):
                total, some = total + products(_centred(x[a : a + BLOCK], n, np.array(sums, object), most >= 1 << 62), most), True
        for i in range(dim if some else 0):
            at = digits(total[i, i:])
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at)), pa.array(range(len(at))), pa.array([*at], pa.list_(pa.int64()))], ["i", "place", "row"])

    found = fit.mapInArrow(lean(run), "i long, place long, row array<long>").select("i", "place", F.posexplode("row").alias("j", "x"))
    out = np.zeros((dim, dim), object)
    for r in found.groupBy("i", "j", "place").agg(F.sum("x").alias("x")).toLocalIterator():
        i, j = r["i"], r["i"] + r["j"]
        out[i, j] += r["x"] << (DIGIT * r["place"])
    return np.triu(out) + np.triu(out, 1).T


def _identity_error(fit: DataFrame, made: Fit, dim: int) -> float:
    """Largest entry of the fit list's covariance of whitened numbers less the identity, on components with variance.
    They are centred as they come, since n * x - S adds up to zero."""
    m = int(made.some.sum())
    if not m:
        return 0.0
    sent = fit.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        f, total = sent.value, np.zeros((m, m))
        for b in batches:
            x = _integers(b.column(0), dim)
            for a in range(0, len(x), ROWS):
                w = f.whitened(_centred(x[a : a + ROWS], f.n, f.sums, f.wide))[:, f.some]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(m)), pa.array([*total], pa.list_(pa.float64()))], ["i", "row"])

    found = fit.mapInArrow(lean(run), "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    worst = found.groupBy("i", "j").agg((F.sum("x") / made.n).alias("c")).agg(F.max(F.abs(F.col("c") - (F.col("i") == F.col("j")).cast("double")))).first()
    return float(worst[0])


def whitened(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each row of (vec_id,
    embedding) that takes part and each of the first 16 components, or of all if there are fewer.

    Null vectors and those with a null or non-finite component are dropped; zero vectors stay. A shorter vector than the
    longest counts as padded with zeros. Rows without an id stay; rows that repeat an id or a vector are rows of their own,
    while the fit counts equal vectors once. deviation is decimal(38,0). Equal eigenvalues leave their components' order to
    the decomposition; a component without variance has whitened 0.0 and doesn't count in identity_error, and explained is
    0.0 where nothing varies. Components of magnitude 2^56 or more, whose integers pass a long, raise an ArithmeticError.
    An empty table, or one without vectors, gives no rows.
    """
    spark, rows = vectors.sparkSession, _rows(vectors)
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(largest(F.col("v"))).alias("m")).first()
    typed = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not found["n"] or not found["d"]:
        return spark.createDataFrame([], typed)
    if (found["m"] or 0) >= 2.0**56:
        raise ArithmeticError(f"components of magnitude {found['m']} give integers beyond a long")
    dim = found["d"]
    fit = cut(_fit_list(rows, dim))
    n, sums, most = _sums(fit, dim)
    made = Fit(n, sums, most, _covariances(fit, n, sums, most, dim))
    error = _identity_error(fit, made, dim)
    sent = spark.sparkContext.broadcast(made)  # d * 16 numbers and d sums

    def run(batches):
        f = sent.value
        count = len(f.values)
        explained = f.values / f.trace if f.trace > 0 else np.zeros(count)
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                x = np.floor(SCALE * matrix(part.column(1), dim)).astype("int64") + SHIFT
                y = _centred(x, f.n, f.sums, f.wide)
                deviation = pa.array((y * y).sum(1).tolist(), pa.decimal128(38, 0))
                k = part.num_rows
                row = pa.array(np.repeat(np.arange(k), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row), pa.array(np.tile(np.arange(1, count + 1), k), "int32"), pa.array(np.full(k * count, f.n)), deviation.take(row),
                        pa.array(f.whitened(y).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * count, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(lean(run), typed)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitened() of embeddings: the same rules for nulls, repeats, ties and empties; a deviation beyond a long is null."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
