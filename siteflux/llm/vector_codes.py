"""Vector code compression: product codes of integer vectors, assigned by partial-distance search.

Each component becomes the integer floor(1024 * x), and vectors are cut into ``PARTS`` parts of equal width. Every part
position has a codebook of ``ENTRIES`` entries, which starts as that part of the vectors with the smallest ids and takes
``ROUNDS`` rounds: parts go to their nearest entry, and entries become the floored mean of their parts.

Nearest entries are searched by partial distances. Dimensions are taken in descending variance of the codebook,
as those part the entries most. After a first block of them the entry that leads is
measured whole, which bounds the search; then a dimension at a time is added to the entries still in
the race, and those whose sum strictly exceeds the best whole distance are dropped, all by masks over a batch of parts.
What survives the last dimension has its whole distance, so the result is exact: ties go to the lower index, since
an entry that only equals the bound stays. All numbers are integers.

Codebooks are broadcast: 4 * 256 entries, whatever the table holds. Tasks add up sums and counts of what they
assign, and Spark merges those by entry; no vector leaves its task before the final assignment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import finite, largest, matrix
from .common import cut, frugal, table
from .textbatch import lean

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Dimensions taken before the first whole distance, and parts that are searched together.
FIRST, TOGETHER = 4, 2048


def nearest(x: np.ndarray, book: np.ndarray, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of book for each row of x; ties to the lower index."""
    dim = book.shape[1]
    order = np.argsort(-book.astype("float64").var(0), kind="stable")
    index, error = np.zeros(len(x), "int64"), np.zeros(len(x), "int64")
    for a in range(0, len(x), TOGETHER):
        part = x[a : a + TOGETHER]
        sums = np.zeros((len(part), len(book)), "int64")
        for k in order[:first]:
            sums += (part[:, k, None] - book[None, :, k]) ** 2
        best = ((part - book[sums.argmin(1)]) ** 2).sum(1)
        row, entry = np.nonzero(sums <= best[:, None])
        total = sums[row, entry]
        for n, k in enumerate(order[first:], first + 1):
            total = total + (part[row, k] - book[entry, k]) ** 2
            keep = total <= best[row]
            row, entry, total = row[keep], entry[keep], total[keep]
            if n < dim and 2 * n >= dim and 2 * (n - 1) < dim and len(row):  # half way the leaders are measured whole, too
                lead = _leaders(row, total)
                whole = ((part[row[lead]] - book[entry[lead]]) ** 2).sum(1)
                best[row[lead]] = np.minimum(best[row[lead]], whole)
                keep = total <= best[row]
                row, entry, total = row[keep], entry[keep], total[keep]
        lead = _leaders(row, total)
        index[a : a + len(part)], error[a : a + len(part)] = entry[lead], total[lead]
    return index, error


def _leaders(row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Place of each row's smallest total, the first of equal ones; rows are sorted and their entries rise."""
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    low = np.repeat(np.minimum.reduceat(total, starts), np.diff(np.append(starts, len(row))))
    at = np.flatnonzero(total == low)
    return at[np.flatnonzero(np.concatenate(([True], row[at][1:] != row[at][:-1])))]


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype("int64")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all decimal components by part, entry and place within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _bounds(rows: DataFrame) -> tuple[int, int]:
    """The longest vector, up to a multiple of PARTS, and the number of rows. Magnitudes must leave room for sums of squares."""
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(largest(F.col("v"))).alias("m")).first()
    dim = -(-(found["d"] or 0) // PARTS) * PARTS
    if dim * (2 * SCALE * (found["m"] or 0) + 2) ** 2 >= 1 << 63:
        raise ArithmeticError(f"components of magnitude {found['m']} give squared distances beyond a long")
    return dim, found["n"]


def _assigned(rows: DataFrame, books, dim: int) -> DataFrame:
    """Partial sums (part, entry, count, sums) of each task under the codebooks, a broadcast array."""

    def run(batches):
        width = dim // PARTS
        count, sums = np.zeros((PARTS, ENTRIES), "int64"), np.zeros((PARTS, ENTRIES, width), "int64")
        for b in batches:
            x = integers(matrix(b.column(0), dim))
            for p in range(PARTS):
                part = x[:, p * width : (p + 1) * width]
                index, _ = nearest(part, books.value[p])
                count[p] += np.bincount(index, minlength=ENTRIES)
                np.add.at(sums[p], index, part)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array([*sums[p, e]], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return rows.select("v").mapInArrow(lean(run), "part long, entry long, n long, sums array<long>")


def trained(rows: DataFrame, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, place) of rows (vec_id, v)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow()
    start = integers(matrix(first.column(0).combine_chunks(), dim))
    books = np.ascontiguousarray(start.reshape(len(start), PARTS, dim // PARTS).swapaxes(0, 1))
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)
        sums = _assigned(rows, sent, dim).select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        #: At most PARTS * ENTRIES rows, whatever the table holds.
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = sums.groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("at", "n", "x"))).alias("c")).collect()
        books = books.copy()
        for r in new:
            books[r["part"], r["entry"]] = [c["x"] // c["n"] for c in r["c"]]
        sent.unpersist()
    return books


def compressed(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of (vec_id, embedding, label) whose vector has
    finite components only.

    Null vectors and those with a null or non-finite component are dropped; zero vectors stay. A shorter vector than the
    longest counts as padded with zeros, as does a dimension that isn't a multiple of four. Rows without an id stay and
    come last among the smallest ids; rows that repeat an id are rows of their own, in the order of their vectors. Fewer
    than 256 rows make smaller codebooks. Null labels are one label. Components so large that a squared distance
    passes a long raise an ArithmeticError. An empty table, or one without vectors, gives no rows.
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = frugal(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    rows = rows.filter(finite(F.col("v")))
    dim, n = _bounds(rows)
    typed = f"vec_id long, code string, error long, label {dict(rows.dtypes)['label']}"
    if not n:
        empty = vectors.sparkSession.createDataFrame([], typed)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(rows, dim) if dim else np.zeros((PARTS, 1, 0), "int64")
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        width = dim // PARTS
        for b in batches:
            x, error, codes = integers(matrix(b.column(2), dim)), np.zeros(b.num_rows, "int64"), np.zeros((b.num_rows, PARTS), "uint8")
            for p in range(PARTS if dim else 0):
                codes[:, p], part = nearest(x[:, p * width : (p + 1) * width], sent.value[p])
                error += part
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes().hex() for c in codes]), pa.array(error), b.column(1)], ["vec_id", "code", "error", "label"])

    coded = cut(rows.select("vec_id", "label", "v").mapInArrow(lean(run), typed))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    #: Many rows have one label: a many-to-one join, whose large keys can be split.
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: Distance, ties and floored means as above, a round at a time.
_ROUND = """
a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, p.x, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS error FROM (
  SELECT p.vec_id, part, p.x, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.c[i]) * (p.x[i] - c.c[i])))::BIGINT AS d FROM parts p JOIN b{k} c USING (part)) p GROUP BY p.vec_id, p.part, p.x)"""
_MEAN = """
m{k} AS (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL),
b{j} AS MATERIALIZED (SELECT part, entry, coalesce(n.c, o.c) AS c FROM b{k} o LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY ALL) n USING (part, entry))"""
ORACLE_SQL = (
    "WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
    " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),\n"
    "parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) r(p)),\n"
    "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts QUALIFY entry < 256),"
    + ",".join((_ROUND.format(k=k) + "," + _MEAN.format(k=k, j=k + 1)) for k in range(ROUNDS))
    + ","
    + _ROUND.format(k=ROUNDS)
    + f""",
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), books"""
)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compressed() of embeddings: the same rules for nulls, repeats, ties and empties."""
    return compressed(table(spark, sf_dir, "embeddings"))
