"""Bounded samples of labelled documents for the two text classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .textbatch import lean, runs

#: Documented bounds of a training sample: rows of each grade, and bytes of a text.
ROWS_PER_GRADE = 2000
LONGEST = 16_384


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def kept_apart(doc_id: Column) -> Column:
    """A quarter of the rows that may be learnt from: calibrated on, not trained on."""
    return F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 3) % 4 == 3


def sample(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, encode: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Encoded texts, grades, each grade's number of labelled rows, and which texts are kept_apart(): at most ROWS_PER_GRADE rows
    of each, in hash order of the id. Texts over LONGEST bytes, null ids, null grades and held-out
    rows are not sampled. An id with several labels takes the lowest grade, one with several texts the
    first of them."""
    graded = labels.select(F.col("doc_id").cast("long"), grade.cast("int").alias("_grade"))
    graded = graded.filter(~held_out(F.col("doc_id"))).dropna().groupBy("doc_id").agg(F.min("_grade").alias("_grade"))
    counts = {r["_grade"]: r["count"] for r in graded.groupBy("_grade").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for g in range(grades):
        part = graded.filter(F.col("_grade") == g).orderBy(*order).limit(ROWS_PER_GRADE)
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.collect()
    if not rows:
        return [], np.zeros(0, "int64"), np.array([counts.get(g, 0) for g in range(grades)]), np.zeros(0, bool)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(pa.table({"doc_id": [r["doc_id"] for r in rows], "_grade": [r["_grade"] for r in rows]}))
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(F.octet_length("text") <= LONGEST)
    texts = texts.join(F.broadcast(wanted), "doc_id")  # a few thousand rows at most
    texts = texts.groupBy("doc_id", "_grade").agg(F.min("text").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for i, j, part in runs(b.column(1)):
                codes = pa.array([c.tobytes() for c in encode(part)], "binary")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), codes], ["doc_id", "_grade", "_code"])

    got = frugal(texts).select("doc_id", "text", F.col("_grade").cast("int")).mapInArrow(lean(run), "doc_id long, _grade int, _code binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["_code"])))
    return (
        [np.frombuffer(r["_code"], "int32") for r in got],
        np.array([r["_grade"] for r in got]),
        np.array([counts.get(g, 0) for g in range(grades)]),
        np.array([zlib.crc32(str(r["doc_id"]).encode()) // 3 % 4 == 3 for r in got]),
    )
