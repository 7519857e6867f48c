"""Quality: ordinal cumulative-link regression on graded ratings.

A text's features are hashed: its words, the shapes of its words (which of letters, capitals, digits
and marks stand first and last) and whether a word repeats its predecessor; their weights are shared by
all grades. With the text's score s, the mean weight of its features, and ordered thresholds
t1 < t2 < ..., P(grade >= k) = sigmoid(s - tk). The result gives the expected grade and the tail
probability on which documents are selected.

Grades come from the labels: 0 for low quality, 1 for good quality that is toxic, 2 for good quality
that is not. Training uses a bounded sample (see labelled.py); scoring passes over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import labelled
from .common import frugal, table
from .textbatch import LOWER, PIECE, Sums, chunks, lean, pieces, runs, words

BUCKETS = 1 << 16
GRADES = 3
STEPS = 150
RATE = 0.3
DECAY = 1e-4
MIN_TEXTS = 3
#: A document is kept if P(grade >= 1) is at least this.
KEEP = 0.5

#: Letters, capitals, digits; other ASCII marks stand for themselves, bytes above 127 are letters.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 57 if 48 <= b <= 57 else b for b in range(256))


def encode(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the buckets of its words' features: words, then shapes, then repeats."""
    out: list[np.ndarray] = []
    n = np.uint64(BUCKETS - 1)
    for a, b in chunks(texts):
        w = words(texts[a:b])
        lower = np.frombuffer(w.data.tobytes().translate(LOWER), "uint8")
        shape = np.frombuffer(w.data.tobytes().translate(SHAPE), "uint8")
        word = Sums(lower).of(w.starts, w.ends)
        size = np.minimum(w.ends - w.starts, 12)
        forms = np.stack([shape[w.starts], shape[np.minimum(w.starts + 1, w.ends - 1)], shape[np.maximum(w.ends - 2, w.starts)], shape[w.ends - 1], (size > 1).astype("uint8")], 1)
        form = Sums(np.ascontiguousarray(forms).ravel(), 1).of(np.arange(len(size)) * 5, np.arange(1, len(size) + 1) * 5) if len(size) else word
        again = np.zeros(len(size), "uint64")
        again[1:] = word[1:] == word[:-1]
        again[w.bounds[:-1][w.bounds[:-1] < len(size)]] = 0
        rows = np.stack([word % n, form % n, again * n]).astype("int32") if len(size) else np.zeros((3, 0), "int32")
        out += [np.ascontiguousarray(rows[:, i:j]).ravel() for i, j in zip(w.bounds[:-1], w.bounds[1:])]
    return out


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray  # ordered thresholds

    def raw(self, coded: list[np.ndarray]) -> np.ndarray:
        """The mean weight of each text's features, times three; texts without words get 0."""
        sizes = np.array([len(c) for c in coded], "int64")
        if not sizes.sum():
            return np.zeros(len(coded))
        flat = self.weights[np.concatenate(coded)]
        sums = np.concatenate(([0.0], np.cumsum(flat)))
        ends = np.cumsum(sizes)
        return 3.0 * (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)

    def tails(self, coded: list[np.ndarray]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text."""
        return _sigmoid(self.raw(coded)[:, None] - self.cuts)

    def tails_of(self, texts: list[bytes]) -> np.ndarray:
        """The same of whole texts, of which long ones are encoded a piece at a time."""
        raw, short = np.zeros(len(texts)), [k for k, t in enumerate(texts) if len(t) <= PIECE]
        raw[short] = self.raw(encode([texts[k] for k in short]))
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                total, n, before = 0.0, 0, b""
                for part in pieces(t):
                    coded = encode([part])[0]
                    total, n = total + float(self.weights[coded].sum()), n + len(coded)
                    first = part.split(None, 1)[:1]
                    if first and first[0].translate(LOWER) == before:  # the first word of a piece repeats the one before it
                        total += float(self.weights[BUCKETS - 1] - self.weights[0])
                    before = part.rsplit(None, 1)[-1].translate(LOWER) if first else before
                raw[k] = 3.0 * total / max(1, n)
        return _sigmoid(raw[:, None] - self.cuts)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(coded: list[np.ndarray], grade: np.ndarray, counts: np.ndarray) -> Ordinal:
    """Full-batch Adagrad on the likelihood, weighted back to the labels' shares of the grades."""
    share = counts / max(1, counts.sum())
    drawn = np.bincount(grade, minlength=GRADES) / max(1, len(grade))
    weight = (share / np.maximum(drawn, 1e-9))[grade]
    #: Each text's distinct features and their share of it.
    each = [np.unique(c, return_counts=True) for c in coded]
    row = np.repeat(np.arange(len(coded), dtype="int32"), [len(k) for k, _ in each])
    column = np.concatenate([k for k, _ in each])
    value = np.concatenate([3.0 * n / max(1, len(c)) for (_, n), c in zip(each, coded)])
    del each
    known = np.bincount(column, minlength=BUCKETS) >= MIN_TEXTS
    row, column, value = row[known[column]], column[known[column]], value[known[column]]
    tail = np.array([share[k:].sum() for k in range(1, GRADES)])
    cuts = np.sort(-np.log(np.clip(tail, 1e-3, 1 - 1e-3) / np.clip(1 - tail, 1e-3, 1 - 1e-3)) + 1e-3 * np.arange(GRADES - 1))
    model, w, seen, seen_cuts = Ordinal(np.zeros(BUCKETS), cuts), np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), np.full(GRADES - 1, 1e-8)
    rows = np.arange(len(coded))
    total = weight.sum()
    for _ in range(STEPS):
        s = np.bincount(row, value * w[column], len(coded))
        above = np.concatenate([np.ones((len(s), 1)), _sigmoid(s[:, None] - cuts), np.zeros((len(s), 1))], 1)
        upper, lower = above[rows, grade], above[rows, grade + 1]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        g_s = -weight * (du - dl) / p / total
        g = np.bincount(column, value * g_s[row], BUCKETS) + DECAY * w
        g_cuts = np.array([((grade == k + 1) * weight * du / p).sum() - ((grade == k) * weight * dl / p).sum() for k in range(GRADES - 1)]) / total
        seen += g * g
        seen_cuts += g_cuts * g_cuts
        w = w - RATE * g / np.sqrt(seen) * (np.abs(g) > 0)
        cuts = np.maximum.accumulate(cuts - 0.1 * g_cuts / np.sqrt(seen_cuts) + 1e-6 * np.arange(GRADES - 1))
    model.weights, model.cuts = w, cuts
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """With no labels, or one grade only, nothing is rejected."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull(), F.when(F.col("toxic") == 1, 1).otherwise(2))
    coded, y, counts, _ = labelled.sample(docs, labels, grade, GRADES, encode)
    if len(set(y.tolist())) < 2 or not sum(map(len, coded)):
        return Ordinal(np.zeros(BUCKETS), np.array([-3.0, -2.0]))
    return train(coded, y, counts)


def _tails(rows: DataFrame, model: Ordinal, text: int | None) -> DataFrame:
    """_whole, expected and tail of (_whole, text), or of (_whole) alone whose field number text has the text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # half a MB, whatever the input

    def run(batches):
        for b in batches:
            column = b.column(1) if text is None else pc.struct_field(b.column(0), [text])
            for i, j, texts in runs(column):
                tails = sent.value.tails_of(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(tails.sum(1)), pa.array(tails[:, 0])], ["_whole", "expected", "tail"])

    out = StructType([StructField("_whole", rows.schema["_whole"].dataType), StructField("expected", DoubleType()), StructField("tail", DoubleType())])
    return frugal(rows).mapInArrow(lean(run), out)


def _held(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Whole rows travel as one column, so that no name of docs can clash."""
    at = [c.lower() for c in docs.columns].index("text")
    return _tails(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_whole")), model, at)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with expected_grade, tail_probability, P(grade >= 1), and keep. A null or empty text has
    no features and gets the grades' shares: it is kept unless low grades are the majority of the labels.
    All columns of docs stay; three names are added, which replace columns of the same names. Repeated
    rows stay, and an empty table gives no rows."""
    added = {"expected_grade": F.col("expected"), "tail_probability": F.col("tail"), "keep": F.col("tail") >= KEEP}
    return _held(docs, model).select(*[F.col("_whole")[c].alias(c) for c in docs.columns if c not in added], *[v.alias(n) for n, v in added.items()])


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns; nulls, empties, repeats and empty tables as in score()."""
    return _held(docs, fit(docs, labels)).filter(F.col("tail") >= KEEP).select("_whole.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and whether it is kept; nulls, empties, repeats and empty tables as in score()."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = _tails(docs.select(F.struct("doc_id").alias("_whole"), "text"), fit(docs, labels), None)
    return scored.select("_whole.doc_id", F.col("expected").alias("expected_grade"), F.col("tail").alias("tail_probability"), (F.col("tail") >= KEEP).alias("keep"))
