"""Toxicity: a convolutional text classifier trained in numpy.

A word is its lower-cased letters between white space and punctuation; its embedding is the sum of
two rows of hashed tables, one for the word and one for its first bytes, so that unseen endings of a
known stem still count. Filters of widths 1 to 3 slide over the whole text, each filter's maximum is
kept, and a logistic layer reads the maxima. Training uses a bounded sample (see labelled.py), Adagrad,
and the positions of the maxima. Part of the sample is kept apart to calibrate the score, so that the
common threshold has the best balance there. Each language then has a threshold of its own from all
labelled rows of that part, sampled or not; a score never sees a language, and a language's threshold only adds a
column beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, labelled
from .common import cut, frugal, table
from .textbatch import PIECE, Sums, chunks, lean, pieces, runs, words

BUCKETS = 1 << 15
STEM = 5  # bytes
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
STEPS = 400  # at least, for small samples
MIN_TEXTS = 3
BATCH = 32
RATE = 0.1
PREDICT = 0.7
#: Thresholds of at most so many languages are broadcast.
MOST_LANGUAGES = 10_000
PAD = max(WIDTHS) - 1
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = bytes(32 if b in MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def encode(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, word rows and stem rows one after the other; row 0 is padding."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        w = words(texts[a:b], PLAIN)
        sums = Sums(w.data)
        word = sums.of(w.starts, w.ends) % np.uint64(BUCKETS - 1) + np.uint64(1)
        stem = sums.of(w.starts, np.minimum(w.ends, w.starts + STEM)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        for i, j in zip(w.bounds[:-1], w.bounds[1:]):
            out.append(np.stack([word[i:j], stem[i:j]]).astype("int32").ravel())
    return out


@dataclass
class Network:
    tables: np.ndarray  # 2, BUCKETS, SIZE
    filters: list[np.ndarray]  # for each width: width, SIZE, FILTERS
    shift: np.ndarray  # of each filter
    top: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    languages: dict[str, float] | None = None

    def maxima(self, ids: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Each text's maxima, and their positions in ids (2, n). Texts have PAD padding words at the
        end, and the last has twice as many; bounds has one more entry than there are texts."""
        emb = self.tables[0][ids[0]] + self.tables[1][ids[1]]
        best, at = [], []
        pad = (bounds[1:, None] - np.arange(1, PAD + 1)).ravel()
        for f in self.filters:
            n = len(emb) - len(f) + 1
            z = emb[:n] @ f[0]
            for j in range(1, len(f)):
                z += emb[j : j + n] @ f[j]
            #: Windows that start in padding count as padding alone: they would reach into the next text.
            z[pad] = 0
            top = np.maximum.reduceat(z, bounds[:-1])
            if where:
                first = np.stack([a + z[a:b].argmax(0) for a, b in zip(bounds[:-1], bounds[1:])])
                at.append(np.where(first >= bounds[1:, None] - PAD, ids.shape[1] - 2 * PAD, first))
            best.append(top)
        return np.concatenate(best, 1), at

    def tops(self, coded: list[np.ndarray], room: int = 1 << 17, ended: bool = True) -> np.ndarray:
        """Each text's maxima. Long texts are passed over in pieces, each with the first PAD words of the next one, whose
        windows count there; texts that haven't ended leave their last PAD words for a later call."""
        top = np.full((len(coded), len(self.shift)), -np.inf, "float32")
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush():
            nonlocal size
            if held:
                bounds = np.concatenate(([0], np.cumsum([h.shape[1] for h in held])))
                ids = np.concatenate([*held, np.zeros((2, PAD), "int32")], 1)
                np.maximum.at(top, owner, self.maxima(ids, bounds)[0])
            held.clear(), owner.clear()
            size = 0

        for i, c in enumerate(coded):
            c, a = c.reshape(2, -1), 0
            while a is not None:
                last = a + room + PAD >= c.shape[1]
                piece = c[:, a:] if last else c[:, a : a + room + PAD]
                held.append(np.concatenate([piece, np.zeros((2, PAD), "int32")], 1) if last and ended else piece)
                owner.append(i)
                size += held[-1].shape[1]
                a = None if last else a + room
                if size >= room:
                    flush()
        flush()
        return top

    def _margins(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.shift, 0) @ self.top + self.bias

    def margins(self, coded: list[np.ndarray], room: int = 1 << 17) -> np.ndarray:
        """Texts of any length."""
        return self._margins(self.tops(coded, room))

    def scores_of(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts, of which long ones are encoded a piece at a time."""
        top, short = np.full((len(texts), len(self.shift)), -np.inf, "float32"), [k for k, t in enumerate(texts) if len(t) <= PIECE]
        if short:
            top[short] = self.tops(encode([texts[k] for k in short]))
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                carry = np.zeros((2, 0), "int32")
                for part in pieces(t):
                    c = np.concatenate([carry, encode([part])[0].reshape(2, -1)], 1)
                    if c.shape[1] > PAD:
                        top[k] = np.maximum(top[k], self.tops([c], ended=False)[0])
                    carry = c[:, -PAD:]
                top[k] = np.maximum(top[k], self.tops([carry])[0])
        return self._squashed(self._margins(top))

    def scores(self, coded: list[np.ndarray]) -> np.ndarray:
        return self._squashed(self.margins(coded))

    def _squashed(self, margins: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(a * margins.astype("float64") + b, -40, 40)))


def train(coded: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.01, (2, BUCKETS, SIZE)).astype("float32")
    tables[:, 0] = 0
    known = _odds(coded, y)
    tables[:, :, 0] = 0.3 * known  # a start that already leans to the words of one class
    open_rows = (known != 0).astype("float32")[:, :, None]
    tables *= open_rows
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype("float32") for w in WIDTHS]
    net = Network(tables, filters, np.zeros(FILTERS * len(WIDTHS), "float32"), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype("float32"), 0.0)
    seen = [np.full_like(tables, 1e-4), [np.full_like(f, 1e-4) for f in filters], np.full_like(net.shift, 1e-4), np.full_like(net.top, 1e-4)]

    def step(p, g, h):
        h += g * g
        p -= RATE * g / np.sqrt(h)

    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(coded))))):
        order = rng.permutation(len(coded))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            texts = [np.concatenate([coded[i].reshape(2, -1), np.zeros((2, PAD), "int32")], 1) for i in pick]
            bounds = np.concatenate(([0], np.cumsum([t.shape[1] for t in texts])))
            ids = np.concatenate([*texts, np.zeros((2, PAD), "int32")], 1)
            top, at = net.maxima(ids, bounds, True)
            act = np.maximum(top + net.shift, 0)
            d = (1 / (1 + np.exp(-np.clip(act @ net.top + net.bias, -30, 30))) - y[pick]).astype("float32") / len(pick)
            g_top, back = act.T @ d, np.outer(d, net.top) * (act > 0)
            net.bias -= RATE * float(d.sum())
            for k, f in enumerate(net.filters):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                g_f = np.zeros_like(f)
                for j in range(len(f)):
                    rows = ids[:, at[k] + j]  # 2, texts, filters
                    emb = net.tables[0][rows[0]] + net.tables[1][rows[1]]
                    g_f[j] = np.einsum("bfs,bf->sf", emb, b)
                    g_e = (b[:, :, None] * f[j].T[None]).reshape(-1, SIZE)
                    for t in range(2):
                        flat = rows[t].ravel()
                        uniq, inverse = np.unique(flat, return_inverse=True)
                        g = np.zeros((len(uniq), SIZE), "float32")
                        np.add.at(g, inverse, g_e)
                        g *= open_rows[t][uniq]
                        seen[0][t][uniq] += g * g
                        net.tables[t][uniq] -= RATE * g / np.sqrt(seen[0][t][uniq])
                step(f, g_f, seen[1][k])
            step(net.shift, back.sum(0), seen[2])
            step(net.top, g_top, seen[3])
    return net


def _odds(coded: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For both tables, each row's log odds of standing in a toxic text; 0, which closes the row to
    training, for padding and for rows that fewer than MIN_TEXTS texts have: they can only be learnt
    by heart."""
    seen = np.zeros((2, 2, BUCKETS))
    for c, label in zip(coded, y):
        for t, rows in enumerate(c.reshape(2, -1)):
            seen[int(label), t, np.unique(rows)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None, None]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen.sum(0) < MIN_TEXTS] = 0
    odds[:, 0] = 0
    return odds.astype("float32")


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """With no labels, or labels of one class only, the score is that of a network without weights:
    0.5, or 0 or 1 as all labels say."""
    coded, grade, counts, apart = labelled.sample(docs, labels, F.col("toxic"), 2, encode)
    if len(set(grade.tolist())) < 2:
        zero = np.zeros(FILTERS * len(WIDTHS), "float32")
        blank = Network(np.zeros((2, BUCKETS, SIZE), "float32"), [np.zeros((w, SIZE, FILTERS), "float32") for w in WIDTHS], zero, zero, 0.0)
        blank.scale = (1.0, 0.0 if not len(grade) else 40.0 * (2 * int(grade[0]) - 1))
        return blank
    return finish(coded, grade.astype("float64"), counts, apart)


def finish(coded: list[np.ndarray], y: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> Network:
    """Trains on the texts that are not kept apart and calibrates on those that are."""
    if keep.all() or len(set(y[~keep])) < 2:
        keep = np.zeros(len(coded), bool)
    net = train([c for c, k in zip(coded, keep) if not k], y[~keep])
    margin = net.margins([c for c, k in zip(coded, keep) if k]).astype("float64") if keep.any() else np.zeros(0)
    a = max(0.5, boosting.platt(margin, y[keep])[0]) if len(set(y[keep])) == 2 else 1.0
    #: The margin with the best F1 on the part kept apart, at the labels' true shares, scores PREDICT.
    share = np.where(y[keep] == 1, counts[1] / max(1.0, y[keep].sum()), counts[0] / max(1.0, (1 - y[keep]).sum()))
    net.scale = (a, float(np.log(PREDICT / (1 - PREDICT)) - a * best_cut(margin, y[keep], share)))
    return net


def best_cut(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between neighbouring margins at which F1 is best; 0 with one class only."""
    if len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(-margin, kind="stable")
    m, hit, said = margin[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (said + (weight * y).sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    k = int(f1.argmax())
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k] - 1)


def language_thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """lang and lang_threshold: the least score, in steps of 0.05, at which the labelled rows that are kept
    apart from training have their best F1 in that language. Aggregates only."""
    id_ = F.col("doc_id").cast("long")
    known = labels.filter(~labelled.held_out(id_) & labelled.kept_apart(id_)).groupBy(F.col("doc_id").cast("long")).agg(F.min("toxic").alias("_y"))
    cells = scored.join(known.dropna(), "doc_id").groupBy("lang", F.floor(F.col("score") * 20).cast("int").alias("_cell"))
    cells = cells.agg(F.sum(F.col("_y").cast("long")).alias("_hits"), F.count("*").alias("_n"))
    grid = F.explode(F.sequence(F.lit(2), F.lit(19))).alias("_step")
    tried = cells.select("*", grid).groupBy("lang", "_step").agg(
        F.sum(F.when(F.col("_cell") >= F.col("_step"), F.col("_hits")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_cell") >= F.col("_step"), F.col("_n")).otherwise(0)).alias("said"),
        F.sum("_hits").alias("true"),
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("true")), F.lit(0.0))
    near = -F.abs(F.col("_step") - F.lit(int(PREDICT * 20)))  # among equals, nearest to the common threshold
    return tried.groupBy("lang").agg((F.max(F.struct(f1, near, "_step"))["_step"] / 20.0).alias("lang_threshold"))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang, held_out, score and predicted of each row of docs. A null text counts as empty
    and gets the score of padding alone; a null id is not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # about 2 MB, whatever the input

    def run(batches):
        for b in batches:
            for i, j, texts in runs(b.column(2)):
                s = sent.value.scores_of(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s, "float64")], ["doc_id", "lang", "score"])

    read = frugal(docs).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("binary").alias("text"))
    scored = read.mapInArrow(lean(run), "doc_id long, lang string, score double")
    return scored.select(
        "doc_id",
        "lang",
        F.coalesce(labelled.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, as score() has it, and its language's threshold: that of all, if it has none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = cut(score(docs, fit(docs, labels)))
    by_lang = cut(language_thresholds(scored, labels).withColumnRenamed("lang", "_lang"))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= MOST_LANGUAGES else by_lang
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    mark = F.coalesce("lang_threshold", F.lit(PREDICT))
    return joined.select(
        "doc_id", "held_out", "score", "predicted", mark.alias("lang_threshold"), F.when(F.col("score") >= mark, 1).otherwise(0).alias("lang_flag")
    )
