"""SimHash near-dedup: pigeonring filtering of 64-bit fingerprints, then connected components.

A document's shingles are its runs of three words, repeats included, and a bit of its fingerprint is set if over
half of their XXH64 hashes have it.

Join. The bits lie in ``most + 1`` segments on a ring. If two fingerprints differ in at most ``most`` bits,
there is a segment at which a chain starts that keeps every budget: its first s segments differ in at most
s * most / (most + 1) bits, which is s - 1, for each s up to the whole ring. So both have that first
segment in common and share the node (start, segment). Rows of a node are compared along the chain from its start,
segment by segment, and those beyond a budget go at once; what is left after the whole ring has passed the full
Hamming check.

A node of more than ``LIMIT`` fingerprints is parted by the next segments of the chain: the s-th differs in at
most s - 1 bits, so of s parts of it one is equal, and each part makes a node. No pair is lost, as
it keeps a common node at every level. What is still large after the last segment agrees in at least half of all bits;
it is compared whole, in pairs of blocks of bounded size, at the square of its own size.

Only a star for each group of linked rows leaves a task, never all pairs. Equal fingerprints are one node of the
graph, so copies cost nothing, and components come from alternating large and small stars as tables in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, partitions, table
from .near_dedup import components
from .textbatch import LOWER, U, lean, pieces, runs

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
MOST = 3
#: Fingerprints of a node that are compared exhaustively.
LIMIT = 1024
#: Hashes whose bits are counted together, in fields of 16 bits.
TOGETHER = (1 << 16) - 1
#: Linked pairs that a task holds before it contracts them.
HELD = 1 << 20
_FIELDS = U(0x0001000100010001)


def hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, piece by piece; fewer words than a shingle are one, no words none."""
    last: list[bytes] = []
    some = False
    for part in pieces(text):
        words = last + part.translate(LOWER).split()
        if len(words) >= SHINGLE:
            some = True
            joined = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)]))
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), "uint64", len(words) - SHINGLE + 1)
        last = words[-(SHINGLE - 1) :]
    if last and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], "uint64")


def ones(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each slice of h; slices begin at starts and are not empty."""
    out = np.empty((len(starts), 64), "int64")
    for s in range(16):
        total = np.add.reduceat(h >> U(s) & _FIELDS, starts)
        for q in range(4):
            out[:, 16 * q + s] = (total >> U(16 * q) & U(0xFFFF)).astype("int64")
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text; zero for texts without words."""
    counts, sizes = np.zeros((len(texts), 64), "int64"), np.zeros(len(texts), "int64")
    parts: list[np.ndarray] = []
    owner: list[int] = []

    def add() -> None:
        if parts:
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
            np.add.at(counts, owner, ones(np.concatenate(parts), starts))
            parts.clear(), owner.clear()

    for k, text in enumerate(texts):
        for h in hashes(text):
            sizes[k] += len(h)
            for i in range(0, len(h), TOGETHER):
                parts.append(h[i : i + TOGETHER]), owner.append(k)
            if len(h) > TOGETHER:
                add()
    add()
    bits = (2 * counts > sizes[:, None]).astype("uint8")
    return np.packbits(bits, 1, "little").view("<u8").ravel()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; null texts count as empty."""

    def run(batches):
        for b in batches:
            for i, j, texts in runs(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fingerprints(texts).view("int64"))], ["doc_id", "fp"])

    read = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(lean(run), "doc_id long, fp long")


def segments(most: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    at = [64 * k // (most + 1) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _first_nodes(fps: DataFrame, most: int) -> DataFrame:
    """node, start, fp: each fingerprint under each of its segments."""
    keys = [F.struct(F.xxhash64(F.lit(k), _bits(F.col("fp"), a, w)).alias("node"), F.lit(k).alias("start")) for k, (a, w) in enumerate(segments(most))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("_k")).select("_k.node", "_k.start", "fp")


def _parted(rows: DataFrame, s: int, most: int) -> DataFrame:
    """Nodes parted by the s-th segment of their chain, of whose s parts one must be equal."""
    ring, by_start = segments(most), []
    for start in range(most + 1):
        first, width = ring[(start + s - 1) % (most + 1)]
        at = [first + width * k // s for k in range(s + 1)]
        by_start.append(F.array(*[F.xxhash64("node", F.lit(s), F.lit(k), _bits(F.col("fp"), a, b - a)) for k, (a, b) in enumerate(zip(at, at[1:]))]))
    return rows.select(F.explode(F.get(F.array(*by_start), F.col("start"))).alias("node"), "start", "fp")


def _nodes(fps: DataFrame, most: int, limit: int) -> DataFrame:
    """node, start, fp: nodes of at most about limit rows such that any two linked fingerprints share one."""
    rows, done = _first_nodes(fps, most), None
    for s in range(2, most + 3):
        #: Written first, so that the joins can split a node that many rows have.
        large = cut(rows.groupBy("node").agg(F.count("*").alias("_n")).filter(F.col("_n") > limit))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, "node")
        if s <= most + 1:
            rows = cut(_parted(rows, s, most))
    return done.unionByName(_block_pairs(rows, limit))


def _block_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Crowds (node, start, fp, _n) in pairs of blocks, so that any two rows of a crowd share a group."""
    blocks = F.ceil(F.col("_n") * 2 / limit).cast("long")
    rows = rows.withColumn("_x", F.pmod(F.xxhash64("fp", F.lit(1)), blocks))
    rows = rows.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).filter("_x != _y")
    return rows.select(F.xxhash64("node", F.least("_x", "_y"), F.greatest("_x", "_y")).alias("node"), "start", "fp")


def chained(node: np.ndarray, start: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the linked pairs of each node; rows lie sorted by node. Each row meets the one after it, then the
    second after it, and so on until no node is as long."""
    masks = np.array([((1 << w) - 1) << a for a, w in segments(most)], "uint64")
    i, away = np.arange(len(node)), 0
    while len(i):
        away += 1
        i = i[i < len(node) - away]
        i = i[node[i] == node[i + away]]
        left, x, total = i, fp[i] ^ fp[i + away], np.zeros(len(i), "uint8")
        for s in range(1, most + 2):
            total = total + np.bitwise_count(x & masks[(start[left] + s - 1) % (most + 1)])
            keep = total < s
            left, x, total = left[keep], x[keep], total[keep]
        if len(left):
            yield left, left + away


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked value but the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for to in (label[a], label[b], a, b):
            np.minimum.at(new, to, low)
        new = new[new]
        if (new == label).all():
            keep = label < np.arange(len(ids))
            return ids[keep], ids[label[keep]]
        label = new


def _whole_nodes(batches) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, cut between its values only."""
    held = None
    for b in batches:
        new = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        now = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(now[0]):
            last = np.searchsorted(now[0], now[0][-1])
            yield [c[:last] for c in now]
            held = [c[last:] for c in now]
    if held is not None:
        yield held


def links(fps: DataFrame, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """u, v: links that join distinct fingerprints (fp) of at most most differing bits, a spanning star for each
    group of linked ones that met in a task."""

    def run(batches):
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def drain():
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            us.clear(), vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for node, start, fp in _whole_nodes(batches):
            for i, j in chained(node, start, fp.view("uint64"), most):
                us.append(fp[i]), vs.append(fp[j])
                if sum(map(len, us)) > HELD:
                    yield drain()
            if sum(map(len, us)) > HELD >> 4:
                yield drain()
        if us:
            yield drain()

    rows = _nodes(fps, most, limit).select("node", "start", "fp")
    return rows.repartition(partitions(fps.sparkSession), "node").sortWithinPartitions("node").mapInArrow(lean(run), "u long, v long")


def near_fingerprints(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs.

    Null and empty texts, and those without words, have fingerprint zero, which links like any other. Fewer than
    three words are one shingle. Rows that repeat an id are documents of their own: each has the
    fingerprint of its text. component_id is the smallest id that a row's fingerprint reaches by links, null if no row
    there has an id; ties can't arise. A text of any length is worked on in pieces. An empty table gives no rows.
    """
    rows = cut(fingerprinted(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(classes.select("fp"), most).distinct()).withColumnRenamed("u", "fp")
    named = cut(classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    named = cut(named.join(lows, "root").select("fp", "component_id"))
    #: Many rows have one fingerprint: a many-to-one join, whose large keys can be split.
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_fingerprints() of documents at 3 bits: the same rules for nulls, repeats and empties."""
    return near_fingerprints(table(spark, sf_dir, "documents"))
