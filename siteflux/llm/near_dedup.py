"""MinHash near-dedup: chosen-path set similarity join, then connected components.

A document's set are the hashes of its distinct runs of five words. Equal sets form a class, and one
member, the smallest id, goes on. Its signature has a minimum for each of ``SLOTS`` hash functions.

Join. Each of ``TREES`` trees chooses ``ROOTS`` slots, and documents with the same token there
share a node. A node with more than ``LIMIT`` documents branches by one or two further slots that its own name
chooses, so that documents part as their tokens differ; smaller ones are leaves and are compared
exhaustively. Two documents of similarity s share a first node of a tree with 1 - (1 - s)^2 and stay
together in a branching node with about s + (1 - s) s / 2; with eight trees a pair at 0.8 misses all
first nodes with 3e-6. What is still large at the last level is a crowd: it is cut into blocks of
a leaf's size, all of which also get the same few pivots. That joins a dense crowd. Where a crowd's members
are not one component after that, those outside of its largest one meet all others of the crowd on full
sets, in pairs of bounded blocks: exact, at a cost of their number times the crowd's size.

A leaf is compared twice: signatures part it into groups and drop those without a partner (at an
estimate 0.25 below the threshold, over five standard errors), and groups that several leaves have in
common are kept once; then the full sets of a group's members meet and links are confirmed exactly.
Only a spanning star of each linked group leaves the task, never all its pairs.

Links join into components by alternating large and small stars, as tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_PER_FILE, cut, frugal, partitions, table, word_count
from .textbatch import LOWER, Sums, U, lean, mix, runs, text_bytes, word_hashes
from .url_filter import blocked_bloom

SHINGLE = 5
#: Links need 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
TREES, ROOTS = 8, 2
DEPTH, CHOICES = 5, 16
SLOTS = TREES * ROOTS + DEPTH * CHOICES
LIMIT = 256
PIVOTS = 8
#: Crowds in which a document meets pivots.
HOMES = 4
#: Bounds of a block whose full sets meet those of another: documents, and elements of their sets.
BLOCK, ELEMENTS = 512, 500_000
#: At most so many ids are broadcast: 8 MB.
BROADCAST_IDS = 1 << 20
#: A leaf's first look uses BITS of each token, and an estimate that is SLACK below the threshold.
BITS = 2
SLACK = 0.25

#: One odd factor and one term for each slot.
_FACTORS = mix(np.arange(1, SLOTS + 1, dtype="uint64")) | U(1)
_TERMS = mix(np.arange(1001, SLOTS + 1001, dtype="uint64"))


def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets one after the other, each sorted, and their bounds. Fewer words than a shingle
    make one element of the whole sequence; no words make none."""
    hashes, words_of = word_hashes(texts, LOWER)
    sizes = np.diff(words_of)
    starts = np.arange(len(hashes))
    starts = starts[starts + SHINGLE <= np.repeat(words_of[1:], sizes)]
    few = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    sums = Sums(hashes)
    h = np.concatenate([sums.of(starts, starts + SHINGLE), sums.of(words_of[few], words_of[few + 1])])
    doc = np.concatenate([np.searchsorted(words_of, starts, "right") - 1, few]).astype("int32")
    del starts, hashes, sums
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SLOTS minima of each set; empty sets have zeros."""
    out = np.zeros((len(bounds) - 1, SLOTS), "<u4")
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(SLOTS):
                tokens = ((h * _FACTORS[k] + _TERMS[k]) >> U(32)).astype("<u4")
                out[full, k] = np.minimum.reduceat(tokens, bounds[full])
    return out


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, n, (a, b) which name the set, sig, and the lowest bits of its tokens."""

    def run(batches):
        for batch in batches:
            for i, j, texts in runs(batch.column(1)):
                h, bounds = sets(texts)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                a, b = np.zeros(j - i, "uint64"), np.zeros(j - i, "uint64")
                with np.errstate(over="ignore"):
                    a[full] = np.add.reduceat(mix(h), bounds[full]) if len(full) else 0
                    b[full] = np.bitwise_xor.reduceat(mix(h ^ U(0x5555555555555555)), bounds[full]) if len(full) else 0
                tokens = signatures(h, bounds)
                sig = [s.tobytes() for s in tokens]
                low = (tokens[:, :, None] >> np.arange(BITS, dtype="uint32") & 1).astype("uint8").reshape(j - i, -1)
                bits = [s.tobytes() for s in np.packbits(low, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, "int64"), pa.array(a.view("int64")), pa.array(b.view("int64")), pa.array(sig, "binary"), pa.array(bits, "binary")],
                    ["doc_id", "n", "a", "b", "sig", "bits"],
                )

    return docs.mapInArrow(lean(run), "doc_id long, n long, a long, b long, sig binary, bits binary")


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(text_bytes(column)), "<u4").reshape(-1, SLOTS)


def _roots(reps: DataFrame) -> DataFrame:
    """node, rep, bits: each tree's first nodes."""

    def run(batches):
        for b in batches:
            sig = _sig_matrix(b.column(1)).astype("uint64")
            k = TREES * ROOTS
            with np.errstate(over="ignore"):
                node = mix(sig[:, :k] + (np.arange(1, k + 1, dtype="uint64") << U(40)))
            rep = np.repeat(b.column(0).to_numpy(zero_copy_only=False), k)
            bits = b.column(2).take(pa.array(np.repeat(np.arange(len(sig)), k)))
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view("int64")), pa.array(rep), bits], ["node", "rep", "bits"])

    return reps.select("rep", "sig", "bits").mapInArrow(run, "node long, rep long, bits binary")


def _branch(docs: DataFrame, level: int, percent: int) -> DataFrame:
    """node, rep, bits of the children of (rep, nodes, tokens of the level, bits): 100 / percent for each
    node on average."""
    twice = U(int((1 << 16) * (100 / percent - 1)))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(1).flatten().to_numpy(zero_copy_only=False).view("uint64")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            tokens = np.frombuffer(b"".join(text_bytes(b.column(2))), "<u4").reshape(-1, CHOICES)
            h = mix(node ^ U(level))
            first = (h % U(CHOICES)).astype("int64")
            second = (first + 1 + ((h >> U(20)) % U(CHOICES - 1)).astype("int64")) % CHOICES
            two = h >> U(48) < twice
            out_n, out_r = [], []
            for choice, on in ((first, np.ones(len(h), bool)), (second, two)):
                token = tokens[row[on], choice[on]].astype("uint64")
                with np.errstate(over="ignore"):
                    out_n.append(mix(mix(node[on] + choice[on].astype("uint64")) ^ token))
                out_r.append(row[on])
            at = pa.array(np.concatenate(out_r))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_n).view("int64")), b.column(0).take(at), b.column(3).take(at)], ["node", "rep", "bits"])

    return docs.select("rep", "nodes", "tokens", "bits").mapInArrow(run, "node long, rep long, bits binary")


def _leaves(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """leaf, rep, bits: leaves with two documents or more; and node, rep of the crowds, if there are any. The
    few bytes for a leaf's first look travel down the tree, which spares a join of all leaves. From level
    to level a document is one row with all of its large nodes, so its tokens are joined once."""
    most = reps.count() * TREES * ROOTS
    rows, leaves = _roots(reps), None
    for level in range(1, DEPTH + 2):
        #: Written first, so that the join can split a node that many rows have.
        counts = cut(rows.groupBy("node").agg(F.count("*").alias("_n")).filter("_n > 1"), most)
        rows = cut(rows.join(counts, "node"), most)
        done = rows.filter(F.col("_n") <= LIMIT).select(F.col("node").alias("leaf"), "rep", "bits")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = rows.filter(F.col("_n") > LIMIT)
        n = large.count()
        if not n:
            return leaves, None
        if level <= DEPTH:
            start, most = 4 * (TREES * ROOTS + (level - 1) * CHOICES), 2 * n
            tokens = reps.select("rep", F.substring("sig", start + 1, 4 * CHOICES).alias("tokens"), "bits")
            nodes = large.groupBy("rep").agg(F.collect_list("node").alias("nodes"))
            rows = cut(_branch(nodes.join(tokens, "rep"), level, percent), most)
    return leaves.unionByName(_crowds(large)), large.select("node", "rep")


def _crowds(large: DataFrame) -> DataFrame:
    """Blocks of (node, rep, bits, _n), each with the node's pivots. A document goes to the HOMES largest of
    its crowds; all of them count in _across()."""
    homes = large.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("_n", "node")), False), 1, HOMES).alias("_h"), F.first("bits").alias("bits"))
    large = homes.select("rep", "bits", F.explode("_h").alias("_h")).select("rep", "bits", "_h.node", "_h._n")
    blocks = F.ceil(F.col("_n") / (LIMIT // 2)).cast("long")
    own = large.select(F.xxhash64("node", F.pmod(F.xxhash64("node", "rep"), blocks)).alias("leaf"), "rep", "bits")
    pick = F.pmod(F.xxhash64("rep", "node"), F.lit(PIVOTS))
    pivots = large.groupBy("node", pick.alias("_k")).agg(F.min(F.struct(F.xxhash64("rep", F.lit(1), "node").alias("h"), "rep", "bits")).alias("_p"), F.max(blocks).alias("_b"))
    spread = pivots.select("node", "_p.rep", "_p.bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_k"))
    return own.unionByName(spread.select(F.xxhash64("node", "_k").alias("leaf"), "rep", "bits")).distinct()


def _across(crowds: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """leaf, rep: pairs of blocks for each crowd (node, rep) that is more than one component. Two documents
    of a crowd share a leaf unless both are in its largest component. Crowds of which one component is the
    greater part go together, as its documents are mostly the same."""
    known = reps.select("rep", "n").join(roots.withColumnRenamed("u", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("part"))
    rows = cut(_once(crowds.withColumnRenamed("node", "leaf")).withColumnRenamed("leaf", "node").join(known, "rep"))
    whole = rows.groupBy("node", "part").agg(F.count("*").alias("m")).groupBy("node").agg(F.max(F.struct("m", "part")).alias("_t"), F.sum("m").alias("m"))
    whole = whole.filter("m > _t.m").select("node", F.col("_t.part").alias("top"), F.when(F.expr("2 * _t.m <= m"), F.col("node")).alias("own"))
    rows = cut(rows.join(cut(whole), "node").select(F.xxhash64("top", "own").alias("crowd"), "rep", "n", (F.col("part") == F.col("top")).alias("main")).distinct())
    blocks = lambda on: F.ceil(F.greatest(F.count_if(on) / BLOCK, F.sum(F.when(on, F.col("n")).otherwise(0)) / ELEMENTS)).cast("long")
    sizes = rows.groupBy("crowd").agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains"))
    rows = rows.join(cut(sizes), "crowd").withColumn("h", F.xxhash64("rep", F.lit(2)))
    x = F.when(F.col("main"), F.col("others") + F.pmod("h", "mains")).otherwise(F.pmod("h", "others"))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    pairs = rows.select("crowd", "rep", x.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("y")).filter("x != y")
    return pairs.select(F.xxhash64("crowd", F.least("x", "y"), F.greatest("x", "y")).alias("leaf"), "rep")


def _once(rows: DataFrame) -> DataFrame:
    """The rows of one leaf only out of those with the same members."""
    marks = rows.groupBy("leaf").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("rep").alias("r")
    )
    first = marks.filter("n > 1").groupBy("n", "x", "y", "r").agg(F.min("leaf").alias("leaf"))
    return rows.join(cut(first.select("leaf")), "leaf", "left_semi")


def _by_leaf(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "leaf").sortWithinPartitions("leaf")


def _groups(batches) -> Iterator[pa.Table]:
    """The rows of each leaf, from batches sorted by it (first column)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        leaf = b.column(0).to_numpy(zero_copy_only=False)
        if not len(leaf):
            continue
        edges = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1), len(leaf)]
        for i, j in zip(edges[:-1], edges[1:]):
            part = b.slice(i, j - i)
            if held and held[0].column(0)[0].as_py() != int(leaf[i]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def linked(adjacent: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component, for a symmetric matrix."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None, :], len(label)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sifted(leaves: DataFrame, percent: int) -> DataFrame:
    """leaf, rep: the groups into which signatures part each leaf, under names of their own."""
    s = percent / 100 - SLACK
    least = (s + (1 - s) / (1 << BITS)) * SLOTS

    def run(batches):
        names, members = [], []
        for t in _groups(batches):
            if t.num_rows > 1:
                t = t.combine_chunks()
                rep = t.column(1).to_numpy()
                bits = np.frombuffer(b"".join(x for c in t.column(2).chunks for x in text_bytes(c)), "uint8").reshape(t.num_rows, -1)
                bits = np.unpackbits(bits, 1).reshape(t.num_rows, SLOTS, BITS) @ (1 << np.arange(BITS, dtype="uint8"))
                ones = (bits[:, :, None] == np.arange(1 << BITS)).reshape(t.num_rows, -1).astype("float32")
                label = linked(ones @ ones.T >= least)
                sizes = np.bincount(label, minlength=len(label))
                keep = sizes[label] > 1
                if keep.any():
                    leaf = np.uint64(int(t.column(0)[0].as_py()) % (1 << 64))
                    names.append(mix(mix(label[keep].astype("uint64")) ^ leaf).view("int64")), members.append(rep[keep])
            if sum(map(len, names)) > 50_000:
                yield _pairs(names, members)
                names, members = [], []
        yield _pairs(names, members)

    return _by_leaf(leaves.select("leaf", "rep", "bits")).mapInArrow(lean(run), "leaf long, rep long")


def _pairs(a: list[np.ndarray], b: list[np.ndarray], names=("leaf", "rep")) -> pa.RecordBatch:
    both = [np.concatenate(x) if x else np.zeros(0, "int64") for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x, "int64") for x in both], list(names))


def packed_sets(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all sets in binary columns, and the sets' sizes, with one copy."""
    flat, sizes = [], []
    for c in columns:
        ends = np.frombuffer(c.buffers()[1], "<i4")[c.offset : c.offset + len(c) + 1]
        flat.append(np.frombuffer(c.buffers()[2] or b"", "<u8", (ends[-1] - ends[0]) // 8, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, "<u8"))
        sizes.append(np.diff(ends) // 8)
    return np.concatenate(flat), np.concatenate(sizes).astype("int64")


def confirmed(flat: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest linked member of each set: exact sizes of all intersections in the group, added up
    over slices of the elements' hashes, so that memory follows the sets themselves."""
    n, slices = len(sizes), -(-max(1, len(flat)) // ELEMENTS)
    owner, both = np.repeat(np.arange(n, dtype="int32"), sizes), np.zeros((n, n), "float32")
    for k in range(slices):
        part = np.flatnonzero((flat >> U(20)) % U(slices) == k) if slices > 1 else slice(None)
        h, of = flat[part], owner[part]
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        column = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]) - 1
        shared = np.bincount(column)[column] > 1 if len(h) else np.zeros(0, bool)  # elements of one set only meet nothing
        column, of = column[shared], of[shared]
        if not len(column):
            continue
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        width = min(1 << 14, max(1, (1 << 21) // n))
        for c in range(0, int(column[-1]) + 1, width):
            i, j = np.searchsorted(column, (c, c + width))
            m = np.zeros((n, min(width, int(column[-1]) + 1 - c)), "float32")
            m[of[i:j], column[i:j] - c] = 1
            both += m @ m.T
    both = both.astype("int64")
    return linked(100 * both >= percent * (sizes[:, None] + sizes - both))


def _edges(groups: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """u, v: each linked document and the smallest of those that it is linked with in a group."""
    active = cut(groups.select("rep").distinct())
    near = blocked_bloom(active, "rep", active.count()).may_hold(docs.withColumnRenamed("doc_id", "rep"), "rep")

    def make(batches):
        for b in batches:
            for i, j, texts in runs(b.column(1)):
                h, bounds = sets(texts)
                blob = [h[a:z].astype("<u8").tobytes() for a, z in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(blob, "binary")], ["rep", "set"])

    def run(batches):
        us, vs = [], []
        for t in _groups(batches):
            if t.num_rows > 1:
                rep = t.column(1).to_numpy()
                label = confirmed(*packed_sets(t.column(2).chunks), percent)
                low = np.full(len(rep), np.iinfo("int64").max)
                np.minimum.at(low, label, rep)
                keep = low[label] < rep
                us.append(rep[keep]), vs.append(low[label][keep])
            if len(us) > 5000:
                yield _pairs(us, vs, ("u", "v"))
                us, vs = [], []
        yield _pairs(us, vs, ("u", "v"))

    full = near.select("rep", "text").mapInArrow(lean(make), "rep long, set binary")
    return _by_leaf(groups.join(full, "rep").select("leaf", "rep", "set")).mapInArrow(lean(run), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root: every document with a link to a smaller one, and the smallest that it reaches."""
    edges, before = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    most = edges.count()  # no round adds to them
    edges = edges.coalesce(max(1, -(-most // ROWS_PER_FILE)))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), most)
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), most)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), most)
        small = large.join(low, "u")
        edges = cut(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), most)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    A null text counts as empty. Documents without words link with nothing and are kept, each as its
    own component. Rows that repeat an id are one document. A row without an id takes the component of
    its set, or none (and is kept) if no row with an id has that set or a linked one. Ties can't
    arise: a component's name is its smallest id.
    """
    read = frugal(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = cut(_features(read))
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "sig", "bits")).alias("_m"))
    reps = cut(classes.select("a", "b", "n", F.col("_m.doc_id").alias("rep"), F.col("_m.sig").alias("sig"), F.col("_m.bits").alias("bits")))
    leaves, crowds = _leaves(reps, percent)
    groups = cut(_once(cut(_sifted(cut(_once(leaves)), percent))))
    texts = read.filter("doc_id IS NOT NULL")
    roots = components(_edges(groups, texts, percent))
    if crowds is not None:
        left = cut(_across(crowds, reps, roots))
        if left.take(1):
            roots = components(roots.withColumnRenamed("root", "v").unionByName(_edges(left, texts, percent)))
    named = reps.join(roots, reps["rep"] == roots["u"], "left")
    named = cut(named.select("a", "b", "n", F.coalesce("root", "rep").alias("_root")))
    #: Many rows have one set: a many-to-one join, whose large keys can be split.
    joined = rows.select("doc_id", "n", "a", "b").join(named, ["a", "b", "n"], "left")
    component = F.coalesce("_root", "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("_root").isNull()).alias("kept")
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns of docs. Where ids repeat
    or are null, each id and text is a document of its own: those without an id come last, texts of one id
    in the order of their hashes, and rows equal in both leave the one with the smallest hash."""
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        whole = docs.select("doc_id", F.struct(*[F.col(c) for c in docs.columns]).alias("_whole"))
        return _without(whole, near_duplicates(docs, percent), "doc_id")
    text = F.when(word_count(F.col("text")) > 0, F.col("text")).otherwise("")
    whole = docs.select("doc_id", F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), F.struct(*[F.col(c) for c in docs.columns]).alias("_whole"))
    one = whole.groupBy("doc_id", "_a", "_b").agg(F.min_by("_whole", F.xxhash64("_whole")).alias("_whole"))
    one = cut(one.orderBy(F.asc_nulls_last("doc_id"), "_a", "_b").select(F.monotonically_increasing_id().alias("_row"), "_whole"))
    found = near_duplicates(one.select(F.col("_row").alias("doc_id"), "_whole.text"), percent)
    return _without(one, found.withColumnRenamed("doc_id", "_row"), "_row")


def _without(whole: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of (key, _whole) that stay. A few ids go to the documents, else both sides meet by key."""
    gone = cut(found.filter(~F.col("kept")).select(key))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return whole.join(gone, key, "left_anti").select("_whole.*")


#: All pairs that share a shingle, confirmed by whole sets, then what each document reaches.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
low AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.u = w.doc_id"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of documents at 85 %: the same rules for nulls, repeats and ties."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
