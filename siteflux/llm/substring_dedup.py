"""Substring dedup: fixed-block anchors.

A window of ``WINDOW`` words that stands in two documents holds one whole block of half as many words
that starts at a multiple of that number in the first of them. So:

1. Documents with equal words form a class. All but its smallest id lose every word, if a window fits,
   as each of their windows starts in that one too.
2. The non-overlapping blocks of each document are the index. Every rolling run of a block's length in
   every document probes it. Blocks and probes meet in buckets by hash: a place hits if a smaller id has
   its words as a block, or if it is a block that a larger id has anywhere.
3. Around hits, the windows that hold one are candidates. They meet by 128-bit hashes, and a window goes
   if its sequence starts in a smaller id. Overlapping windows that go join up to the maximal repeats.

No pairs are made: a hash needs its smallest and largest id only. A passage in a third of all documents
is settled where it is read: places of a hash that several documents of one chunk share are hits (step
2) or go (step 3) at once, and one or two of them stand for the chunk in the bucket.

What meets is packed. A chunk gives one row for each bucket, with the ids of the documents in it, and a
hash and a position for each place: 6 to 7 bytes for each word of the input in step 2. The number of
buckets follows the number of words, so that a bucket's size doesn't grow with the input. A hash in
step 2 is a bucket and 32 more bits; a false hit only makes a candidate that step 3 refuses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .textbatch import Sums, chunks, text_bytes, word_hashes
from .url_filter import blocked_bloom

WINDOW = 50
#: Words for each bucket, about.
BUCKET_WORDS = 1_000_000
MOST_BUCKETS = 1 << 20
#: Stands for a null id, which is larger than all.
NO_ID = (1 << 63) - 1
PACKED = "bucket int, settled boolean, blob binary"
PLACES = "doc_id long, tag long, blob binary"


class Chunk:
    """Some documents of a batch, by id, with the hashes of their words."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], tagged: bool):
        order = np.argsort(ids, kind="stable")
        self.order, self.ids = order, ids[order]
        texts = [texts[i] for i in order]
        self.tags = np.array([tag_of(t) if tagged else 0 for t in texts], "int64")
        self.texts = texts
        self.hashes, self.bounds = word_hashes(texts)

    def rolling(self, width: int) -> np.ndarray:
        """Starts of all runs of so many words inside one document."""
        starts = np.arange(len(self.hashes))
        return starts[starts + width <= np.repeat(self.bounds[1:], np.diff(self.bounds))]

    def runs(self, starts: np.ndarray, width: int) -> np.ndarray:
        return Sums(self.hashes).of(starts, starts + width)

    def other_runs(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Independent of runs()."""
        return Sums(word_hashes(self.texts, which=1)[0], 1).of(starts, starts + width)

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, starts, "right") - 1

    def pack(self, starts: np.ndarray, *hashes: np.ndarray) -> bytes:
        """Places in order of their starts."""
        of = self.owner(starts)
        present, counts = np.unique(of, return_counts=True)
        ids = self.ids[present]
        tags = self.tags[present] if self.tags.any() else np.zeros(0, "int64")
        arrays = [ids[:1].astype("<i8"), _narrow(np.diff(ids, prepend=ids[:1])), _narrow(counts), _narrow(tags), _narrow(starts - self.bounds[of]), *hashes]
        head = np.array([x for a in arrays for x in (len(a), a.dtype.itemsize)], "<i8").tobytes()
        return bytes([len(arrays)]) + head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Ids, tags, positions and hashes of packed places."""
    n = blob[0]
    sizes = np.frombuffer(blob, "<i8", 2 * n, 1).reshape(n, 2)
    at, out = 1 + 16 * n, []
    for k, (count, width) in enumerate(sizes):
        out.append(np.frombuffer(blob, f"<{'i' if not k else 'u'}{width}", count, at))
        at += count * width
    first, steps, counts, tags, places, *hashes = out
    ids = first + np.cumsum(steps.astype("int64"))
    tags = np.repeat(tags.astype("int64"), counts) if len(tags) else np.zeros(len(places), "int64")
    return np.repeat(ids, counts), tags, places.astype("int64"), *hashes


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers, not below 0, in as few bytes as they need."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def tag_of(text: bytes) -> int:
    return zlib.crc32(b" ".join(text.split()))


def _rows(rows: list[tuple], kinds: tuple[str, ...], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], list(names))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ("int32", "bool", "binary"), ("bucket", "settled", "blob"))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has entries, with their positions in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[order[a]]), order[a:b]


def _grouped(batches) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """For each bucket of batches that are sorted by it, its open and its settled blobs."""
    last, open_, settled = None, [], []
    for b in batches:
        for row in b.to_pylist():
            if last not in (None, row["bucket"]):
                yield open_, settled
                open_, settled = [], []
            last = row["bucket"]
            (settled if row["settled"] else open_).append(row["blob"])
    if last is not None:
        yield open_, settled


def _places(ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row for each document, with its positions."""
    order = np.lexsort((at, tags, ids))
    ids, tags, at = ids[order], tags[order], at[order].astype("<i8")
    edges = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), [True]))) if len(ids) else []
    rows = [(int(ids[a]), int(tags[a]), at[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
    return _rows(rows, ("int64", "int64", "binary"), ("doc_id", "tag", "blob"))


def _extremes(which: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    least, most = np.full(n, np.iinfo("int64").max), np.full(n, np.iinfo("int64").min)
    np.minimum.at(least, which, ids)
    np.maximum.at(most, which, ids)
    return least, most


def _probes(docs: DataFrame, buckets: int, block: int, tagged: bool) -> DataFrame:
    """Every rolling run of block words, packed by bucket."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), text_bytes(b.column(1))
            for i, j in chunks(texts):
                c = Chunk(ids[i:j], texts[i:j], tagged)
                starts = c.rolling(block)
                h = c.runs(starts, block)
                of = c.owner(starts)
                owner, anchor = c.ids[of], (starts - c.bounds[of]) % block == 0
                order = np.argsort(h, kind="stable")  # starts, and so ids, stay in order for equal hashes
                same = h[order][1:] == h[order][:-1]
                first = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, int)
                last = np.concatenate((first[1:], [len(order)])) - 1 if len(order) else first
                shared = owner[order[first]] != owner[order[last]]  # by several documents of the chunk
                group = np.cumsum(np.concatenate(([True], ~same))) - 1 if len(order) else first
                settled = np.zeros(len(starts), bool)
                settled[order] = shared[group]
                #: The largest id and the smallest block stand for the chunk.
                stand = ~settled
                stand[order[last[shared]]] = True
                own = order[anchor[order] & shared[group]]
                seen, at = np.unique(h[own], return_index=True)
                stand[own[at]] = True
                rows = []
                if settled.any():
                    rows.append((int(c.ids[0]) % buckets, True, c.pack(starts[settled])))
                keep = np.flatnonzero(stand)
                for k, x in _by_bucket((h[keep] % np.uint64(buckets)).astype("int64")):
                    x = keep[x]
                    rows.append((k, False, c.pack(starts[x], (h[x] // np.uint64(buckets)).astype("<u4"))))
                yield _packed(rows)

    return docs.mapInArrow(run, PACKED)


def _hits(met: DataFrame, block: int) -> DataFrame:
    """The places of each document at which it hits, as earlier or later text."""

    def run(batches):
        for open_, settled in _grouped(batches):
            for blob in settled:
                yield _places(*unpack(blob)[:3])
            if open_:
                ids, tags, at, h = (np.concatenate(x) for x in zip(*map(unpack, open_)))
                anchor = at % block == 0
                _, which = np.unique(h, return_inverse=True)
                n = int(which.max()) + 1
                least, most = _extremes(which[anchor], ids[anchor], n)[0], _extremes(which, ids, n)[1]
                keep = (least[which] < ids) | (anchor & (most[which] > ids))
                yield _places(ids[keep], tags[keep], at[keep])

    return met.mapInArrow(run, PLACES)


def _windows(near: DataFrame, buckets: int, window: int, tagged: bool) -> DataFrame:
    """The windows that hold a hit, packed by bucket; those that go by their own chunk are settled."""
    block = window // 2

    def run(batches):
        for b in batches:
            ids, texts, hits = b.column(0).to_numpy(zero_copy_only=False), text_bytes(b.column(2)), b.column(3).to_pylist()
            for i, j in chunks(texts):
                c = Chunk(ids[i:j], texts[i:j], tagged)
                mark = np.zeros(len(c.hashes) + 1, "int64")
                for d, k in enumerate(c.order):
                    at = np.concatenate([np.frombuffer(x, "<i8") for x in hits[i + k]])
                    at = at[at < c.bounds[d + 1] - c.bounds[d]]
                    np.add.at(mark, c.bounds[d] + np.maximum(at - (window - block), 0), 1)
                    np.add.at(mark, c.bounds[d] + at + 1, -1)
                starts = c.rolling(window)
                starts = starts[np.cumsum(mark)[starts] > 0]
                h, g = c.runs(starts, window), c.other_runs(starts, window)
                owner = c.ids[c.owner(starts)]
                order = np.lexsort((starts, g, h))
                new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))[: len(order)]
                least = owner[order[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(order) else owner
                gone = np.zeros(len(starts), bool)
                gone[order] = least < owner[order]
                rows = []
                if gone.any():
                    rows.append((int(c.ids[0]) % buckets, True, c.pack(starts[gone])))
                keep = np.flatnonzero(~gone)
                for k, x in _by_bucket((h[keep] % np.uint64(buckets)).astype("int64")):
                    x = keep[x]
                    rows.append((k, False, c.pack(starts[x], h[x], g[x])))
                yield _packed(rows)

    return near.mapInArrow(run, PACKED)


def _gone(met: DataFrame) -> DataFrame:
    """The starts of the windows that go from each document."""

    def run(batches):
        for open_, settled in _grouped(batches):
            for blob in settled:
                yield _places(*unpack(blob)[:3])
            if open_:
                ids, tags, at, h, g = (np.concatenate(x) for x in zip(*map(unpack, open_)))
                order = np.lexsort((ids, g, h))
                h, g = h[order], g[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
                least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                keep = order[least < ids[order]]
                yield _places(ids[keep], tags[keep], at[keep])

    return met.mapInArrow(run, PLACES)


def _meet(df: DataFrame, buckets: int) -> DataFrame:
    n = min(buckets, max(partitions(df.sparkSession), buckets // 8))
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


def kept_words(text: bytes, starts: list[bytes] | None, window: int) -> list[bytes]:
    """The words that no window covers."""
    x = text.split()
    if not starts:
        return x
    at = np.concatenate([np.frombuffer(s, "<i8") for s in starts])
    mark = np.zeros(len(x) + 1, "int64")
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return [w for w, c in zip(x, np.cumsum(mark)) if not c]


class Repeats:
    """What goes from the rows of docs. A null id is larger than all, and a null text has no words."""

    def __init__(self, docs: DataFrame, window: int = WINDOW):
        if window < 2 or window % 2:
            raise ValueError("a window has an even number of words")
        self.window, spark = window, docs.sparkSession
        read = docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
        )

        def digest(batches):
            for b in batches:
                rows = []
                for doc, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                    x = t.split()
                    joined = b" ".join(x)
                    rows.append((doc, zlib.crc32(joined), len(x), hashlib.sha256(joined).digest()))
                yield _rows(rows, ("int64", "int64", "int64", "binary"), ("doc_id", "tag", "n_words", "same"))

        sums = cut(read.mapInArrow(digest, "doc_id long, tag long, n_words long, same binary"))
        found = sums.agg(F.sum(F.when(F.col("n_words") >= window, F.col("n_words"))).alias("total")).first()
        #: Rows of one id with different texts are documents of their own only if the text is told too.
        tagged = bool(sums.groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("b")).filter("a != b").take(1))
        sums = sums if tagged else sums.withColumn("tag", F.lit(0).cast("long"))
        #: Written first, so that the join can split a text that many rows have.
        first = cut(sums.filter(F.col("n_words") >= window).groupBy("same").agg(F.min("doc_id").alias("_first")))
        self.rows = cut(
            sums.join(first, "same", "left").select("doc_id", "tag", "n_words", "same", F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False)).alias("copy"))
        )
        total = found["total"] or 0
        buckets = int(min(MOST_BUCKETS, max(-(-total // BUCKET_WORDS), min(2 * partitions(spark), total // 50_000), 1)))
        block = window // 2
        hits = cut(_hits(_meet(_probes(read, buckets, block, tagged), buckets), block))
        alone = self.rows.filter(~F.col("copy")).select("doc_id", "tag").distinct()
        hits = cut(hits.join(alone, ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.collect_list("blob").alias("hits")))
        n = hits.count()
        near = blocked_bloom(hits.select("doc_id"), "doc_id", n).may_hold(read, "doc_id")
        if tagged:
            near = near.mapInArrow(_tagging, "doc_id long, text binary, tag long")
        else:
            near = near.withColumn("tag", F.lit(0).cast("long"))
        self.near = cut(near.join(hits, ["doc_id", "tag"]).select("doc_id", "tag", "text", "hits"))
        gone = _gone(_meet(_windows(self.near, buckets, window, tagged), buckets))
        self.gone = cut(gone.groupBy("doc_id", "tag").agg(F.collect_list("blob").alias("starts")))

    def digests(self) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256 of each row of docs."""
        window = self.window

        def run(batches):
            for b in batches:
                rows = []
                for doc, tag, t, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), b.column(3).to_pylist()):
                    kept = kept_words(t, starts, window)
                    rows.append((doc, tag, len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield _rows(rows, ("int64", "int64", "int64", "string"), ("doc_id", "tag", "_kept", "_sha"))

        changed = self.near.dropDuplicates(["doc_id", "tag"]).join(self.gone, ["doc_id", "tag"]).select("doc_id", "tag", "text", "starts")
        changed = changed.mapInArrow(run, "doc_id long, tag long, _kept long, _sha string")
        whole, n = F.lower(F.hex("same")), F.col("n_words")
        copy = F.col("copy")
        return self.rows.join(changed, ["doc_id", "tag"], "left").select(
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_words",
            F.when(copy, n).otherwise(n - F.coalesce("_kept", "n_words")).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", whole)).alias("kept_sha256"),
        )

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with what is left of each text: words unchanged, joined by one space where any went."""
        window = self.window
        marks = self.rows.distinct().join(self.gone, ["doc_id", "tag"], "left")
        marks = marks.select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), F.col("copy").alias("_copy"), "starts")

        @F.pandas_udf("binary")
        def same_of(texts):
            return texts.map(lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).digest())

        @F.pandas_udf("string")
        def left(texts, copies, starts):
            return texts.where(texts.isna(), [t if not c and s is None else "" if c else b" ".join(kept_words(t.encode(), list(s), window)).decode() if t is not None else t for t, c, s in zip(texts, copies, starts)])

        whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_whole")
        keyed = docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"), same_of("text").alias("_digest"))
        joined = keyed.join(marks, (F.col("_key") == F.col("_doc")) & (F.col("_digest") == F.col("_same")), "left")
        text = left("_whole.text", "_copy", "starts").alias("text")
        return joined.select(*[text if c == "text" else F.col("_whole")[c].alias(c) for c in docs.columns])


def _tagging(batches):
    for b in batches:
        tags = [tag_of(t) for t in text_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tags, "int64")], ["doc_id", "text", "tag"])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words that windows of smaller ids cover; all rows and columns stay.

    Texts shorter than a window, null and empty ones stay as they are. Rows that repeat an id don't
    take each other's words. Windows are judged on the input, not on what is left.
    """
    return Repeats(docs, window).apply(docs)


#: Windows as texts, one after the other.
ORACLE_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN first USING (h) WHERE first < doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes from each row of documents: the same rules for nulls, empties, repeats and empty tables."""
    return Repeats(table(spark, sf_dir, "documents")).digests()
