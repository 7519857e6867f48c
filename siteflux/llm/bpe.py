"""Byte-level BPE with the vocabulary file of a public tokenizer.

Encoding keeps the symbols of one pre-token in a doubly linked list and the ranks of neighbouring
pairs in a priority queue; the lowest rank, leftmost first, merges, and entries whose symbols have
since changed are skipped as stale. Decoding joins the strings that the vocabulary has for the ids.

Texts are cut where the pre-tokenizer must cut them anyway, at a single space between two other
characters, and results are kept for each piece in two caches bounded in bytes, so that the work for a
worker follows its distinct pieces. The vocabulary is read once in a worker, from a path that each
executor can open.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table
from .textbatch import lean

VOCABULARY = "byte_bpe_50k.json"
#: About so many bytes in each half of a worker's two caches: of pre-tokens, and of fields.
PIECE_BYTES, FIELD_BYTES = 20_000_000, 90_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Kept(dict):
    """A dict that fills itself. Once its entries take so many bytes they become the older half, which is
    asked before an entry is made anew, and the older half of before goes: what comes again stays."""

    def __init__(self, make, most, cost):
        super().__init__()
        self.make, self.most, self.cost, self.older, self.bytes = make, most, cost, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.bytes += 150 + 2 * len(key) + self.cost(value)
        if self.bytes > self.most:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[key] = value
        return value


class Bpe:
    """path: a tokenizer file with a BPE model and byte-level pre-tokenizer and decoder."""

    #: Fixed value: the pre-tokenizer's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.require(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        #: For each left id: right id -> rank * 2^18 + id made. The vocabulary is far below 2^18.
        none: dict[int, int] = {}
        self.merged = [none] * (max(vocab.values()) + 1)
        for rank, (left, right) in enumerate(merges):
            if self.merged[vocab[left]] is none:
                self.merged[vocab[left]] = {}
            self.merged[vocab[left]].setdefault(vocab[right], rank << 18 | vocab[left + right])
        self.byte_ids = [vocab[c] for c in symbols]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(self.PATTERN)
        self.edge = regex.compile(r"\s")
        self.by_piece = _Kept(self.merge, PIECE_BYTES, lambda ids: 60 + 36 * len(ids))
        self.by_field = _Kept(self._field, FIELD_BYTES, lambda x: 0 if x is None else 180 + len(x[0]) + len(x[1]))
        self.marks = {c: self._known(self.merge(c)) for c in ".,;:!?"}

    @staticmethod
    def require(spec: dict) -> None:
        """An error for a file of another kind than this class reads, rather than other ids."""
        model, cutter, back = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        extras = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        extras += [k for k in ("lstrip", "rstrip", "single_word") if any(x.get(k) for x in spec.get("added_tokens", []))]
        kinds = (model.get("type", "BPE"), cutter.get("type"), back.get("type"), spec.get("normalizer"))
        if kinds != ("BPE", "ByteLevel", "ByteLevel", None) or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or extras:
            raise ValueError(f"not a plain byte-level BPE file: {kinds}, {cutter}, {extras}")

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        ids = list(map(self.byte_ids.__getitem__, piece.encode()))
        n = len(ids)
        merged, width = self.merged, n.bit_length()
        mask, last = (1 << width) - 1, n - 1
        #: An entry orders by rank, then place: (rank, place of the left symbol, id made).
        queue = []
        for i in range(last):
            found = merged[ids[i]].get(ids[i + 1])
            if found is not None:
                queue.append((found >> 18 << width | i) << 18 | found & 0x3FFFF)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, last))
        while queue:
            entry = heappop(queue)
            made, i = entry & 0x3FFFF, entry >> 18 & mask
            j = after[i]
            if j >= n or ids[i] < 0:
                continue  # stale
            found = merged[ids[i]].get(ids[j])
            if found is None or found & 0x3FFFF != made:
                continue  # stale
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merged[made].get(ids[k])
                if found is not None:
                    heappush(queue, (found >> 18 << width | i) << 18 | found & 0x3FFFF)
            h = before[i]
            if h >= 0:
                found = merged[ids[h]].get(made)
                if found is not None:
                    heappush(queue, (found >> 18 << width | h) << 18 | found & 0x3FFFF)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> list[int]:
        by_piece = self.by_piece
        return [i for piece in self.pieces.findall(text) for i in by_piece[piece]]

    def _known(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), b"".join(map(self.strings.__getitem__, ids))

    def _field(self, field: str):
        """What follows a single space: its ids as text and their bytes; None if white
        space at an end of it may belong to a longer run."""
        if field.isalpha():
            return self._known(self.merge(" " + field))
        if not field or self.edge.match(field[0]) or self.edge.match(field[-1]):
            return None
        word, mark = field[:-1], field[-1]
        if mark in self.marks and word.isalpha():  # a word and a mark are two pre-tokens
            (ids, back), (more, end) = self.by_field[word], self.marks[mark]
            return f"{ids},{more}", back + end
        return self._known(self._plain(" " + field))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; special tokens' strings become their ids."""
        if self.split_special is None:
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [self.special[part]] if k % 2 else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def summary(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the bytes that they decode to."""
        if not any(s in text for s in self.special):
            first, *rest = text.split(" ")
            fields = list(map(self.by_field.__getitem__, rest))
            if rest and all(fields) and first and not self.edge.match(first[-1]):
                fields.insert(0, self._known(self._plain(first)))
                joined = ",".join(map(itemgetter(0), fields))
                return joined.count(",") + 1, joined, b"".join(map(itemgetter(1), fields))
        ids = self.encode(text)
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.strings.__getitem__, ids))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each document. A null text counts as empty and has no ids; repeated rows
    stay; other columns are not read."""
    path = path or vocabulary_path()

    def run(batches):
        coder = bpe(path)
        for b in batches:
            ids = [coder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return frugal(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text."""
    path = path or vocabulary_path()

    def run(batches):
        coder = bpe(path)
        for b in batches:
            texts = [None if x is None else coder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, "string")], ["doc_id", "text"])

    return frugal(encoded).select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document encoded and decoded again, as counts and digests, and ids if asked for."""
    path = path or vocabulary_path()

    def run(batches):
        coder = bpe(path)
        for b in batches:
            counts, ids, texts, kept = [], [], [], []
            for t in b.column(1):
                n, joined, back = coder.summary(t.as_py() or "")
                counts.append(n)
                if with_ids:
                    kept.append(np.fromstring(joined, "int32", sep=",") if n else np.zeros(0, "int32"))
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            columns = [b.column(0), pa.array(counts, "int64"), pa.array(ids, "string"), pa.array(texts, "string")]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return frugal(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), DIGESTS + ", ids array<int>" * with_ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest_documents() of documents: null texts are empty, repeated rows stay."""
    return digest_documents(table(spark, sf_dir, "documents"))
