"""Words of many texts at once, as numpy arrays.

Words are runs of bytes other than the six ASCII white-space bytes. Hashes are polynomials modulo
2^64 over a word's bytes, read from running sums, then mixed; a word's hash depends on its bytes only.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the two polynomials and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts of about so many bytes are worked on at a time; a kernel needs some forty times as much.
CHUNK = 1 << 19
#: Word hashes of a longer text are made from pieces of so many bytes.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1. One table for each base, which grows by need."""
    if len(_POWERS.get(base, ())) < n:
        table = np.full(-(-n // (1 << 16)) << 16, base, "uint64")
        table[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.multiply.accumulate(table, out=table)
    return _POWERS[base][:n]


class Sums:
    """Hashes of any slices of an array of small or hashed values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n, self.which = len(values), which
        self.sums = np.zeros(n + 1, "uint64")
        with np.errstate(over="ignore"):
            np.cumsum((values.astype("uint64") + U(1)) * powers(BASES[which], n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            back = powers(INVERSES[self.which], len(self.sums))[starts]
            return mix((self.sums[ends] - self.sums[starts]) * back + (ends - starts).astype("uint64"))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, joined by line feeds
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i] to bounds[i + 1]

    @property
    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: list[bytes], change: bytes | None = None) -> Words:
    """change: a table for bytes.translate(), such as LOWER."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.translate(change) if change else joined, "uint8")
    inside = np.zeros(len(data) + 2, "int8")
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter((len(t) + 1 for t in texts), "int64", len(texts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return Words(data, starts, ends, bounds)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A binary or string column as bytes; null is empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def runs(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, texts) of runs of a column with about so many bytes, copied one run at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield first, i, text_bytes(column.slice(first, i - first))
            first, size = i, 0
        size += n
    if len(sizes) > first:
        yield first, len(sizes), text_bytes(column.slice(first))


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text cut at white space into parts of most bytes or little more; no word is cut."""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def word_hashes(texts: list[bytes], change: bytes | None = None, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and bounds: the words of text i are bounds[i] to bounds[i + 1]. A long text costs
    no more than its hashes and the work on one piece of it."""
    if sum(map(len, texts)) <= 2 * PIECE:
        w = words(texts, change)
        return Sums(w.data, which).of(w.starts, w.ends), w.bounds
    out, counts = [], []
    for t in texts:
        n = 0
        for part in pieces(t):
            w = words([part], change)
            out.append(Sums(w.data, which).of(w.starts, w.ends))
            n += len(out[-1])
        counts.append(n)
    return np.concatenate(out), np.concatenate(([0], np.cumsum(counts, dtype="int64")))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MALLOC = ctypes.CDLL(None)


def lean(run: Callable) -> Callable:
    """run, a function of batches, with what its kernels have grown given back when it ends: workers are
    used again for other stages, and each would else keep the peak of all."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return held


def release() -> None:
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_MALLOC, "malloc_trim"):
        _MALLOC.malloc_trim(0)


def chunks(texts: list[bytes], most: int = CHUNK):
    """(first, last) of runs of texts with about so many bytes; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)
