"""Media columns: MPEG audio streams written and read as bytes.

``write_stream`` keeps a payload in the frames of a Layer III stream at 32 kHz, mono, with a frame
checksum: each frame's side information asks for no main data, so that the payload is ancillary data
behind it and a player hears silence. The unit is 576 bytes. A frame of 320 kbit/s holds two units
and the last odd unit takes a frame of 160 kbit/s, hence the bit rate varies and a Xing table leads
the stream, behind an ID3v2 tag.

``read_stream`` takes any stream of versions 1, 2 and 2.5 and layers I to III: it parses ID3v2, ID3v1
and APE tags, finds the first header whose successor agrees with it, resynchronises after damage,
parses Xing, Info and VBRI tables, verifies the checksums of layers I and III (those of layer II cover
allocation tables and are counted as unchecked), and gives exact durations and every frame's offset.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table
from .textbatch import lean

UNIT = 576
FILL = 255

# Fixed values of the format: kbit/s by (version 1 or 2, layer), hertz by version, side bytes.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
MONO = 3
CRC_POLY, CRC_START = 0x8005, 0xFFFF


@lru_cache(65_536)
def frame_crc(data: bytes) -> int:
    """CRC-16 of the bytes that a frame protects."""
    crc = CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLY) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # as coded: 3, 2 or 0 for versions 1, 2 and 2.5
    layer: int
    protected: bool
    kbits: int
    hertz: int
    padding: int
    mode: int
    extension: int

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbits // self.hertz + self.padding) * 4
        return self.samples * 125 * self.kbits // self.hertz + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mode == MONO else 32) if self.version == 3 else (9 if self.mode == MONO else 17)

    def agrees(self, other: Header | None) -> bool:
        return other is not None and (self.version, self.layer, self.hertz) == (other.version, other.layer, other.hertz)


@lru_cache(65_536)
def parse_header(four: bytes) -> Header | None:
    """None if the four bytes can't start a frame; free-format streams are not taken."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, hertz = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    kbits = KBITS[1 if version == 3 else 2, layer][rate]
    return Header(version, layer, not four[1] & 1, kbits, HERTZ[version][hertz], four[2] >> 1 & 1, four[3] >> 6, four[3] >> 4 & 3)


def _header_bytes(kbits: int, protected: bool) -> bytes:
    second = 0xE0 | 3 << 3 | 1 << 1 | (not protected)
    return bytes([0xFF, second, KBITS[1, 3].index(kbits) << 4 | HERTZ[3].index(32000) << 2, MONO << 6])


def _frame_start(kbits: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame, and the bytes left behind them."""
    head = _header_bytes(kbits, True)
    h = parse_header(head)
    side = bytes(h.side)
    start = head + struct.pack(">H", frame_crc(head[2:] + side)) + side
    return start, h.length - len(start)


_DOUBLE, _DOUBLE_ROOM = _frame_start(320)
_SINGLE, _SINGLE_ROOM = _frame_start(160)
_DOUBLE_REST, _SINGLE_REST = bytes(_DOUBLE_ROOM - 2 * UNIT), bytes(_SINGLE_ROOM - UNIT)
_DOUBLE_SIZE, _SINGLE_SIZE = len(_DOUBLE) + _DOUBLE_ROOM, len(_SINGLE) + _SINGLE_ROOM


def _syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 127 for shift in (21, 14, 7, 0))


def _id3(length_ms: int) -> bytes:
    text = b"\x00" + str(length_ms).encode()
    body = b"TLEN" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body


def write_stream(payload: bytes) -> bytes:
    """payload: a positive multiple of UNIT bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    doubles, odd = divmod(len(payload) // UNIT, 2)
    parts = []
    for i in range(0, doubles * 2 * UNIT, 2 * UNIT):
        parts += (_DOUBLE, payload[i : i + 2 * UNIT], _DOUBLE_REST)
    if odd:
        parts += (_SINGLE, payload[doubles * 2 * UNIT :], _SINGLE_REST)
    frames = doubles + odd
    head = _header_bytes(320, False)
    first = parse_header(head)
    total = first.length + doubles * _DOUBLE_SIZE + odd * _SINGLE_SIZE
    seek = [min(255, (first.length + (k * frames // 100) * _DOUBLE_SIZE) * 256 // total) for k in range(100)]
    xing = head + bytes(first.side) + b"Xing" + struct.pack(">III", 7, frames, total) + bytes(seek)
    return _id3(frames * 36) + xing.ljust(first.length, b"\0") + b"".join(parts)


@dataclass
class Stream:
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, "int64"))
    samples: int = 0
    hertz: int = 0
    skipped: int = 0
    good: int = 0
    bad: int = 0
    unchecked: int = 0
    kbits: dict[int, int] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: bytes = b""
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.hertz if self.hertz else 0


def _parse_id3(data: bytes, out: Stream) -> int:
    """The end of the ID3v2 tags at the start."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
        end, major, p = at + 10 + size, data[at + 3], at + 10
        while p + 10 <= min(end, len(data)) and data[p] and major >= 3:
            raw = data[p + 4 : p + 8]
            n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0) if major == 4 else (24, 16, 8, 0)))
            if data[p : p + 1] == b"T":
                code = data[p + 10] if n else 0
                body = data[p + 11 : p + 10 + n]
                out.tags[data[p : p + 4].decode("latin-1")] = body.decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(code, 3)], "replace").strip("\0")
            p += 10 + n
        at = end + 10 * bool(data[at + 5] & 16)
    return min(at, len(data))


def _tail(data: bytes, out: Stream) -> int:
    """Where the audio ends, before ID3v1 and APE tags."""
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        out.tags["ID3v1"] = data[-125:-95].decode("latin-1").strip("\0 ")
        end -= 128
    if data[end - 32 : end - 24] == b"APETAGEX" and end >= 32:
        size, _, flags = struct.unpack("<III", data[end - 20 : end - 8])
        out.tags["APE"] = str(size)
        end -= size + 32 * bool(flags & 1 << 31)
    return max(end, 0)


def _parse_table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame is a Xing, Info or VBRI table rather than sound."""
    p = at + 4 + h.side
    for p in (p, p + 2):
        if data[p : p + 4] in (b"Xing", b"Info"):
            out.table, flags, p = data[p : p + 4].decode(), int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
            if flags & 1:
                out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out.seek = data[p : p + 100]
            return True
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, n, _, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        out.seek = data[at + 62 : at + 62 + n * width]
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Never raises on damaged input: what can't be read counts as skipped bytes."""
    out = Stream()
    at, end, last, offsets, rates = _parse_id3(data, out), _tail(data, out), None, [], {}
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        if h is not None and not (h.agrees(last) and at + h.length <= end):
            after = at + h.length
            h = h if after == end or after < end and h.agrees(parse_header(data[after : after + 4])) else None
        if h is None:
            nearest = data.find(b"\xff", at + 1, end)
            out.skipped += (end if nearest < 0 else nearest) - at
            at, last = (end if nearest < 0 else nearest), None
            continue
        body = at + 4 + 2 * h.protected + h.side
        if h.protected:
            span = h.side if h.layer == 3 else {1: 16 if h.mode == MONO else 4 * (h.extension + 1) + (32 - 4 * (h.extension + 1)) // 2 if h.mode == 1 else 32}.get(h.layer)
            if span is None:
                out.unchecked += 1
            elif frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + span]) == data[at + 4] << 8 | data[at + 5]:
                out.good += 1
            else:
                out.bad += 1
        if offsets or out.table or not (h.layer == 3 and _parse_table(data, at, h, out)):
            offsets.append(at)
            rates[h.kbits] = rates.get(h.kbits, 0) + 1
            out.samples += h.samples
            out.hertz = h.hertz
            out.ancillary.append(data[body : at + h.length])
        last, at = h, at + h.length
    out.skipped += max(0, end - at)
    out.offsets, out.kbits = np.array(offsets, "int64"), rates
    return out


def payload_of(stream: Stream) -> bytes:
    """What write_stream() kept."""
    return b"".join(x[: len(x) // UNIT * UNIT] for x in stream.ancillary)


def feature_of(s: Stream) -> str:
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbits.items()))
    seek = zlib.crc32(s.offsets.astype("<i8").tobytes())
    return (
        f"{s.table}:{s.table_frames}:{s.table_bytes};frames={len(s.offsets)};samples={s.samples};hertz={s.hertz};"
        f"us={s.duration_us};kbits={rates};crc={s.good}/{s.bad};skipped={s.skipped};seek={seek:08x}"
    )


def pad(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % UNIT or (0 if text else UNIT))


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, duration_us long, frames long"
)


def _digest(text: bytes) -> tuple:
    media = write_stream(pad(text))
    stream = read_stream(media)
    payload, sha = payload_of(stream), lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(text), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media),
        feature_of(stream), stream.duration_us, len(stream.offsets),
    )


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of each document; a null text counts as empty, which still
    has one unit of fill. Repeated rows stay; other columns are not read."""

    def run(batches):
        for b in batches:
            texts = list(_texts(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], "int64"), pa.array([write_stream(pad(t)) for t in texts], "binary")],
                ["doc_id", "n_bytes", "media"],
            )

    return frugal(_columns(docs)).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """Durations, seek offsets, checks and tags of a binary column of MPEG audio, beside its id in
    doc_id. A null or empty stream has no frames."""

    def run(batches):
        for b in batches:
            read = [read_stream(x) for x in _texts(b, "media")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s.offsets) for s in read], "int64"),
                    pa.array([s.samples for s in read], "int64"),
                    pa.array([s.hertz for s in read], "int32"),
                    pa.array([s.duration_us for s in read], "int64"),
                    pa.array([s.offsets for s in read], pa.list_(pa.int64())),
                    pa.array([s.bad for s in read], "int64"),
                    pa.array([s.skipped for s in read], "int64"),
                    pa.array([s.table for s in read], "string"),
                    pa.array([feature_of(s) for s in read], "string"),
                ],
                ["doc_id", "frames", "samples", "hertz", "duration_us", "seek_offsets", "bad_checksums", "skipped_bytes", "rate_table", "feature"],
            )

    return frugal(df).select(F.col("doc_id").cast("long"), F.col(media).alias("media")).mapInArrow(
        lean(run),
        "doc_id long, frames long, samples long, hertz int, duration_us long, seek_offsets array<long>, "
        "bad_checksums long, skipped_bytes long, rate_table string, feature string",
    )


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text through a stream and back, as digests of what was read."""

    def run(batches):
        for b in batches:
            rows = [_digest(t) for t in _texts(b)]
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = ("int64", "int64", "string", "int64", "int64", "string", "string", "int64", "int64")
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return frugal(_columns(table(spark, sf_dir, "documents"))).mapInArrow(lean(run), DIGESTS)
