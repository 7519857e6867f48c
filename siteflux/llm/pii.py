"""Personal data: generators of high recall propose spans, boosted trees accept or refuse them.

Generators propose overlapping spans of four kinds, looser than any format rule. Each span gets
features of its form (digits, groups, marks, checksum) and of its context (cue words to its left,
neighbouring characters). Boosted trees score them, one held-out part calibrates the scores, and on another each
kind has the least threshold that keeps the asked-for precision. Accepted spans that overlap
no base span and no better span are added to the base spans, which strict rules find and which stay.

The trees learn from labelled strings that this module makes from a fixed seed: ``TRAINING`` rows of clear cases, and
the generators' own proposals on ``TEXTS`` made-up lines in which classes overlap (order numbers written like phones,
numbers of unknown purpose in tables, addresses that are versions), bounds that no input changes. No document is a
training row.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import frugal, table
from .textbatch import lean

KINDS = ("email", "ip", "card", "phone")
TRAINING = 6000
TEXTS = 6000
PRECISION = 0.97
LIKELIER = 0.5
REACH = 28  # characters of context on the left

# The base patterns. Lookbehinds only spare starts that can't match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE_EMAIL = re.compile(r"(?<![^\s<>()\[\],;])[^\s@<>()\[\],;]{1,64}@[^\s@<>()\[\],;]{1,128}")
SPELT_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}){1,4}",
    re.IGNORECASE,
)
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")
LOOSE_DIGITS = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
GROUP = re.compile(r"[0-9]+")

CUES = {
    "email": re.compile(r"mail|contact|write|reach|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|client", re.I),
    "card": re.compile(r"card|visa|amex|master|payment|credit|billing", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|cell|whatsapp|contact", re.I),
}
AGAINST = re.compile(r"isbn|version|order|\bref|page|date|serial|invoice|\bno\b|\bid\b|build|section|total", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(GROUP.findall(s))


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ on, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that the strict rules find, sorted."""
    out = [(s, 0, e) for s, e in base_emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): loose spans; one span may be proposed as several kinds."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in LOOSE_EMAIL.finditer(text)]
    if "dot" in text or "DOT" in text or "Dot" in text:
        out += [(m.start(), 0, m.end()) for m in SPELT_EMAIL.finditer(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in LOOSE_IP.finditer(text)]
        for m in LOOSE_DIGITS.finditer(text):
            out += [(m.start(), 2, m.end()), (m.start(), 3, m.end())]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s, left = text[start:end], text[max(0, start - REACH) : start]
    groups = GROUP.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    host = s.rsplit("@", 1)[-1]
    last = re.split(r"[.\s\])}]", host.rstrip(".])}"))[-1]
    marks = [c for c in s if not c.isalnum()]
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), len(digits) / len(s), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        len(marks), len(set(marks)), s[0] == "+", s.startswith("00"), "(" in s, "/" in s, "." in s, "-" in s, " " in s,
        luhn(digits) if digits else 0, digits[:1] in ("3", "4", "5", "6"), all(int(g) <= 255 for g in groups if len(g) < 9) and max(sizes) <= 3,
        sizes[:3] == [4, 2, 2], sizes[-3:] == [2, 2, 4], len(set(digits)),
        host.count("."), last.isalpha() and last.isascii(), len(last), "@" in s, bool(re.search(r"[a-z0-9]\W{0,2}\bat\b", s, re.I)),
        bool(CUES[KINDS[kind]].search(left)), bool(AGAINST.search(left)), left[-1:].isalnum(), left[-1:] in "$€£#.", text[end : end + 1].isalnum(),
    ]


def _training_rows(n: int, seed: int = 5):
    """Made-up strings in made-up context: (text, start, kind, end, label)."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card(k: int) -> str:
        body = rng.choice("3456") + num(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def cut(s: str, sizes, mark: str) -> str:
        parts, at = [], 0
        for k in sizes:
            parts.append(s[at : at + k])
            at += k
        return mark.join(p for p in [*parts, s[at:]] if p)

    tld = lambda: rng.choice(["com", "org", "net", "de", "io", "fr", "info"])
    part = lambda: str(rng.randint(0, 255))
    yes = {
        0: [lambda: f"{word()}.{word()} at {word()} dot {tld()}", lambda: f"{word()}{num(2)}[at]{word()}[dot]{tld()}", lambda: f"{word()} (at) {word()} (dot) {tld()}", lambda: f"{word()}@{word()}.{tld()}"],
        1: [lambda: "[.]".join(part() for _ in range(4)), lambda: "(.)".join(part() for _ in range(4)), lambda: ".".join(part() for _ in range(4))],
        2: [lambda: cut(card(16), (4, 4, 4), "."), lambda: card(13), lambda: cut(card(15), (4, 6), "/"), lambda: cut(card(16), (4, 4, 4), rng.choice("- "))],
        3: [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{rng.choice('23456789')}{num(2)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0044 {num(2)} {num(4)} {num(4)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"+{num(2)} {num(3)} {num(4)} {num(3)}"],
    }
    no = {
        0: [lambda: f"{word()}@{word()}", lambda: f"@{word()}@{num(3)}", lambda: f"{word()} at {word()} dot {num(2)}", lambda: f"{word()}@{num(2)}.{num(1)}"],
        1: [lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}.{rng.randint(256, 999)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4))],
        2: [lambda: num(13), lambda: num(16), lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}.{num(2)}.{num(2)}", lambda: cut(num(16), (4, 4, 4), "-"), lambda: f"978-{num(1)}-{num(3)}-{num(5)}-{num(1)}"],
        3: [lambda: num(rng.randint(7, 15)), lambda: f"20{num(2)}-{rng.randint(10, 12)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"{num(1)}.{num(9)}", lambda: f"20{num(2)}-20{num(2)}", lambda: f"978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: cut(card(16), (4, 4, 4), " "), lambda: f"{num(2)}.{num(2)}.20{num(2)} {num(2)}"],
    }
    cues = {0: ["email", "mail me", "contact"], 1: ["ip", "server", "host"], 2: ["card", "visa", "payment"], 3: ["phone", "call", "tel", "mobile"]}
    against = ["isbn", "version", "order", "ref", "page", "date", "serial", "invoice"]
    for _ in range(n):
        kind, label = rng.randrange(4), rng.random() < 0.5
        s = rng.choice((yes if label else no)[kind])()
        lead = rng.choice(cues[kind]) if rng.random() < (0.45 if label else 0.08) else rng.choice(against) if rng.random() < (0.02 if label else 0.4) else word()
        before = f"{word()} {lead}{rng.choice(['', ':', ' is'])} "
        yield before + s + rng.choice([" ", ".", ", ", "\n"]) + word(), len(before), kind, len(before) + len(s), int(label)


def _overlapping_rows(n: int, seed: int = 6):
    """(text, start, kind, end, label) of what the generators propose, off the base spans, on made-up lines. A number's form
    doesn't settle what it is: the same forms stand for personal data and for others, more or less often by their context."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))

    def checked(k: int) -> str:
        body = rng.choice("3456") + num(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", a + b + c, f"0{num(2)} {num(4)} {num(4)}", f"00{num(2)} {a} {b} {c}"])

    def card() -> str:
        d, mark = checked(16), rng.choice(["/", ".", ""])
        return mark.join([d[:4], d[4:8], d[8:12], d[12:]]) if mark else checked(13)

    four = lambda top: [str(rng.randint(0, top)) for _ in range(4)]
    yes_cue = {2: ["card", "visa", "payment by", "billing"], 3: ["phone", "call", "tel.", "mobile", "fax", "contact"], 1: ["ip", "host", "server", "client"], 0: ["mail", "write to", "contact"]}
    no_cue = ["order", "ref", "invoice", "serial", "version", "build", "total", "page"]
    for _ in range(n):
        what, cue = rng.randrange(10), rng.random()
        lead, true = words(2), True
        if what <= 2:  # phones, and other numbers written alike
            kind, s = 3, phone()
            true = rng.random() < (0.99 if cue < 0.4 else 0.04 if cue < 0.7 else 0.96 if not s.isdigit() else 0.05)
        elif what == 3:  # a base phone pattern that has swallowed what follows
            kind, s = 3, f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"
        elif what == 4:  # cards, and account numbers that happen to pass the checksum
            kind, s = 2, card()
            true = rng.random() < (0.99 if cue < 0.4 else 0.06 if cue < 0.7 else 0.96)
        elif what == 5:  # numbers of a card's length
            kind, s, true = 2, num(rng.choice([13, 15, 16, 16, 16, 17])), False
        elif what == 6:
            kind, s = 1, rng.choice(["[.]", "(.)", " . "]).join(four(255 if cue < 0.8 else 999))
            true = all(int(g) <= 255 for g in GROUP.findall(s)) and rng.random() < (0.98 if cue < 0.4 else 0.1 if cue < 0.7 else 0.95)
        elif what == 7:
            kind, at, dot = 0, *rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", ".")])
            s = f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'de', 'net', word()])}"
            true = rng.random() < (0.98 if cue < 0.4 or at != " at " else 0.3)
        else:  # dates, ranges, prices, parts of tables
            kind, true = 3, False
            s = rng.choice([f"20{num(2)}-0{num(1)}-{num(2)} {num(2)}:{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(1)},{num(3)},{num(3)}", f"{num(7)}", f"{num(4)}-{num(4)}", f"978-{num(1)}-{num(3)}-{num(5)}-{num(1)}"])
        if cue < 0.4:
            lead = f"{word()} {rng.choice(yes_cue[kind] if true or what <= 7 else no_cue)}{rng.choice(['', ':', ' is', ' no.'])}"
        elif cue < 0.7:
            lead = f"{word()} {rng.choice(no_cue)}{rng.choice(['', ':', ' #', ' no.'])}"
        between = rng.choice([" | ", ", ", " ", "\n"])
        tail = rng.choice([words(2), num(16), f"{num(2)} {word()}", f"| {num(8)} |"]) if what != 3 else f"{num(16)} {word()}"
        before = lead + (between if rng.random() < 0.3 else " ")
        text = before + s + (" " if what == 3 else between) + tail
        taken = _Taken()
        for a, _, b in base_spans(text):
            taken.add(a, b)
        for a, k, b in proposals(text):
            if taken.free(a, b):
                yield text, a, k, b, int(true and (a, k, b) == (len(before), kind, len(before) + len(s)))


class _Taken:
    """Spans by cells of 256 characters, so that a look-up doesn't pass over all of them."""

    def __init__(self):
        self.cells: dict[int, list[tuple[int, int]]] = {}

    def add(self, start: int, end: int) -> None:
        for c in range(start // 256, end // 256 + 1):
            self.cells.setdefault(c, []).append((start, end))

    def free(self, start: int, end: int) -> bool:
        return not any(start < b and a < end for c in range(start // 256, end // 256 + 1) for a, b in self.cells.get(c, ()))


@dataclass
class Detector:
    trees: boosting.Trees
    scale: tuple[float, float]
    thresholds: list[float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(a * self.trees.margin(x) + b, -30, 30)))

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans."""
        base = base_spans(text)
        taken = _Taken()
        for s, _, e in base:
            taken.add(s, e)
        loose = [p for p in proposals(text) if taken.free(p[0], p[2])]
        if not loose:
            return base, base
        p = self.probability(np.array([features(text, *x) for x in loose], float))
        added: list[tuple[int, int, int]] = []
        for k in sorted(range(len(loose)), key=lambda k: (-p[k], loose[k])):
            s, kind, e = loose[k]
            if p[k] >= self.thresholds[kind] and taken.free(s, e):
                added.append(loose[k])
                taken.add(s, e)
        return base, sorted(base + added)


@lru_cache(1)
def detector() -> Detector:
    """Trees from half of the rows; a quarter calibrates the scale and another the thresholds."""
    rows = [*_training_rows(TRAINING), *_overlapping_rows(TEXTS)]
    random.Random(7).shuffle(rows)
    x = np.array([features(t, s, k, e) for t, s, k, e, _ in rows], float)
    y, kind = np.array([r[4] for r in rows], float), np.array([r[2] for r in rows])
    fitted, scaled = len(rows) // 2, len(rows) * 3 // 4
    trees = boosting.fit(x[:fitted], y[:fitted])
    made = Detector(trees, boosting.platt(trees.margin(x[fitted:scaled]), y[fitted:scaled]), [])
    p, y, kind = made.probability(x[scaled:]), y[scaled:], kind[scaled:]
    #: A span that is likelier something else is never taken, whatever precision the others leave room for.
    made.thresholds = [max(LIKELIER, boosting.threshold(p[kind == k], y[kind == k], PRECISION)) for k in range(4)]
    return made


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, found: Detector) -> str | None:
    """Each run of overlapping spans becomes the name of its first span's kind, as [EMAIL]."""
    if not text:
        return text
    out, at = [], 0
    for s, k, e in found.spans(text)[1]:
        if s >= at:
            out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans, one row for each row of docs.

    A null text counts as empty: no spans. Repeated rows stay, an empty table gives no rows, other
    columns are not read.
    """
    found = detector()

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = found.spans(t.as_py() or "")
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = ["int64"] * 4 + ["string"] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], NAMES)

    return frugal(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES)))


NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
TYPES = ["long"] * 5 + ["string"] * 2


def redact_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with all spans of one string column replaced; other columns, null and empty texts and repeated rows stay, and an
    empty table gives no rows."""
    found = detector()
    others = [c for c in docs.columns if c.lower() != column.lower()]
    rows = frugal(docs).select(F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in others]).alias("_rest"), F.col(column).alias("_text"))

    def run(batches):
        for b in batches:
            texts = [redact(t.as_py(), found) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, "string")], ["_rest", "_text"])

    made = rows.mapInArrow(lean(run), rows.schema)
    return made.select(*[F.col("_rest")[c].alias(c) if c in others else F.col("_text").alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find() over documents: the same rules for nulls, repeats and empty tables."""
    return find(table(spark, sf_dir, "documents"))
