"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from siteflux.llm import simhash
from siteflux.llm.textbatch import LOWER

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    """A bit at a time."""
    w = WORD.findall((text or "").encode().translate(LOWER))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps, most):
    """The smallest fingerprint that each one reaches, over all pairs."""
    root = {f: f for f in fps}
    todo = True
    while todo:
        todo = False
        for a in fps:
            low = min(root[b] for b in fps if (a ^ b).bit_count() <= most)
            if low < root[a]:
                root[a], todo = low, True
    return root


def crowd(seed, n, flips=4):
    """Fingerprints around a few centres, with chains of small steps."""
    r, out = random.Random(seed), []
    for _ in range(3):
        f = r.getrandbits(64)
        for _ in range(n):
            for _ in range(r.randint(0, flips)):
                f ^= 1 << r.randrange(64)
            out.append(f)
    return sorted({*out, 0, (1 << 64) - 1})


@pytest.mark.parametrize(("most", "limit", "seed"), [(3, 1024, 1), (3, 8, 2), (3, 2, 3), (1, 4, 4), (0, 8, 5), (6, 8, 6)])
def test_links_join_what_brute_force_joins(spark, most, limit, seed):
    fps = crowd(seed, 40)
    signed = [int(np.uint64(f).astype("int64")) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.components(simhash.links(df, most, limit)).collect()
    root = {r["u"]: r["root"] for r in found}
    want = {np.uint64(a).astype("int64"): None for a in fps}
    groups, got = {}, {}
    for f, low in plain_components(fps, most).items():
        groups.setdefault(low, set()).add(int(np.uint64(f).astype("int64")))
    for s in signed:
        got.setdefault(root.get(s, s), set()).add(s)
    assert len(want) == len(fps) and {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}


def test_chain_is_pruned_and_loses_no_pair():
    fps = np.array(crowd(9, 60), "uint64")
    start = np.zeros(len(fps), "int64")
    found = set()
    for k, (a, w) in enumerate(simhash.segments(3)):
        node = (fps >> np.uint64(a)) & np.uint64((1 << w) - 1)
        order = np.argsort(node, kind="stable")
        for i, j in simhash.chained(node[order], start + k, fps[order], 3):
            found |= {frozenset((int(x), int(y))) for x, y in zip(fps[order][i], fps[order][j])}
    every = [int(f) for f in fps]
    assert found == {frozenset((a, b)) for a in every for b in every if a < b and (a ^ b).bit_count() <= 3}


def test_nodes_stay_small_or_become_block_pairs(spark):
    from pyspark.sql import functions as F

    same_half = [(k << 40) | 0x1234567 for k in range(300)]
    df = spark.createDataFrame([(f,) for f in same_half], "fp long")
    sizes = simhash._nodes(df, 3, 64).groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 128


def test_fingerprints_of_pieces_and_many_bits(monkeypatch):
    r = random.Random(3)
    texts = ["", " \t\n", "one", "Two words", "a b c", *[" ".join(r.choice("αß Ab c dd e".split(" ")) for _ in range(n)) for n in (4, 50, 3000)], "x " * 500]
    want = [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == want
    monkeypatch.setattr(simhash, "TOGETHER", 100)
    monkeypatch.setattr(simhash, "pieces", lambda t: [t[:7], t[7:]] if t[6:8].isspace() else iter([t]))
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == want


def test_near_fingerprints_equal_brute_force(spark, documents, clash):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (200, 300, 5, 3, 2, 1)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[0] + f" tail{k}") for k in range(12)] + [(200 + k, base[1].upper()) for k in range(20)]
    rows += [(300, None), (301, ""), (302, " \n"), (7, base[0]), (7, base[2]), (None, base[1]), (None, "only here alone of all"), (5, base[5])]
    got = simhash.near_fingerprints(clash(documents(rows))).collect()
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    root, low = plain_components(fps, 3), {}
    for i, t in rows:
        if i is not None:
            at = root[plain_fingerprint(t)]
            low[at] = min(i, low.get(at, i))
    want = sorted((repr(i), f"{plain_fingerprint(t):016x}", low.get(root[plain_fingerprint(t)])) for i, t in rows)
    key = lambda x: repr(x)
    assert sorted(((repr(g["doc_id"]), g["fingerprint"], g["component_id"]) for g in got), key=key) == sorted(want, key=key)


def test_empty_table(spark, documents):
    got = simhash.near_fingerprints(documents([]))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


def test_long_text_needs_little_memory():
    import tracemalloc

    text = b"lorem ipsum dolor sit amet " * 800_000
    simhash.fingerprints([text[: 1 << 20]])
    tracemalloc.start()
    simhash.fingerprints([text])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
