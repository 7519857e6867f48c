"""URL filter, mixing, neighbours, classifiers and the pipeline."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.llm import ann, boosting, labelled, mixing, quality, textbatch, toxicity, url_filter
from siteflux.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


# --- URL filter

def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:k].translate({i: i + 32 for i in range(65, 91)}), rest[k:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    canon = re.sub(r":[0-9]*\Z", "", host.rpartition("@")[2]).rstrip(".")
    listed = any(canon == x[:-1] or canon.endswith("." + x[:-1]) for x in url_filter.LISTED) and path.startswith("/")
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if listed else "allow"


def test_url_filter(spark, clash):
    urls = [None, "", "nothing", "http://", "http://COM", "http://com/", "https://a.com/x?y#z", "http://example.com/en/1", "http://www.example.com/en/1", "http://x.www.example.com/en",
            "ftp://A.net/es/", "http://net/fr", "http://net/fr/x/", "http://m.net/de//", "http://xnet/es/", "http://adult-x.example.org/", "http://spam-farm.example.org/q", "http://a.spam-farm.example.org", "http://me:x@ads-track.example.com:8080/a", "http://b.Spam-Farm.example.org./", "http://@spam-farm.example.org:/", "http://spam-farm.example.org:80x/",
            "x://h?://y/", "http://com:80/", "http://ex\nample.net/es/\n", "http://É.com/É", "http://" + "a." * 300 + "net/es/" + "b/" * 500, "http://com/", "http://com/"]
    pages = spark.createDataFrame([(i if i % 7 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(clash(pages), url_filter.entries(spark, url_filter.RULES, url_filter.LISTED)).collect()), key=repr)
    want = sorted(((i if i % 7 else None, *plain_verdict(u)) for i, u in enumerate(urls)), key=repr)
    assert got == want
    assert url_filter.judge(pages.limit(0), url_filter.entries(spark, url_filter.RULES, [])).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    bloom = url_filter.blocked_bloom(keys, "key", 3000)
    assert bloom.may_hold(keys, "key").count() == 3000
    others = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id")).alias("key"))
    assert bloom.may_hold(others, "key").count() < 600


# --- mixing

def plain_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        more = {s for s in names if s not in full and t[s] > 3 * sizes[s]}
        if not more:
            return t
        full |= more


def test_mixing(documents, clash):
    rng = random.Random(4)
    texts = [None, "", *[" ".join("w" for _ in range(rng.randint(0, 60))) for _ in range(200)]]
    sources = [rng.choice(["b", "a", None, "é", "hot", "hot", "hot", "hot"]) for _ in texts]
    rows = mixing.mix(clash(documents(texts, sources))).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = plain_targets(sizes), {}
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    plain = lambda r: repr([v for k, v in sorted(r.asDict().items()) if k != "row"])  # noqa: E731  the hash is of all columns
    assert sorted(map(plain, rows)) == sorted(map(plain, mixing.mix(documents(texts, sources)).collect()))
    out = mixing.mixed_documents(clash(documents(texts, sources)))
    assert "_key" in out.columns and abs(out.select(F.sum(F.size(F.split("text", " ")))).first()[0] - sum(want.values())) < 60 * len(want)


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    sizes = {None: 40, "": 3, **{f"s{k}": rng.choice([0, 1, 5, 5, 400]) for k in range(900)}}
    rows = spark.createDataFrame([(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()], "source string, size long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many range-sorted parts
    try:
        got = {r["source"]: r for r in mixing.source_targets(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s]["target"], want[s], rel_tol=1e-9) and got[s]["source_size"] == sizes[s] for s in want)
    names = sorted(sizes, key=lambda s: (s is None, s))
    assert [got[s]["weight"] for s in names] == [k % 3 + 1 for k in range(len(names))]


def test_mixing_edges(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents([None, "", " "])).collect()] == [0, 0, 0]
    twins = documents([(1, "a b"), (1, "a b")]).withColumn("extra", F.monotonically_increasing_id())
    out = mixing.mixed_documents(twins).groupBy("extra").count().collect()
    assert [r["count"] for r in out] == [1, 1]  # each variant as often as the other
    same = mixing.mix(documents([(1, "a b"), (1, "a b"), (None, "a b")])).collect()
    assert sum(r["taken"] for r in same) == 6


def test_positions_invert_the_schedule(spark):
    for a in mixing.SLOPES:
        d = spark.range(101).select((F.col("id") / 100.0).alias("u"))
        got = d.select("u", mixing.position_of(F.col("u"), F.lit(a)).alias("t")).collect()
        assert all(abs(r["t"] + a * (r["t"] ** 2 - r["t"]) - r["u"]) < 1e-12 and 0 <= r["t"] <= 1 for r in got)


# --- neighbours

def plain_neighbours(rows, k, every):
    ok = [(i, np.array(v, "float32").astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in ok if j != i))[:k]
    return out


def test_neighbours_small_is_exact(spark, clash):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, rows_v) for i, rows_v in enumerate([[1.0] * 8] * 40)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (None, [1.0] * 8), (480, [float("inf")] * 8)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_neighbours(rows, 20, 20)
    assert set(got) == set(want) and all(got[q] == [j for _, j in want[q]] for q in want)


def test_neighbours_of_repeated_rows(spark):
    """Equal vectors under many ids and rows, an id with several vectors, and an id repeated above k times."""
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(100, 160)] + [(i, [3.0] * 4) for i in range(30)] * 2
    rows += [(201, [-3.0, 3.0, 0.0, 0.0])] * 25 + [(i, [-3.0, 3.0, 0.0, 0.0]) for i in range(202, 230)]
    rows += [(240, [0.0, 0.0, 5.0, -5.0 - i / 8]) for i in range(30)] + [(i, [0.0, 0.0, 4.0, -4.0]) for i in range(241, 270)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault((r["query_id"], r["rank"]), set()).add((r["vec_id"], round(r["score"], 6)))
    want, ok = {}, [(i, np.array(v, "float32").astype(float)) for i, v in rows]
    for i, q in ok:
        if i % 20 == 0:
            for rank, (s, j) in enumerate(sorted((-float(q @ v), j) for j, v in ok if j != i)[:20], 1):
                want.setdefault((i, rank), set()).add((j, round(-s, 6)))
    assert got == want


def test_neighbours_in_doubles_and_split_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_HELD", 16), monkeypatch.setattr(ann, "MOST_ASKING", 64), monkeypatch.setattr(ann, "LIST_SIZE", 32), monkeypatch.setattr(ann, "MOST_LISTS", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) * 1e39 + 1e-9
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 5, 20).collect()
    found = {}
    for r in got:
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), rel=1e-12)
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(found[q] & set(sorted((j for j in range(400) if j != q), key=lambda j: -(x[q] @ x[j]))[:5])) for q in range(0, 400, 20)]
    assert len(got) == 100 and sum(hits) >= 90


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in range(0, 6000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        hit, total = hit + len(best & got[q]), total + 20
    assert hit / total >= 0.9


def test_neighbours_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect()] == [(0, 1, 1, 4.0)]
    assert ann.search(df.limit(0)).count() == 0


# --- classifiers

def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    t = boosting.fit(x[:1500], y[:1500], rounds=40)
    m = t.margin(x[1500:])
    assert ((m > 0) == y[1500:]).mean() > 0.9
    a, b = boosting.platt(m, y[1500:])
    p = 1 / (1 + np.exp(-(a * m + b)))
    cut = boosting.threshold(p, y[1500:], 0.95)
    assert y[1500:][p >= cut].mean() >= 0.95


def _toxic(rng, n):
    docs = []
    for i in range(n):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "moron,", "Idiot"]))
        docs.append((i, " ".join(w), int(bad)))
    return docs


def test_toxicity(spark, documents, clash):
    rows = _toxic(random.Random(2), 900)
    docs = documents([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "word " * 20_000), (None, "scum moron idiot scum")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(clash(docs), net).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held) and sum(r["predicted"] == y for r, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values()) and got[9001]["score"] == got[9002]["score"]
    assert not got[None]["held_out"]


def test_classifiers_without_labels(spark, documents):
    docs, none = documents(["a b", None]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert quality.select(docs, none).count() == 2
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_long_texts_score_in_pieces():
    rng = np.random.default_rng(0)
    net = toxicity.train(toxicity.encode([b"good words here", b"scum words here"] * 40), np.array([0.0, 1.0] * 40))
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 50, n)) + b" scum" * (n % 2) for n in (0, 1, 5, 400, 1001)]
    coded = toxicity.encode(texts)
    assert np.allclose(net.margins(coded, room=64), net.margins(coded), atol=1e-5)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [b"", b"one", *[b" ".join([b"Word%d" % k for k in rng.integers(0, 9, n)]) for n in (5, 400, 900)], b"same " * 90]
    net = toxicity.train(toxicity.encode([b"good words here", b"scum words here"] * 40), np.array([0.0, 1.0] * 40))
    model = quality.Ordinal(rng.normal(size=quality.BUCKETS), np.array([-0.2, 0.3]))
    whole, tails = net.scores(toxicity.encode(texts)), model.tails(quality.encode(texts))
    cut_at = lambda t: iter([t[:60], t[60:61], t[61:]] if t[60:61].isspace() else [t])
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "PIECE", 50)
        monkeypatch.setattr(module, "pieces", lambda t: textbatch.pieces(t, 40))
    assert np.allclose(net.scores_of(texts), whole, atol=1e-6) and np.allclose(model.tails_of(texts), tails)
    monkeypatch.setattr(quality, "pieces", cut_at)
    assert np.allclose(model.tails_of(texts), tails)


def test_long_texts_need_little_memory():
    import tracemalloc

    text = b"Lorem ipsum, dolor sit amet %d " * 600_000
    net = toxicity.train(toxicity.encode([b"good words here", b"scum words here"] * 40), np.array([0.0, 1.0] * 40))
    model = quality.Ordinal(np.zeros(quality.BUCKETS), np.array([-0.2, 0.3]))
    for f in (net.scores_of, model.tails_of):
        f([text[: 1 << 21]])
        tracemalloc.start()
        f([text])
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()


def test_ordinal_gradient_equals_loops():
    """The likelihood falls to what a plain search by differences can't better."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (300, 6))
    score = (x == 1).sum(1) - (x == 2).sum(1) + rng.logistic(size=300)
    grade = np.where(score < -1, 0, np.where(score < 1, 1, 2))
    coded = [np.array([10 + v for v in row], "int32") for row in x]
    counts = np.bincount(grade, minlength=3)
    model = quality.train(coded, grade, counts)

    def loss(weights, cuts):
        total = 0.0
        for row, g in zip(x, grade):
            s = 3.0 * sum(weights[10 + v] for v in row) / len(row)
            above = [1.0, *[1 / (1 + np.exp(c - s)) for c in cuts], 0.0]
            total -= np.log(max(above[g] - above[g + 1], 1e-12))
        return total / len(grade) + quality.DECAY / 2 * sum(weights[10 + v] ** 2 for v in range(4))

    best = loss(model.weights, model.cuts)
    assert best < loss(np.zeros(quality.BUCKETS), model.cuts) - 0.05
    for k in range(4):
        for d in (0.2, -0.2):
            w = model.weights.copy()
            w[10 + k] += d
            assert loss(w, model.cuts) > best - 1e-3
    for k in range(2):
        for d in (0.1, -0.1):
            c = model.cuts.copy()
            c[k] += d
            assert loss(model.weights, c) > best - 1e-3


def test_quality(spark, documents, clash):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randint(0, 200)}" for _ in range(60)) for _ in range(300)]
    junk = [" ".join(f"W{rng.randint(0, 200)}%%%" for _ in range(60)) for _ in range(80)]
    docs = documents([*good, *junk, None, ""])
    labels = spark.createDataFrame([(i, int(i < 300), int(i % 10 == 0)) for i in range(380)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert (np.diff(model.cuts) >= 0).all()
    kept = {r["doc_id"] for r in quality.select(clash(docs), labels).collect()}
    held = [i for i in range(380) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in kept) == (i < 300) for i in held) / len(held) > 0.97 and {380, 381} <= kept
    out = quality.score(docs, model).collect()
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)


def sorted_apart(docs, apart):
    """The flags must follow the ids as the DataFrame form of the rule has them."""
    known = {r["doc_id"]: r["a"] for r in docs.select("doc_id", labelled.kept_apart(F.col("doc_id")).alias("a")).collect()}
    assert all(known[i] == (zlib.crc32(str(i).encode()) // 3 % 4 == 3) for i in known)
    return apart.tolist()


def slow_score(net, text):
    """The network's margin for one text, word by word and filter by filter."""
    ids = toxicity.encode([text])[0].reshape(2, -1)
    rows = [net.tables[0][a] + net.tables[1][b] for a, b in ids.T] + [np.zeros(toxicity.SIZE)] * toxicity.PAD
    total, k = net.bias, 0
    for f in net.filters:
        for unit in range(toxicity.FILTERS):
            best = 0.0  # of a window of padding alone
            for at in range(len(rows) - toxicity.PAD):
                best = max(best, sum(float(w @ f[j][:, unit]) for j, w in enumerate(rows[at : at + len(f)])))
            total += max(best + net.shift[k], 0) * net.top[k]
            k += 1
    return total


def test_network_equals_loops():
    net = toxicity.train(toxicity.encode([b"good words here", b"scum words here"] * 40), np.array([0.0, 1.0] * 40))
    texts = [b"good scum here words", b"words", b"a b c d e scum scum", b"here good words good"]
    assert np.allclose(net.margins(toxicity.encode(texts[::-1]))[::-1], net.margins(toxicity.encode(texts)), atol=1e-5)  # neighbours don't matter
    assert np.allclose(net.margins(toxicity.encode(texts)), [slow_score(net, t) for t in texts], atol=1e-4)


def test_ordinal_steps_lower_the_likelihood():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh"[: 3 + 2 * (i % 3)]) for _ in range(12)).encode() for i in range(150)]
    grade = np.array([i % 3 for i in range(150)])
    coded, counts = quality.encode(texts), np.bincount(grade)
    model = quality.train(coded, grade, counts)

    def loss(m):
        tails = np.concatenate([np.ones((150, 1)), m.tails(coded), np.zeros((150, 1))], 1)
        return -sum(math.log(max(1e-12, tails[i, g] - tails[i, g + 1])) for i, g in enumerate(grade)) / 150 + quality.DECAY / 2 * float(m.weights @ m.weights)

    base = loss(model)
    blank = quality.Ordinal(np.zeros(quality.BUCKETS), -np.log(np.array([2 / 3, 1 / 3]) / np.array([1 / 3, 2 / 3])))
    assert base < loss(blank) - 0.1
    used = np.flatnonzero(model.weights)[:5]
    for k in used:  # near the minimum: no step along a weight gains much
        for h in (0.05, -0.05):
            w = model.weights.copy()
            w[k] += h
            assert loss(quality.Ordinal(w, model.cuts)) > base - 0.01


def test_sample_is_bounded(spark, documents, monkeypatch):
    monkeypatch.setattr(labelled, "ROWS_PER_GRADE", 7)
    docs = documents([f"t {i}" for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] * 2, "doc_id long, quality int, toxic int")
    coded, grade, counts, apart = labelled.sample(docs, labels, F.col("toxic"), 2, toxicity.encode)
    assert apart.tolist() == sorted_apart(docs, apart) and len(coded) == len(grade) == 14 and counts.sum() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))


# --- pipeline

def test_pipeline(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "near_dedup", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
    out = c.run(spark, SF)
    assert out.count() == docs.count() and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def _shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(textbatch.LOWER))
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_equal_plain_versions(spark, documents, clash):
    """Near-dedup, PII, mixing and BPE on rows with nulls, empties, repeats, copies and columns of clashing names."""
    import hashlib

    import corpus_pipeline as c
    from siteflux.llm import pii

    rng = random.Random(31)
    base = [" ".join(rng.choice("red green blue cyan pink gold gray teal".split()) + str(rng.randint(0, 40)) for _ in range(n)) for n in (80, 60, 40, 7, 3, 1)]
    texts = [*base, base[0] + " tail", base[0].upper(), base[1] + " x y", None, "", " \n", "mail joe@x.org now please sir", "call +1 (578) 555-6437 5755695738806562 or not", base[2], base[2]]
    stages = dict(c.STAGES)
    docs = clash(documents(texts))
    columns = docs.columns
    kept = stages["near_dedup"](spark, docs, SF)
    assert kept.columns == columns
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert got == {i for i in range(len(texts)) if root[i] == i}
    clean = stages["pii"](spark, kept, SF)
    assert clean.columns == columns
    for r in clean.collect():
        assert (r["text"] is None) == (texts[r["doc_id"]] is None) and pii.base_spans(r["text"] or "") == []
        assert r["text"] == texts[r["doc_id"]] or "[" in r["text"]
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    read = mixed.collect()
    assert all(words(r["text"]) for r in read)
    assert sum(words(r["text"]) for r in read) == sum(words(r["text"]) for r in clean.collect())  # one source: each document once
    out = stages["bpe"](spark, mixed, SF).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in out) == sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in read)


def test_pipeline_of_nothing(spark, documents):
    import corpus_pipeline as c

    for rows in ([], [None, None], ["", " "]):
        docs = documents(rows)
        for name, stage in c.STAGES[1:]:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert name == "bpe" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.count() == 0
    assert c.STAGES[0][1](spark, documents([None, "", None]), SF).count() in (0, 3)  # all alike: as the labels' shares say


def test_audio_query_equals_plain_bytes(spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op10_mpeg_audio"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
