"""Vector codes and whitening against plain versions."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from siteflux.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v int, error long, part int"


def table_of(spark, rows, schema=SCHEMA):
    """Rows (vec_id, embedding, label) beside columns whose names the operators use inside."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], m, 1, 2, 3) for i, v, m in rows], schema)


def kept(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


# --- vector codes ---------------------------------------------------------------------------------------


def plain_codes(rows):
    rows = [(i, np.float32(v).astype(float).tolist(), m) for i, v, m in kept(rows)]
    dim = -(-max((len(v) for _, v, _ in rows), default=0) // 4) * 4
    w = dim // 4
    xs = [[math.floor(1024 * c) for c in v] + [0] * (dim - len(v)) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:256]
    books = [[xs[k][p * w : p * w + w] for k in first] for p in range(4)]

    def assign(x, p):
        part = x[p * w : p * w + w]
        d = [sum((a - b) ** 2 for a, b in zip(part, c)) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(4):
        codes = [[assign(x, p)[0] for p in range(4)] for x in xs]
        for p in range(4):
            for e in range(len(books[p])):
                mine = [x[p * w : p * w + w] for x, c in zip(xs, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[assign(x, p) for p in range(4)] for x in xs]
    errors = [sum(d for _, d in f) for f in found]
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    by = {}
    for (_, _, m), e in zip(rows, errors):
        by[m] = by.get(m, 0) + e
    return sorted((repr(i), "".join(f"{c:02x}" for c, _ in f), e, by[m], sha) for (i, _, m), f, e in zip(rows, found, errors))


def got_codes(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(df).collect())


def test_nearest_equals_whole_distances():
    r = np.random.default_rng(1)
    for dim, n, spread in ((16, 256, 50), (16, 256, 2), (1, 9, 3), (3, 40, 2), (5, 1, 9)):
        x, book = r.integers(-spread, spread, (700, dim)), r.integers(-spread, spread, (n, dim))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        index, error = vector_codes.nearest(x, book)
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()


def test_codes_equal_plain_version(spark):
    r = np.random.default_rng(2)
    rows = [(1000 - k, r.normal(size=8).round(1), int(k % 3) if k % 7 else None) for k in range(330)]
    rows += [(5, None, 1), (6, [1.0, None] * 4, 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] + [0.0] * 7, None), (9, [0.0] * 8, 2), (9, [0.0] * 8, 2), (None, [0.5] * 8, 0)]
    rows += [(11, [0.25] * 3, 4), (12, [], 4)]
    assert got_codes(table_of(spark, rows)) == plain_codes(rows)


@pytest.mark.parametrize("dim", [4, 6, 0])
def test_codes_of_few_rows(spark, dim):
    rows = [(k, [k / 3 - c for c in range(dim)], None) for k in range(5)] + [(2, [1.0] * dim, 1)]
    assert got_codes(table_of(spark, rows)) == plain_codes(rows)


def test_codes_of_nothing(spark):
    assert got_codes(table_of(spark, [])) == [] == got_codes(table_of(spark, [(1, None, None)]))
    columns = vector_codes.compressed(table_of(spark, [])).columns
    assert columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_refuse_what_a_long_cannot_hold(spark):
    with pytest.raises(ArithmeticError):
        vector_codes.compressed(table_of(spark, [(1, [1e30] * 4, 1)]))


# --- whitening ------------------------------------------------------------------------------------------


def plain_fit(rows):
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return xs, n, sums, y, v


def test_products_are_exact():
    r = np.random.default_rng(3)
    for most in (5, 1 << 20, (1 << 35) + 7, (1 << 61) - 1):
        y = r.integers(-most, most, (5000, 3), endpoint=True)
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.products(y, most) == want).all() and (whitening.products(y.astype(object), most) == want).all()
        assert sum(d.astype(object) << (whitening.DIGIT * k) for k, d in enumerate(whitening.digits(want))).tolist() == want.tolist()


def test_whitened_equals_plain_version(spark):
    r = np.random.default_rng(4)
    mixing = r.normal(size=(20, 20)) * np.linspace(3, 0.2, 20)
    rows = [(k, np.float32(r.normal(size=20) @ mixing).tolist(), 1) for k in range(300)]
    rows += [(k + 500, rows[k][1], 2) for k in range(40)] + [(3, rows[9][1], 1), (None, rows[1][1], 1), (800, [0.0] * 20, None)]
    odd = [(900, None, 1), (901, [None] * 20, 1), (902, [float("nan")] * 20, 1), (903, [float("-inf")] + [1.0] * 19, 1)]
    got = whitening.whitened(table_of(spark, rows + odd)).collect()
    xs, n, sums, y, v = plain_fit(rows)
    e, u = np.linalg.eigh(np.array([[float(c) for c in line] for line in v]))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 16 * len(rows) and {g["n"] for g in got} == {n}
    by = {}
    for g in got:
        by.setdefault(repr(g["vec_id"]), []).append(g)
    sign = {}
    for (i, _, _), x in zip(rows, xs):
        centred = [n * a - s for a, s in zip(x, sums)]
        here = [g for g in by[repr(i)] if int(g["deviation"]) == sum(c * c for c in centred)]
        assert len(here) >= 16
        if i == 3:
            continue  # two rows have this id
        for g in here:
            k = g["component"] - 1
            want = sum(float(Fraction(c, n)) * w for c, w in zip(centred, u[:, k])) / math.sqrt(e[k])
            if abs(want) > 1e-3:
                sign.setdefault(k, math.copysign(1, want * g["whitened"]))
            assert abs(g["whitened"] - sign.get(k, 1) * want) < 1e-8
            assert abs(g["explained"] - e[k] / e.sum()) < 1e-9 and g["identity_error"] == got[0]["identity_error"] < 1e-9
    assert len(sign) == 16


def test_identity_error_is_of_the_fit_list(spark):
    r = np.random.default_rng(5)
    rows = [(k, np.float32(r.normal(size=4)).tolist(), 1) for k in range(200)]
    once = whitening.whitened(table_of(spark, rows + rows[:50])).toPandas().drop_duplicates(["vec_id", "component"])
    w = once.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (200, 4)
    cov = (w - w.mean(0)).T @ (w - w.mean(0)) / len(w)
    assert np.abs(cov - np.eye(4)).max() < 1e-9


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [2.0, 2.0], 1), (3, [3.0], 1)]])
def test_few_rows_and_components_without_variance(spark, rows):
    got = whitening.whitened(table_of(spark, rows)).collect()
    assert len(got) == 2 * len(rows) and all(math.isfinite(g["whitened"]) and math.isfinite(g["explained"]) for g in got)
    assert {g["identity_error"] < 1e-9 for g in got} == {True}


def test_large_components_stay_exact(spark):
    rows = [(k, [float(k * k << 40), -float(k << 30), 1.0], 1) for k in range(1, 30)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(table_of(spark, rows)).collect()}
    xs, n, sums, _, _ = plain_fit(rows)
    assert got == {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for (i, _, _), x in zip(rows, xs)}


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        got = whitening.whitened(table_of(spark, rows))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
