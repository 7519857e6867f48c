"""Weights, logistic fits, reweighting, extreme values, skill, random fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import bernoulli, logistic
from .iterate import cut


def normalized(df: DataFrame, by: str, weight: str) -> DataFrame:
    """weight as a share of its group's sum; a group without any weight gets equal shares."""
    w = Window.partitionBy(by)
    total = F.sum(weight).over(w)
    share = F.when(total > 0, F.col(weight) / F.when(total > 0, total)).otherwise(1.0 / F.count("*").over(w))
    return df.withColumn(weight, share)


def uniform_weights(df: DataFrame, by: str, name: str = "candidate_weight") -> DataFrame:
    return df.withColumn(name, 1.0 / F.count("*").over(Window.partitionBy(by)))


def fit_logistic(df: DataFrame, x: str, y: str, weight: str | None = None, c: float | None = 1.0, steps: int = 50, tol: float = 1e-10, start: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression with an L2 penalty of 1 / (2 c) on the
    slope (none, if c is None). Newton steps from start; each is one aggregate of five numbers."""
    b0, b1 = start
    w = F.col(weight) if weight else F.lit(1.0)
    for _ in range(steps):
        p = logistic(F.lit(b0) + F.lit(b1) * F.col(x))
        g, h = w * (F.col(y) - p), w * p * (1.0 - p)
        r = df.agg(F.sum(g), F.sum(g * F.col(x)), F.sum(h), F.sum(h * F.col(x)), F.sum(h * F.col(x) * F.col(x))).first()
        if r[0] is None:
            return b0, b1
        ridge = 0.0 if c is None else 1.0 / c
        hess = np.array([[r[2], r[3]], [r[3], r[4] + ridge]]) + 1e-12 * np.eye(2)
        step = np.linalg.solve(hess, np.array([r[0], r[1] - ridge * b1]))
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        b0, b1 = b0 + float(step[0]), b1 + float(step[1])
        if float(np.abs(step).max()) < tol:
            break
    return b0, b1


def em_reweight(df: DataFrame, by: str, x: str, y: str, weight: str, tol: float = 1e-6, rounds: int = 100, keep: int = 5) -> tuple[DataFrame, float, float]:
    """Candidate weights by expectation maximisation, and the model's intercept and slope.

    The model is fitted with the weights; each record's weights then follow prior * p^y (1 - p)^(1 - y),
    normalized. Stops when no weight moves by tol. Lineage is cut every few rounds; only aggregates
    reach the driver."""
    state, b0, b1 = cut(normalized(df, by, weight).withColumn("_prior", F.col(weight))), 0.0, 0.0
    for k in range(rounds):
        b0, b1 = fit_logistic(state, x, y, weight, start=(b0, b1))
        p = logistic(F.lit(b0) + F.lit(b1) * F.col(x))
        new = normalized(state.withColumn("_w", F.col("_prior") * bernoulli(p, F.col(y))), by, "_w")
        if k % keep == keep - 1 or k < 2:
            new = cut(new)
        moved = new.agg(F.max(F.abs(F.col("_w") - F.col(weight)))).first()[0]
        state = new.drop(weight).withColumnRenamed("_w", weight)
        if moved is None or moved < tol:
            break
    return state.drop("_prior"), b0, b1


def l_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sample L-moments l1, l2 and the ratio t3 of each group, nulls left out."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    n = F.count("*").over(Window.partitionBy(*by)).cast("double")
    r = (F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1).cast("double")
    ranked = known.select(*by, F.col(value).cast("double").alias("x"), n.alias("n"), r.alias("r"))
    b1 = F.avg(F.col("x") * F.try_divide(F.col("r"), F.col("n") - 1))
    b2 = F.avg(F.col("x") * F.try_divide(F.col("r") * (F.col("r") - 1), (F.col("n") - 1) * (F.col("n") - 2)))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("l1"), b1.alias("b1"), b2.alias("b2"))
    l2 = 2 * F.col("b1") - F.col("l1")
    return out.select(*by, "n", "l1", l2.alias("l2"), F.try_divide(6 * F.col("b2") - 6 * F.col("b1") + F.col("l1"), l2).alias("t3"))


def gamma(x: Column) -> Column:
    """The gamma function by Lanczos' series, for x above 0.5."""
    # fixed values: the series for g = 7
    terms = [676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
    z = x - 1.0
    series = F.lit(0.99999999999980993)
    for i, t in enumerate(terms):
        series = series + F.lit(t) / (z + (i + 1.0))
    t = z + 7.5
    return F.lit(float(np.sqrt(2 * np.pi))) * F.pow(t, z + 0.5) * F.exp(-t) * series


def gev_return_level(moments: DataFrame, period: float) -> DataFrame:
    """shape (xi), scale, location and the return level of a generalised extreme value law by
    L-moments, with Hosking's approximation of the shape."""
    c = F.try_divide(F.lit(2.0), 3.0 + F.col("t3")) - float(np.log(2) / np.log(3))
    k = 7.8590 * c + 2.9554 * c * c
    near = F.abs(F.col("k")) < 1e-6
    g = gamma(1.0 + F.col("k"))
    scale = F.when(near, F.col("l2") / float(np.log(2))).otherwise(F.col("l2") * F.col("k") / ((1.0 - F.pow(F.lit(2.0), -F.col("k"))) * g))
    out = moments.withColumn("k", k).withColumn("scale", scale)
    euler = 0.5772156649015329
    location = F.when(near, F.col("l1") - euler * F.col("scale")).otherwise(F.col("l1") - F.col("scale") * (1.0 - g) / F.col("k"))
    out = out.withColumn("location", location)
    y = float(-np.log(1.0 - 1.0 / period))
    level = F.when(near, F.col("location") - F.col("scale") * float(np.log(y))).otherwise(F.col("location") + F.col("scale") * (1.0 - F.pow(F.lit(y), F.col("k"))) / F.col("k"))
    return out.withColumn("return_level", level).withColumn("shape", -F.col("k")).drop("k")


def _gev_terms(x: np.ndarray, there: np.ndarray, q: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, ...]:
    """Negative log likelihood of each row of x under q (location, log scale, shape), with gradient and Hessian: infinite off
    the support. y is log(1 + shape z) / shape and its slopes by the shape, as series near 0."""
    mu, s, xi = (q[:, k, None] for k in range(3))
    z = (x - mu) * np.exp(-s)
    t = np.where(there, 1 + xi * z, 1.0)
    fine = (t > 0).all(1) & (np.abs(q[:, 2]) < 1)
    t = np.where(t > 0, t, 1.0)
    flat = np.abs(xi * z) < 1e-2
    safe = np.where(xi == 0, 1.0, xi)
    powers = [(-1.0) ** k * z ** (k + 1) / (k + 1) for k in range(8)]
    y = np.where(flat, sum(p * xi**k for k, p in enumerate(powers)), np.log(t) / safe)
    w = np.exp(-y)
    each = np.where(there, s + (1 + xi) * y + w, 0.0)
    loss = np.where(fine, each.sum(1), np.inf)
    if not slopes:
        return (loss,)
    y1 = np.where(flat, sum(k * p * xi ** (k - 1) for k, p in enumerate(powers) if k), (z / t - y) / safe)
    y2 = np.where(flat, sum(k * (k - 1) * p * xi ** (k - 2) for k, p in enumerate(powers) if k > 1), (-((z / t) ** 2) - 2 * y1) / safe)
    a = 1 + xi - w
    fz, fzz, fx = a / t, (1 + xi) * (w - xi) / t**2, y + a * y1
    fzx, fxx = (1 + w * y1) / t - a * z / t**2, y1 * (2 + w * y1) + a * y2
    total = lambda v: np.where(there, v, 0.0).sum(1)
    scale = np.exp(-q[:, 1])
    g = np.stack([-total(fz) * scale, there.sum(1) - total(fz * z), total(fx)], 1)
    h = np.empty((len(x), 3, 3))
    h[:, 0, 0], h[:, 1, 1], h[:, 2, 2] = total(fzz) * scale**2, total(fzz * z * z + fz * z), total(fxx)
    h[:, 0, 1] = h[:, 1, 0] = total(fzz * z + fz) * scale
    h[:, 0, 2] = h[:, 2, 0] = -total(fzx) * scale
    h[:, 1, 2] = h[:, 2, 1] = -total(fzx * z)
    return loss, g, h


def gev_newton(x: np.ndarray, there: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Location, log scale and shape of each row of x (cells where there is true) by damped Newton steps on all rows at once,
    and whether the score equations hold. Rows are brought to mean 0 and deviation 1 first."""
    n = there.sum(1)
    mean = np.where(there, x, 0.0).sum(1) / np.maximum(n, 1)
    deviation = np.sqrt(np.where(there, (x - mean[:, None]) ** 2, 0.0).sum(1) / np.maximum(n, 1))
    unit = np.where(there, (x - mean[:, None]) / np.where(deviation > 0, deviation, 1.0)[:, None], 0.0)
    best, done = np.zeros((len(x), 3)), np.zeros(len(x), bool)
    sigma = np.sqrt(6) / np.pi
    for shape in (0.05, -0.1, 0.25, -0.3):
        rows = np.flatnonzero(~done & (deviation > 0))
        if not len(rows):
            break
        q = np.tile([-0.5772 * sigma, np.log(sigma), shape], (len(rows), 1))
        spread = np.abs(unit[rows]).max(1) / sigma + 1
        q[:, 2] = np.sign(shape) * np.minimum(abs(shape), 0.9 / spread)  # on the support
        still = np.arange(len(rows))
        for _ in range(rounds):
            part, on = unit[rows[still]], there[rows[still]]
            loss, g, h = _gev_terms(part, on, q[still])
            solved = np.abs(g).max(1) <= tol * n[rows[still]]
            done[rows[still[solved]]] = True
            still, part, on, loss, g, h = (v[~solved] for v in (still, part, on, loss, g, h))
            if not len(still):
                break
            values, vectors = np.linalg.eigh(h)
            bent = np.maximum(np.abs(values), 1e-3 * n[rows[still], None])
            step = -np.einsum("nij,nj->ni", vectors, np.einsum("nji,nj->ni", vectors, g) / bent)
            step *= np.minimum(1.0, 1.0 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
            open_, share = np.arange(len(still)), 1.0
            for _ in range(30):
                tried = q[still[open_]] + share * step[open_]
                better = _gev_terms(part[open_], on[open_], tried, slopes=False)[0] <= loss[open_] + 1e-12 * np.abs(loss[open_])
                q[still[open_[better]]] = tried[better]
                open_, share = open_[~better], share / 2
                if not len(open_):
                    break
            still = np.delete(still, open_)  # no step is better any more
            if not len(still):
                break
        good = done[rows]
        best[rows[good]] = q[good]
    best[:, 0], best[:, 1] = mean + deviation * best[:, 0], best[:, 1] + np.log(np.where(deviation > 0, deviation, 1.0))
    return best, done


def _gev_simplex(x: np.ndarray) -> np.ndarray:
    """Location, log scale and shape that a simplex search from several shapes ends at, for a series whose likelihood has no
    regular maximum."""

    def loss(q: np.ndarray, x: np.ndarray) -> float:
        mu, sigma, xi = q[0], np.exp(q[1]), q[2]
        z = (x - mu) / sigma
        if abs(xi) < 1e-8:
            return len(x) * np.log(sigma) + z.sum() + np.exp(-z).sum()
        t = 1 + xi * z
        if (t <= 0).any() or abs(xi) > 2:
            return np.inf
        return len(x) * np.log(sigma) + (1 + 1 / xi) * np.log(t).sum() + (t ** (-1 / xi)).sum()

    def simplex(start: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        points = [start] + [start + d for d in np.diag([0.1 * (x.std() + 1e-9), 0.1, 0.1])]
        values = [loss(p, x) for p in points]
        for _ in range(400):
            order = np.argsort(values)
            points, values = [points[i] for i in order], [values[i] for i in order]
            if np.isfinite(values[-1]) and values[-1] - values[0] < 1e-10:
                break
            mid = np.mean(points[:-1], 0)
            tries = [mid + a * (mid - points[-1]) for a in (1.0, 2.0, 0.5, -0.5)]
            got = [loss(p, x) for p in tries]
            best = int(np.argmin(got))
            if got[best] < values[-1]:
                points[-1], values[-1] = tries[best], got[best]
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [loss(p, x) for p in points[1:]]
        return values[0], points[0]

    sigma = x.std() * np.sqrt(6) / np.pi
    return min((simplex(np.array([x.mean() - 0.5772 * sigma, np.log(sigma), a]), x) for a in (0.0, 0.1, -0.1)), key=lambda r: r[0])[1]


#: Numbers of the series that are worked on at a time.
TOGETHER = 200_000


def gev_likelihood(df: DataFrame, by: list[str], value: str, period: float) -> DataFrame:
    """The same by maximum likelihood: Newton steps for all series of an Arrow batch at once. Groups of fewer than five
    values or of equal ones have null; where the likelihood has no maximum with a shape between -1 and 1, a simplex search ends
    somewhere. A series is one row in a task, as a cell's yearly maxima are few."""
    x = F.col(value).cast("double")
    series = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(~F.isnan(x), x))).alias("_x"))
    y, kinds = float(-np.log(1 - 1 / period)), dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = 0
            sizes = pc.list_value_length(b.column(len(by))).to_numpy()
            while a < b.num_rows:
                z = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), TOGETHER)))
                part, width = b.slice(a, z - a), max(1, int(sizes[a:z].max()))
                there = np.arange(width) < sizes[a:z, None]
                values = np.zeros(there.shape)
                values[there] = part.column(len(by)).flatten().to_numpy()
                there &= sizes[a:z, None] >= 5
                q, ok = gev_newton(values, there)
                for k in np.flatnonzero(~ok & (np.where(there, values, values[:, :1]).std(1) > 0)):
                    q[k], ok[k] = _gev_simplex(values[k, there[k]]), True
                mu, sigma, xi = q[:, 0], np.exp(q[:, 1]), q[:, 2]
                small = np.abs(xi) < 1e-8
                level = mu + sigma * np.where(small, -np.log(y), (y**-xi - 1) / np.where(small, 1.0, xi))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(by)], *[pa.array(v, mask=~ok) for v in (xi, sigma, mu, level)]], [*by, "shape", "scale", "location", "return_level"])
                a = z

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["shape double", "scale double", "location double", "return_level double"])
    return series.mapInArrow(run, schema)


def gev_scores(df: DataFrame, fits: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n and the score equations of each group at its fitted shape, scale and location, per value and in units of the scale:
    0 at the maximum of the likelihood."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).join(fits, by)
    z, xi = (F.col(value) - F.col("location")) / F.col("scale"), F.col("shape")
    t = 1 + xi * z
    w = F.pow(t, -1 / xi)
    by_z = (1 + xi - w) / t
    by_shape = F.log(t) / xi + (1 + xi - w) * (z / t - F.log(t) / xi) / xi
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(by_z).alias("by_location"), F.avg(1 - by_z * z).alias("by_scale"), F.avg(by_shape).alias("by_shape"))


#: Ranks that tasks get a copy of; of more, those of groups of so many rows.
BROADCAST, WIDE = 100_000, 1 << 20


def _inside(known: DataFrame, state: DataFrame) -> DataFrame:
    """Rows between the bounds of their groups' ranks. Groups are too few to share the rows out by, so ranks go to the rows; where
    there are too many of them, only those of large groups do."""
    within = F.col("x").between(F.col("lo"), F.col("hi"))
    if state.count() <= BROADCAST:
        return known.join(F.broadcast(state), "g").filter(within)
    wide = F.broadcast(state.filter(F.col("n") > WIDE))
    rest = known.join(wide.select("g").distinct(), "g", "left_anti").join(state.filter(F.col("n") <= WIDE), "g")
    return known.join(wide, "g").unionByName(rest).filter(within)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 1024, small: int = 4096) -> DataFrame:
    """by, share and value: exact quantiles between the two nearest ranks, of groups of any size.

    A rank's value lies between bounds that tighten: rows between them are counted in bins, and the bounds become the least and
    largest value of the bin with the rank. Once few rows are left, or equal ones, the value is picked. No task holds more
    of a group than its bins or those few rows. Null, NaN and infinite values don't count; groups without others give no rows."""
    x = F.col(value).cast("double")
    known = df.filter(F.abs(x) < float("inf")).select(F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")).alias("g"), x.alias("x"))
    groups = known.groupBy("g").agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = (F.col("m") - 1) * F.col("share")
    wanted = cut(groups.select("*", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")).select("g", "m", "lo", "hi", "share", F.floor(place).alias("k"), (place - F.floor(place)).alias("part")))
    ranks = F.explode(F.array("k", F.least(F.col("k") + 1, F.col("m") - 1))).alias("rank")
    state, done = wanted.select("g", ranks, "lo", "hi", "m", F.lit(0).cast("long").alias("before"), F.col("m").alias("n")).distinct(), None
    while True:
        state = cut(state)
        ready = state.filter((F.col("lo") == F.col("hi")) | (F.col("m") <= small))
        done = ready if done is None else done.unionByName(ready)
        state = state.filter((F.col("lo") < F.col("hi")) & (F.col("m") > small))
        if state.isEmpty():
            break
        inside = _inside(known, state)
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counts = inside.groupBy("g", "rank", "before", "n", F.least(F.lit(bins - 1), F.floor(share * bins)).alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        below = F.coalesce(F.sum("m").over(Window.partitionBy("g", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", F.col("before") + below).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
        state = counts.select("g", "rank", "lo", "hi", "m", "before", "n")
    equal = done.filter("lo = hi").select("g", "rank", F.col("lo").alias("v"))
    few = _inside(known, done.filter("lo < hi"))
    few = few.groupBy("g", "rank", "before").agg(F.sort_array(F.collect_list("x")).alias("s")).select("g", "rank", F.get("s", (F.col("rank") - F.col("before")).cast("int")).alias("v"))
    values = cut(equal.unionByName(few))
    low, high = (values.select("g", F.col("rank").alias(r), F.col("v").alias(v)) for r, v in (("k", "a"), ("l", "b")))
    out = wanted.withColumn("l", F.least(F.col("k") + 1, F.col("m") - 1)).join(low, ["g", "k"]).join(high, ["g", "l"])
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def skill(df: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """mse, mse_ref (of the group's mean) and skill = 1 - mse / mse_ref."""
    t = F.col(truth)
    agg = df.groupBy(*by).agg(F.avg(F.pow(t - F.col(predicted), F.lit(2.0))).alias("mse"), F.var_pop(t).alias("mse_ref"))
    return agg.withColumn("skill", 1.0 - F.try_divide(F.col("mse"), F.col("mse_ref")))


def bias_and_error(df: DataFrame, by: list[str], estimates: list[str], truths: dict[str, float]) -> DataFrame:
    """bias and root-mean-square error of each parameter, by group."""
    long = df.unpivot(by, estimates, "param", "estimate")
    truth = F.create_map(*[F.lit(v) for kv in truths.items() for v in kv])[F.col("param")]
    d = F.col("estimate") - truth
    return long.groupBy(*by, "param").agg(F.avg(d).alias("bias"), F.sqrt(F.avg(F.pow(d, F.lit(2.0)))).alias("rmse"))


def density(df: DataFrame, by: list[str], value: str, low: float, high: float, points: int, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on a grid, with Scott's bandwidth. Each group meets the grid with its
    distinct values and their counts; for large tables bins rounds values to that part of a bandwidth
    first, so that the rows no longer follow the input."""
    stats = df.groupBy(*by).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"))
    h = F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2))
    stats = stats.select(*[F.col(c).alias(f"_{c}_") for c in by], "_n", h.alias("_h")).filter("_h > 0")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by]
    cells = df.filter(F.col(value).isNotNull()).join(stats, on)
    at = F.col(value) if bins is None else F.round(F.col(value) * bins / F.col("_h")) * F.col("_h") / bins
    cells = cells.groupBy(*by, "_n", "_h", at.alias("_v")).agg(F.count("*").alias("_m"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_g")
    at = low + F.col("_g") * ((high - low) / (points - 1))
    cells = cells.select("*", grid).withColumn("x", at)
    u = (F.col("x") - F.col("_v")) / F.col("_h")
    total = F.sum(F.col("_m") * F.exp(-0.5 * u * u)) / (F.first("_n") * F.first("_h") * float(np.sqrt(2 * np.pi)))
    return cells.groupBy(*by, "x").agg(total.alias("density"))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin 1 to bins; the last bin holds its upper end, values outside don't count."""
    b = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def random_field(spark, nx: int, ny: int, reach: float, kind: str = "spherical", seed: int = 0) -> DataFrame:
    """i, j, value: a Gaussian field with the given covariance, by Cholesky on the driver. For the
    simulation's small grids only: at most 10,000 cells."""
    if nx * ny > 10_000:
        raise ValueError("a simulated field has at most 10,000 cells")
    i, j = (a.ravel() for a in np.mgrid[0:ny, 0:nx])
    h = np.hypot(i[:, None] - i, j[:, None] - j)
    cov = np.where(h <= reach, 1 - 1.5 * h / reach + 0.5 * (h / reach) ** 3, 0.0) if kind == "spherical" else np.exp(-h / reach)
    z = np.linalg.cholesky(cov + 1e-9 * np.eye(len(i))) @ np.random.default_rng(seed).standard_normal(len(i))
    return spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "value": z}))
