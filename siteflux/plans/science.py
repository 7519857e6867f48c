"""Queries on networks, feature tables, statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import events as ev
from ..operators import graph, leafwise, models, sampling, stats
from ..operators.iterate import cut
from ..sources.tables import table
from .registry import query


@query("SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean_price FROM lineitem GROUP BY l_partkey")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")  # noqa: E741
    p = physics.nan_to_zero(F.col("l_extendedprice"))
    return l.groupBy("l_partkey").agg(F.round(F.try_divide(F.sum(p * F.col("l_quantity")), F.sum("l_quantity")), 4).alias("mean_price"))


@query("""WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 6 <> 0 THEN p_size END AS size FROM part), m AS (SELECT p_type, median(size) AS m FROM p GROUP BY p_type)
SELECT p.p_partkey, coalesce(p.size::DOUBLE, m.m) AS size FROM p JOIN m ON m.p_type = p.p_type""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").withColumn("size", F.when(F.col("p_partkey") % 6 != 0, F.col("p_size").cast("double")))
    return graph.impute_median(p, ["size"], "p_type").select("p_partkey", "size")


@query("""WITH c AS (SELECT p_partkey, p_size + 1.0 AS w, p_size / 10.0 + 0.1 AS d, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE (p_partkey % 50 - 2) / 1000.0 END AS s, 0.03 + (p_partkey % 5) / 100.0 AS n, p_retailprice / 1000 AS km FROM part),
v AS (SELECT *, pow(w * d / (w + 2 * d), 2.0 / 3) * sqrt(greatest(s, 1e-5)) / n AS u FROM c WHERE s IS NOT NULL)
SELECT c.p_partkey, round(v.u, 6) AS velocity, round(v.u * 5 / 3, 6) AS celerity, round(1000 * v.km / (v.u * 5 / 3), 4) AS travel_s, round(1000 * v.km / (v.u * 5 / 3) / 3600, 6) AS travel_h FROM c LEFT JOIN v ON v.p_partkey = c.p_partkey""")
def manning_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice"), F.col("p_partkey")
    s = F.when(k % 8 != 0, (k % 50 - 2) / 1000.0)
    c = physics.channel(F.col("p_size") + 1.0, F.col("p_size") / 10.0 + 0.1, s, 0.03 + (k % 5) / 100.0, F.col("p_retailprice") / 1000)
    places = {"velocity": 6, "celerity": 6, "travel_s": 4, "travel_h": 6}
    return p.select("p_partkey", *[F.round(c[n], d).alias(n) for n, d in places.items()])


_REACH = """
e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst, (p_size % 5)::DOUBLE AS w FROM part WHERE p_partkey > 1),
r AS (SELECT p_partkey AS source, p_partkey AS node, 0.0::DOUBLE AS dist FROM part WHERE p_partkey > 0
  UNION ALL SELECT r.source, e.dst, r.dist + e.w FROM r JOIN e ON e.src = r.node WHERE r.dist + e.w <= 9)
"""


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_partkey > 0")
    down = graph.edges_of(p.withColumn("to", F.floor(F.col("p_partkey") / 2)).withColumn("w", (F.col("p_size") % 5).cast("double")), "p_partkey", "to", "w")
    sources = p.select(F.col("p_partkey").alias("node"))
    return graph.reach(graph.reverse(down), sources, 9.0)


@query(f"WITH RECURSIVE {_REACH} SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL")
def upstream_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)


@query(f"""WITH RECURSIVE {_REACH}, b AS (SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL)
SELECT b.source, t.tau, q.ev, sum(p.p_size + 1)::DOUBLE AS area, sum(p.p_retailprice::DECIMAL(18, 2) * (1 + q.ev) * (p.p_size + 1))::DOUBLE / sum(p.p_size + 1)::DOUBLE AS mean_value
FROM b JOIN (VALUES (0.0::DOUBLE), (3.0), (9.0)) t(tau) ON b.dist <= t.tau JOIN part p ON p.p_partkey = b.node, (VALUES (0), (1)) q(ev) GROUP BY ALL""")
def upstream_precipitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    areas = p.select(F.col("p_partkey").alias("node"), (F.col("p_size") + 1).cast("decimal(10,0)").alias("area"))
    values = p.select(F.col("p_partkey").alias("node"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ev"), "p_retailprice")
    values = values.select("node", "ev", (F.col("p_retailprice").cast("decimal(18,2)") * (1 + F.col("ev"))).cast("decimal(18,2)").alias("value"))
    return graph.upstream_mean(graph.within_thresholds(_reached(spark, sf_dir), [0.0, 3.0, 9.0]), areas, values, ["ev"])


@query("""SELECT c.c_custkey, any_value(c.c_mktsegment) AS segment, sum(o.o_totalprice::DECIMAL(18, 2))::DOUBLE / count(o.o_totalprice) AS mean_price,
sum(l.q)::DOUBLE / count(l.q) AS mean_quantity, sum(l.d)::DOUBLE / count(l.d) AS mean_discount
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity::DECIMAL(18, 2)) AS q, round(sum(l_discount::DECIMAL(18, 2))::DOUBLE / count(*), 6)::DECIMAL(18, 6) AS d FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_custkey""")
def feature_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_discount").groupBy("l_orderkey")  # noqa: E741
    #: Sums of decimals don't depend on the order of their rows.
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    discount = F.round(F.sum(exact("l_discount")).cast("double") / F.count("*"), 6).cast("decimal(18,6)")
    l = l.agg(F.sum(exact("l_quantity")).alias("mean_quantity"), discount.alias("mean_discount"))  # noqa: E741
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", exact("o_totalprice").alias("mean_price"))
    c = table(spark, sf_dir, "customer", "c_custkey", F.col("c_mktsegment").alias("segment"))
    rows = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return ev.rolled_up(rows, ["c_custkey"], ["segment"], ["mean_price", "mean_quantity", "mean_discount"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS share, round(1.0 / count(*) OVER (PARTITION BY l_orderkey), 9) AS uniform FROM lineitem""")
def weight_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("share"))  # noqa: E741
    out = stats.uniform_weights(stats.normalized(l, "l_orderkey", "share"), "l_orderkey", "uniform")
    return out.withColumn("share", F.round("share", 9)).withColumn("uniform", F.round("uniform", 9))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    draw = F.col("o_orderkey") * 7919 % 1000 / 1000.0
    return o.select("o_orderkey", (F.col("o_totalprice") / 100000 - 2).alias("x"), (draw < physics.logistic(F.lit(-1.0) - F.col("o_totalprice") / 100000 + 2)).cast("int").alias("y"))


def _newton_sql(steps: int = 9) -> str:
    """The Newton steps of a penalised logistic fit, one CTE a step, for an engine without a fit of its own."""
    parts = ["""r AS MATERIALIZED (SELECT o_totalprice / 100000 - 2 AS x, (o_orderkey * 7919 % 1000 / 1000.0 < 1 / (1 + exp(1 + o_totalprice / 100000 - 2)))::INT::DOUBLE AS y FROM orders),
s0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"""]
    for k in range(steps):
        parts.append(f"""g{k} AS MATERIALIZED (SELECT b0, b1, sum(y - p) AS g0, sum((y - p) * x) - b1 AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) + 1 AS h2
  FROM (SELECT r.x, r.y, s.b0, s.b1, 1 / (1 + exp(-(s.b0 + s.b1 * r.x))) AS p FROM r, s{k} s) GROUP BY b0, b1),
s{k + 1} AS MATERIALIZED (SELECT b0 + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS b0, b1 + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b1 FROM g{k})""")
    return f"WITH {', '.join(parts)} SELECT round(b0, 4) AS b0, round(b1, 4) AS b1, round(b0, 4) AS b0_library, round(b1, 4) AS b1_library FROM s{steps}"


@query(_newton_sql())
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: intercept and slope by Newton steps and by the library, which agree; the SQL takes the steps itself."""
    rows = _labelled(spark, sf_dir)
    b0, b1 = stats.fit_logistic(rows, "x", "y")
    m = models.weighted_logistic(rows, ["x"], "y")
    return spark.range(1).select(*[F.lit(round(float(v), 4)).alias(n) for n, v in (("b0", b0), ("b1", b1), ("b0_library", m.intercept), ("b1_library", m.coefficients[0]))])


def _em_sql(rounds: int = 12, steps: int = 8, tol: float = 1e-3) -> str:
    """Expectation maximisation round by round, each with the Newton steps of its fit; the round at which no weight moves by tol ends it."""
    parts = ["""o AS MATERIALIZED (SELECT o_custkey, o_orderkey, o_totalprice / 100000 - 2 AS x, (o_orderkey * 7919 % 1000 / 1000.0 < 1 / (1 + exp(1 + o_totalprice / 100000 - 2)))::INT AS y FROM orders),
w0 AS MATERIALIZED (SELECT o_custkey, o_orderkey, x, arg_min(y, o_orderkey) OVER (PARTITION BY o_custkey)::DOUBLE AS y, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS w, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS prior FROM o),
s0_end AS MATERIALIZED (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"""]
    for r in range(1, rounds + 1):
        before = f"s{r - 1}_end"
        for k in range(steps):
            now = f"s{r}_end" if k == steps - 1 else f"s{r}_{k}"
            parts.append(f"""{now} AS MATERIALIZED (SELECT b0 + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS b0, b1 + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b1 FROM (
  SELECT b0, b1, sum(w * (y - p)) AS g0, sum(w * (y - p) * x) - b1 AS g1, sum(w * p * (1 - p)) AS h0, sum(w * p * (1 - p) * x) AS h1, sum(w * p * (1 - p) * x * x) + 1 AS h2
  FROM (SELECT d.*, s.b0, s.b1, 1 / (1 + exp(-(s.b0 + s.b1 * d.x))) AS p FROM w{r - 1} d, {before} s) GROUP BY b0, b1))""")
            before = now
        parts.append(f"""w{r} AS MATERIALIZED (SELECT o_custkey, o_orderkey, x, y, CASE WHEN sum(v) OVER g > 0 THEN v / sum(v) OVER g ELSE 1.0 / count(*) OVER g END AS w, prior, w AS old
  FROM (SELECT d.*, prior * CASE WHEN y = 1 THEN p ELSE 1 - p END AS v FROM (SELECT d.*, 1 / (1 + exp(-(s.b0 + s.b1 * d.x))) AS p FROM (SELECT o_custkey, o_orderkey, x, y, w, prior FROM w{r - 1}) d, s{r}_end s) d) WINDOW g AS (PARTITION BY o_custkey))""")
    moved = " UNION ALL ".join(f"SELECT {r} AS r, max(abs(w - old)) AS moved FROM w{r}" for r in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {r} AS r, o_custkey, o_orderkey, w, b0, b1 FROM w{r}, s{r}_end" for r in range(1, rounds + 1))
    last = f"(SELECT coalesce(min(r) FILTER (moved < {tol!r}), {rounds}) FROM moved)"
    return f"WITH {', '.join(parts)}, moved AS ({moved}), every_ AS ({every}) SELECT o_custkey, o_orderkey, round(w, 6) AS weight, round(b0, 5) AS b0, round(b1, 5) AS b1 FROM every_ WHERE r = {last}"


@query(_em_sql())
def em_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate weights after expectation maximisation: records are customers, candidates their
    orders, and a record's outcome is that of one of them."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(_labelled(spark, sf_dir), "o_orderkey")
    seen = o.groupBy("o_custkey").agg(F.min_by("y", "o_orderkey").alias("outcome"))
    rows = o.join(seen, "o_custkey").select("o_custkey", "o_orderkey", "x", "outcome", F.lit(1.0).alias("weight"))
    state, b0, b1 = stats.em_reweight(rows, "o_custkey", "x", "outcome", "weight", tol=1e-3, rounds=12)
    return state.select("o_custkey", "o_orderkey", F.round("weight", 6).alias("weight"), F.lit(round(b0, 5)).alias("b0"), F.lit(round(b1, 5)).alias("b1"))


@query("""WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, max(o_totalprice) AS x FROM orders GROUP BY ALL),
r AS (SELECT o_orderpriority, x, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY x) - 1)::DOUBLE AS r, count(*) OVER (PARTITION BY o_orderpriority)::DOUBLE AS n FROM m),
b AS (SELECT o_orderpriority, count(*) AS n, avg(x) AS b0, avg(x * r / (n - 1)) AS b1, avg(x * r * (r - 1) / ((n - 1) * (n - 2))) AS b2 FROM r GROUP BY o_orderpriority),
l AS (SELECT *, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM b),
c AS (SELECT *, 2 / (3 + t3) - ln(2) / ln(3) AS c FROM l), k AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS k FROM c),
s AS (SELECT *, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS scale FROM k), f AS (SELECT *, b0 - scale * (1 - gamma(1 + k)) / k AS loc FROM s)
SELECT o_orderpriority, n, round(-k, 5) AS shape, round(scale, 1) AS scale, round(loc + scale * (1 - pow(-ln(1 - 1 / 2.0), k)) / k, 1) AS return_level FROM f""")
def gev_lmoments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_totalprice").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.max("o_totalprice").alias("x"))
    g = stats.gev_return_level(stats.l_moments(m, ["o_orderpriority"], "x"), 2.0)
    return g.select("o_orderpriority", "n", F.round("shape", 5).alias("shape"), F.round("scale", 1).alias("scale"), F.round("return_level", 1).alias("return_level"))


@query()
def gev_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_totalprice").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.max("o_totalprice").alias("x"))
    return stats.gev_likelihood(m, ["o_orderpriority"], "x", 2.0)


@query("""WITH p AS (SELECT o_orderpriority, o_totalprice AS y, o_totalprice * 0.9 + (o_orderkey % 100) * 200 AS f FROM orders)
SELECT o_orderpriority, round(avg(pow(y - f, 2)), 2) AS mse, round(var_pop(y), 2) AS mse_ref, round(1 - avg(pow(y - f, 2)) / var_pop(y), 8) AS skill FROM p GROUP BY o_orderpriority""")
def skill_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("f", F.col("o_totalprice") * 0.9 + (F.col("o_orderkey") % 100) * 200)
    s = stats.skill(o, "o_totalprice", "f", ["o_orderpriority"])
    return s.select("o_orderpriority", F.round("mse", 2).alias("mse"), F.round("mse_ref", 2).alias("mse_ref"), F.round("skill", 8).alias("skill"))


@query("""WITH e AS (SELECT o_orderpriority AS model, o_totalprice / 100000 AS beta0, (o_orderkey % 1000) / 250.0 AS beta1 FROM orders),
u AS (SELECT model, 'beta0' AS param, beta0 - 1.5 AS d FROM e UNION ALL SELECT model, 'beta1', beta1 - 2.0 FROM e)
SELECT model, param, round(avg(d), 8) AS bias, round(sqrt(avg(d * d)), 8) AS rmse FROM u GROUP BY ALL""")
def bias_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    e = o.select(F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / 100000).alias("beta0"), ((F.col("o_orderkey") % 1000) / 250.0).alias("beta1"))
    b = stats.bias_and_error(e, ["model"], ["beta0", "beta1"], {"beta0": 1.5, "beta1": 2.0})
    return b.select("model", "param", F.round("bias", 8).alias("bias"), F.round("rmse", 8).alias("rmse"))


@query("""WITH b AS (SELECT event_type, least(floor((value - 0) / 5.0) + 1, 20)::INTEGER AS bin FROM events WHERE value BETWEEN 0 AND 100) SELECT event_type, bin, count(*) AS n FROM b GROUP BY ALL""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value", 0.0, 100.0, 20)


@query("""WITH s AS (SELECT event_type, stddev_samp(value) * pow(count(*), -0.2) AS h, count(*) AS n FROM events GROUP BY event_type),
g AS (SELECT unnest(generate_series(0, 20)) * 5.0 AS x)
SELECT e.event_type, g.x::INTEGER AS x, round(avg(exp(-0.5 * pow((g.x - e.value) / s.h, 2))) / (any_value(s.h) * sqrt(2 * pi())), 5) AS density FROM events e JOIN s ON s.event_type = e.event_type, g GROUP BY e.event_type, g.x""")
def value_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.density(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value", 0.0, 100.0, 21)
    return d.select("event_type", F.col("x").cast("int").alias("x"), F.round("density", 5).alias("density"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    x = o.select("o_orderkey", (F.col("o_custkey") % 37).alias("block"), (F.year("o_orderdate") % 3).alias("event"), (F.col("o_totalprice") / 1000).alias("f1"), (F.col("o_custkey") % 100).cast("double").alias("f2"), "o_orderpriority")
    return x.withColumn("outcome", F.col("f1") * 0.3 + F.col("f2") * 0.2).withColumn("w", F.lit(1.0))


@query()
def spatial_block_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-event-out skill of boosted trees with blocked inner folds, at test-size settings."""

    def make():
        return models.BlockedBoosting(["f1", "f2", "o_orderpriority"], "outcome", "block", "w", ["o_orderpriority"], settings={**models.SETTINGS, "stepSize": 0.3, "minInstancesPerNode": 5, "minInfoGain": 0.0, "maxDepth": 3}, rounds=4, folds=2)

    out = models.leave_one_out(_training(spark, sf_dir), "event", [0, 1, 2], make)
    return stats.skill(out, "outcome", "prediction", ["event"]).select("event", F.round("skill", 3).alias("skill"))


@query()
def leafwise_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with trees of five leaves that grow leaf by leaf, with leaf penalties; ten rounds at most."""
    settings = leafwise.with_settings(rate=0.3, least_rows=20)
    make = lambda: leafwise.LeafwiseBoosting(["f1", "f2", "o_orderpriority"], "outcome", "block", "w", ["o_orderpriority"], settings, rounds=10, folds=2, patience=5, threads=2)
    out = models.leave_one_out(_training(spark, sf_dir), "event", [0, 1, 2], make, threads=3)
    return stats.skill(out, "outcome", "prediction", ["event"]).select("event", F.round("skill", 3).alias("skill"))


@query("""WITH d AS (SELECT o_orderkey, o_totalprice AS y, o_custkey % 50 AS a, month(o_orderdate) AS b FROM orders), s AS (SELECT avg(y) AS start FROM d),
v AS (SELECT f, v, sum(start - y) AS g, count(*) AS h FROM (SELECT 'a' AS f, a AS v, y FROM d UNION ALL SELECT 'b', b, y FROM d), s GROUP BY f, v),
l AS (SELECT f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY f) AS g, sum(h) OVER (PARTITION BY f) AS h FROM v WINDOW w AS (PARTITION BY f ORDER BY v)),
c AS (SELECT *, pow(greatest(abs(gl) - 1, 0), 2) / (hl + 10) + pow(greatest(abs(g - gl) - 1, 0), 2) / (h - hl + 10) - pow(greatest(abs(g) - 1, 0), 2) / (h + 10) AS gain FROM l WHERE hl >= 20 AND h - hl >= 20),
t AS (SELECT * FROM c WHERE gain > 0.1 ORDER BY gain DESC LIMIT 1)
SELECT o_orderkey, round(start - coalesce(CASE WHEN CASE t.f WHEN 'a' THEN a ELSE b END <= t.v THEN sign(gl) * greatest(abs(gl) - 1, 0) / (hl + 10) ELSE sign(g - gl) * greatest(abs(g - gl) - 1, 0) / (h - hl + 10) END, 0), 3) AS prediction
FROM d, s LEFT JOIN t ON true""")
def leafwise_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two leaves on all rows: the split of the largest gain, and penalised leaf values."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    rows = o.select("o_orderkey", (F.col("o_custkey") % 50).alias("a"), F.month("o_orderdate").alias("b"), F.col("o_totalprice").alias("y"))
    settings = leafwise.with_settings(rate=1.0, leaves=2, least_rows=20, rows=1.0, columns=1.0)
    model = leafwise.LeafwiseBoosting(["a", "b"], "y", "o_orderkey", settings=settings, rounds=1, folds=1).fit(rows)
    return model.predict(rows).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


@query("""SELECT l_returnflag, p AS share, round(CASE p WHEN 0.05 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END, 6) AS value
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) AS q FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'all', quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) FROM lineitem), (VALUES (0.05::DOUBLE), (0.5), (0.95)) v(p)""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the whole table as one group, and of three large ones."""
    l = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")  # noqa: E741
    whole = stats.exact_quantiles(l, [], "l_extendedprice", [0.05, 0.5, 0.95]).select(F.lit("all").alias("l_returnflag"), "share", "value")
    parts = stats.exact_quantiles(l, ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return whole.unionByName(parts).withColumn("value", F.round("value", 6))


@query("""WITH m AS (SELECT o_orderpriority, date_trunc('day', o_orderdate) AS m, sum(o_totalprice) AS x FROM orders GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n, true AS solved, 0.0::DOUBLE AS by_location, 0.0::DOUBLE AS by_scale, 0.0::DOUBLE AS by_shape FROM m GROUP BY o_orderpriority""")
def gev_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score equations at fits of the days' totals, worked out from the values by themselves: all 0."""
    m = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_totalprice").groupBy("o_orderpriority", F.date_trunc("day", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("x"))
    s = stats.gev_scores(m, stats.gev_likelihood(m, ["o_orderpriority"], "x", 2.0), ["o_orderpriority"], "x")
    names = ("by_location", "by_scale", "by_shape")
    return s.select("o_orderpriority", "n", F.col("by_shape").isNotNull().alias("solved"), *[F.abs(F.round(c, 6)).alias(c) for c in names])


@query("""SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, (o_orderkey % 7)::BIGINT AS small, o_totalprice::DOUBLE AS price FROM orders""")
def harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import harmonized

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return harmonized(o.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).cast("tinyint").alias("small"), F.col("o_totalprice").alias("price")))


@query()
def simulation_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-square error and skill of four estimators on simulated fields, for two seeds: all addresses, random
    assignment of the records to candidates (1,000 replicates), uniform candidate weights, and reweighted
    candidates. Truth: intercept -3, slope -2."""
    out = None
    for seed in (112263, 112264):
        rows = _simulated(spark, seed)
        out = rows if out is None else out.unionByName(rows)
    return out


def _simulated(spark: SparkSession, seed: int, size: int = 24, block: int = 4) -> DataFrame:
    """seed, model, b0, b1, mse and skill of each estimator on one field."""
    field = stats.random_field(spark, size, size, 9.0, seed=seed)
    p = physics.logistic(F.lit(-3.0) - 2.0 * F.col("value"))
    u = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(100_000)) / 100_000.0
    sites = field.select((F.col("i") * size + F.col("j")).alias("id"), (F.floor(F.col("i") / block) * (size // block) + F.floor(F.col("j") / block)).alias("polygon"), F.col("value").alias("x"), p.alias("p"), (u < p).cast("int").alias("y"))
    sites = cut(sites)
    claims = sites.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5)) < 2).select(F.col("id").alias("record"), "polygon", F.col("y").alias("outcome"))
    places = sites.select("polygon", F.col("id").alias("candidate"), "x")
    pairs = cut(claims.join(places, "polygon").withColumn("weight", F.lit(1.0)))
    counts = claims.groupBy("polygon").agg(F.sum("outcome").alias("num_presence"), F.sum(1 - F.col("outcome")).alias("num_absence"))
    drawn = sampling.assign(counts, places, "polygon", "candidate", 1000, seed).groupBy("candidate", "flooded").agg(F.count("*").cast("double").alias("weight"))
    fits = {
        "address": stats.fit_logistic(sites, "x", "y"),
        "assigned": stats.fit_logistic(cut(drawn.join(places, "candidate")), "x", "flooded", "weight"),
        "uniform": stats.fit_logistic(cut(stats.normalized(pairs, "record", "weight")), "x", "outcome", "weight"),
        "reweighted": stats.em_reweight(pairs, "record", "x", "outcome", "weight", tol=1e-3, rounds=15)[1:],
    }
    models_ = F.array(*[F.struct(F.lit(name).alias("model"), F.lit(b0).alias("b0"), F.lit(b1).alias("b1")) for name, (b0, b1) in fits.items()])
    each = sites.select("p", "x", F.explode(models_).alias("_m")).select("p", "x", "_m.*").withColumn("q", physics.logistic(F.col("b0") + F.col("b1") * F.col("x")))
    scores = stats.skill(each, "p", "q", ["model", "b0", "b1"])
    return scores.select(F.lit(seed).alias("seed"), "model", F.round("b0", 4).alias("b0"), F.round("b1", 4).alias("b1"), F.round("mse", 6).alias("mse"), F.round("skill", 4).alias("skill"))
