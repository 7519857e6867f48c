"""Queries on keys, flags, prefix matching and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, physics
from ..operators import sampling
from ..operators.matching import PrefixMatch
from ..sources.tables import table
from .registry import query

MATCH = PrefixMatch(["nation", "sign", "band", "segment"], block=1, multi=["segment"])

_RECORDS = """
r AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_acctbal >= 0 THEN 'pos' ELSE 'neg' END AS sign,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) END AS band,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer),
c AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_acctbal >= 0 THEN 'pos' ELSE 'neg' END AS sign,
  CASE WHEN s_suppkey % 6 <> 0 THEN CAST(CAST(floor(s_acctbal / 2000) AS BIGINT) AS VARCHAR) END AS band,
  CASE s_suppkey % 3 WHEN 0 THEN ['BUILDING', 'MACHINERY'] WHEN 1 THEN ['AUTOMOBILE'] ELSE ['FURNITURE', 'HOUSEHOLD', 'BUILDING'] END AS segs FROM supplier),
m AS (SELECT r.*, c.s_suppkey, (r.sign IS NOT NULL)::INT AS p2, (r.band IS NOT NULL)::INT AS p3, (r.segment IS NOT NULL)::INT AS p4,
  coalesce(r.sign = c.sign, false) AS m2, coalesce(r.band = c.band, false) AS m3, coalesce(list_contains(c.segs, r.segment), false) AS m4
  FROM r JOIN c ON r.nation = c.nation),
d AS (SELECT *, CASE WHEN p2 = 1 AND NOT m2 THEN 1 WHEN p3 = 1 AND NOT m3 THEN 1 + p2 WHEN p4 = 1 AND NOT m4 THEN 1 + p2 + p3 ELSE 1 + p2 + p3 + p4 END AS d FROM m),
b AS (SELECT c_custkey, max(d) AS p FROM d GROUP BY c_custkey),
n AS (SELECT d.c_custkey, b.p, count(*) AS n FROM d JOIN b ON d.c_custkey = b.c_custkey AND d.d = b.p GROUP BY ALL),
k AS (SELECT r.c_custkey, coalesce(n.p, 0) AS p, coalesce(n.n, 0) AS n,
  list_filter(['(nation==' || nation || ')', '(sign==' || sign || ')', '(band==' || band || ')', '(segment==' || segment || ')'], lambda x: x IS NOT NULL) AS parts,
  list_filter([CASE WHEN nation IS NOT NULL THEN 'nation' END, CASE WHEN sign IS NOT NULL THEN 'sign' END, CASE WHEN band IS NOT NULL THEN 'band' END,
    CASE WHEN segment IS NOT NULL THEN 'segment' END], lambda x: x IS NOT NULL) AS names FROM r LEFT JOIN n ON n.c_custkey = r.c_custkey),
info AS (SELECT c_custkey, CASE WHEN p > 0 THEN array_to_string(parts[1:p], '&') END AS match_key, CASE WHEN p > 0 THEN array_to_string(names[1:p], '+') END AS match_type,
  p::INTEGER AS match_precision, n::BIGINT AS num_matches FROM k)
"""


def _match(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sign = lambda c: F.when(F.col(c) >= 0, "pos").otherwise("neg").alias("sign")
    band = lambda c: F.floor(F.col(c) / 2000).cast("long").cast("string")
    r = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    r = r.select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("nation"), sign("c_acctbal"), F.when(F.col("c_custkey") % 7 != 0, band("c_acctbal")).alias("band"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    c = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    lists = [F.array(*map(F.lit, x)) for x in (["BUILDING", "MACHINERY"], ["AUTOMOBILE"], ["FURNITURE", "HOUSEHOLD", "BUILDING"])]
    segs = F.when(F.col("s_suppkey") % 3 == 0, lists[0]).when(F.col("s_suppkey") % 3 == 1, lists[1]).otherwise(lists[2])
    c = c.select(
        "s_suppkey", F.col("s_nationkey").cast("string").alias("nation"), sign("s_acctbal"), F.when(F.col("s_suppkey") % 6 != 0, band("s_acctbal")).alias("band"), segs.alias("segment_values")
    )
    return MATCH.run(r, c, "c_custkey", "s_suppkey")


@query(f"WITH {_RECORDS} SELECT * FROM info")
def prefix_match_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir)[0]


@query(f"WITH {_RECORDS} SELECT DISTINCT i.match_key, d.s_suppkey FROM info i JOIN d ON d.c_custkey = i.c_custkey AND d.d = i.match_precision")
def prefix_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir)[1]


@query(f"""WITH {_RECORDS} SELECT c_custkey, nullif(regexp_extract(match_key, '\\(nation==([^)]*)\\)', 1), '') AS nation, nullif(regexp_extract(match_key, '\\(band==([^)]*)\\)', 1), '') AS band,
len(string_split(match_type, '+'))::INTEGER AS n_attributes FROM info""")
def match_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _match(spark, sf_dir)[0]
    n = F.when(F.col("match_type").isNotNull(), F.size(F.split("match_type", r"\+")))
    return i.select("c_custkey", keys.key_part(F.col("match_key"), "nation").alias("nation"), keys.key_part(F.col("match_key"), "band").alias("band"), n.alias("n_attributes"))


@query(f"""WITH {_RECORDS} SELECT match_precision, count(*) AS records, round(quantile_cont(num_matches, 0.25), 4) AS q1, round(quantile_cont(num_matches, 0.5), 4) AS q2,
round(quantile_cont(num_matches, 0.75), 4) AS q3 FROM info GROUP BY match_precision""")
def match_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("num_matches", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = _match(spark, sf_dir)[0].groupBy("match_precision").agg(F.count("*").alias("records"), q.alias("q"))
    return out.select("match_precision", "records", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@query("""SELECT c_custkey, printf('%.1f', c_acctbal / 100) AS lat_key, '(' || printf('%.1f', c_acctbal / 100) || ',' || printf('%.1f', -(c_custkey % 1800) / 10.0 - 0.05) || ')' AS cell,
'(' || printf('%.6f', c_acctbal / 7) || ',' || printf('%.6f', (c_custkey % 97) / 13.0) || ')' AS coordinate FROM customer""")
def latlon_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    lat, lon = F.col("c_acctbal") / 100, -(F.col("c_custkey") % 1800) / 10.0 - 0.05
    return c.select(
        "c_custkey", keys.tenth_key(lat).alias("lat_key"), keys.cell_key(lat, lon).alias("cell"), keys.coordinate_key(F.col("c_acctbal") / 7, (F.col("c_custkey") % 97) / 13.0).alias("coordinate")
    )


@query("""WITH z AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'v' || p_size WHEN p_partkey % 4 = 1 THEN 'AE' WHEN p_partkey % 4 = 2 THEN 'X' ELSE 'VE' END AS zone,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 21 END AS code FROM part)
SELECT p_partkey, (coalesce(regexp_matches(upper(zone), '^[AV]'), false))::INTEGER AS sfha, (coalesce(regexp_matches(upper(zone), '^V'), false))::INTEGER AS coastal,
CASE WHEN code IN (4, 6, 17, 18, 19) THEN 'NR' ELSE 'R' END AS occupancy, concat_ws('_', 'st', p_partkey::VARCHAR) AS build_id,
CASE code WHEN 1 THEN 64 WHEN 2 THEN 1 WHEN 64 THEN 2 ELSE code END AS recoded FROM z""")
def zone_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    zone = F.when(k % 9 == 0, None).when(k % 4 == 0, F.concat(F.lit("v"), F.col("p_size"))).when(k % 4 == 1, "AE").when(k % 4 == 2, "X").otherwise("VE")
    z = p.select("p_partkey", zone.alias("zone"), F.when(k % 11 != 0, F.col("p_size") % 21).alias("code"))
    return z.select(
        "p_partkey", keys.zone_flag(F.col("zone")).alias("sfha"), keys.coastal_flag(F.col("zone")).alias("coastal"), keys.occupancy_class(F.col("code")).alias("occupancy"),
        keys.namespaced(F.lit("st"), F.col("p_partkey").cast("string")).alias("build_id"), keys.recode(F.col("code"), {1: 64, 2: 1, 64: 2}).alias("recoded"),
    )


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS flags, list_sort(list_distinct(list(l_linestatus))) AS states FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, array_to_string(flags, ',') AS flags, array_to_string(states, ',') AS states, coalesce(list_contains(flags, 'R'), false)::INTEGER AS any_r,
coalesce(len(list_filter(flags, lambda x: starts_with(x, 'A'))) > 0, false)::INTEGER AS starts_a FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def list_overlap_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").groupBy("l_orderkey")  # noqa: E741
    l = l.agg(F.sort_array(F.collect_list("l_returnflag")).alias("flags"), F.sort_array(F.collect_set("l_linestatus")).alias("states"))  # noqa: E741
    j = table(spark, sf_dir, "orders", "o_orderkey").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select(
        "o_orderkey", F.array_join("flags", ",").alias("flags"), F.array_join("states", ",").alias("states"), keys.any_is(F.col("flags"), "R").alias("any_r"), keys.any_starts(F.col("flags"), "A").alias("starts_a")
    )


_DRAWS = """
counts AS (SELECT o_orderpriority AS k, 20 AS np, 35 AS na FROM orders GROUP BY 1),
rows AS (SELECT o.o_orderpriority AS k, o.o_orderkey AS item, r.r AS replicate, np, na FROM orders o JOIN counts ON counts.k = o.o_orderpriority, generate_series(1, 30) AS r(r)),
n AS (SELECT *, row_number() OVER (PARTITION BY replicate, k ORDER BY md5(concat_ws('|', '7', replicate::VARCHAR, k, item::VARCHAR)), item) AS n FROM rows)
"""


@query(f"WITH {_DRAWS} SELECT replicate::INTEGER AS replicate, k AS match_key, item AS o_orderkey, (n <= np)::INTEGER AS flooded FROM n WHERE n <= np + na")
def mc_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "match_key")
    counts = o.select("match_key").distinct().withColumns({"num_presence": F.lit(20), "num_absence": F.lit(35)})
    return sampling.assign(counts, o, "match_key", "o_orderkey", 30, seed=7)


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority,
row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', '3', o_orderpriority, o_orderkey::VARCHAR)), o_orderkey) AS n FROM orders) WHERE n <= 12""")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_group(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], F.lit(12), 3, "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS masked, floor(o_totalprice / 3600)::BIGINT || 'h:' || printf('%02d', (floor(o_totalprice / 60) % 60)::BIGINT) || 'm:' || printf('%02d', floor(o_totalprice)::BIGINT % 60) || 's' AS elapsed,
round(1 / (1 + exp(-(o_totalprice / 100000 - 2))), 9) AS p, round(CASE WHEN o_totalprice / 1000 <= 200 THEN 1 - 1.5 * (o_totalprice / 1000 / 200) + 0.5 * pow(o_totalprice / 1000 / 200, 3) ELSE 0 END, 9) AS spherical,
round(1 - exp(-(o_totalprice / 1000) / 200), 9) AS exp_variogram, round(log10(o_totalprice), 9) AS magnitude FROM orders""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, v = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), F.col("o_totalprice")
    h = v / 1000
    return o.select(
        "o_orderkey", physics.masked_above(v, 300000.0).alias("masked"), physics.elapsed(v).alias("elapsed"), F.round(physics.logistic(v / 100000 - 2), 9).alias("p"),
        F.round(physics.spherical_covariance(h, 200.0), 9).alias("spherical"), F.round(physics.variogram(physics.exponential_covariance(h, 200.0)), 9).alias("exp_variogram"), F.round(F.log10(v), 9).alias("magnitude"),
    )
