"""Queries on attribute tables: fall-backs, lists, splits, key filters, grids, feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import graph, matching, models, raster, spatial
from ..operators import timeseries as ts
from ..operators.matching import PrefixMatch
from ..sources import tables
from ..sources.tables import table
from .registry import query

#: Feature lists: what is assembled, and the part of it that models are fitted on.
ASSEMBLED = ["price", "quantity", "discount", "tax", "size", "retail"]
FITTED = ["price", "quantity", "discount", "size"]


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS zip, p_type AS zcta, CASE p_size % 4 WHEN 0 THEN 'Residential' WHEN 1 THEN 'Commercial' END AS cls,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS b, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS c FROM part)
SELECT p_partkey, coalesce(zip, zcta) AS zip, CASE WHEN cls = 'Residential' THEN 'R' ELSE 'NR' END AS class,
  nullif(array_to_string(list_sort(list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL))), ','), '') AS names, len(nullif(list_filter([a, c], lambda x: x IS NOT NULL), []))::INTEGER AS kept FROM p""")
def structure_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size"), F.col("p_partkey")
    cls = F.when(F.col("p_size") % 4 == 0, "Residential").when(F.col("p_size") % 4 == 1, "Commercial")
    a, b, c = F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, F.col("p_brand")), F.when(k % 7 == 0, F.col("p_type"))
    held = keys.empty_to_null(F.array(a, c))
    return p.select(
        "p_partkey", F.coalesce(F.when(k % 5 != 0, F.col("p_brand")), F.col("p_type")).alias("zip"), keys.building_class(cls).alias("class"),
        F.array_join(keys.distinct_values(a, b, c), ",").alias("names"), F.when(held.isNotNull(), F.size(F.array_compact(held))).alias("kept"),
    )


@query("""SELECT CASE WHEN c_custkey % 6 = 0 OR c_acctbal < 0 THEN 'aside' ELSE 'placed' END AS part, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer GROUP BY 1""")
def coordinates_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a coordinate are kept beside the others rather than lost."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") / 10).alias("lat"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("lon"))
    placed, aside = tables.set_aside(c, ["lat", "lon"])
    both = placed.withColumn("part", F.lit("placed")).unionByName(aside.withColumn("part", F.lit("aside")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)""")
def keys_of_another_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").join(wanted, "l_orderkey", "left_semi")


@query("""WITH d AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, hour, (CASE WHEN count(*) OVER w = 5 THEN sum(n) OVER w END)::BIGINT AS last_five FROM d WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events", "event_type", "ts").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return d.select("event_type", "hour", ts.full_window(F.col("n"), 5, ["event_type"], "hour", how="sum").alias("last_five"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000000000 + l_partkey * 1000000000 + l_suppkey * 1000 + l_quantity::BIGINT AS l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_quantity > 25 THEN l_quantity END AS quantity FROM lineitem)
SELECT l_orderkey, arg_min(flag, l_linenumber) FILTER (flag IS NOT NULL) AS flag, arg_min(quantity, l_linenumber) FILTER (quantity IS NOT NULL) AS quantity FROM x GROUP BY l_orderkey""")
def first_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    #: One order of all rows, as line numbers repeat within an order.
    place = F.col("l_linenumber") * F.lit(10**15) + F.col("l_partkey") * F.lit(10**9) + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")
    x = x.select("l_orderkey", place.alias("l_linenumber"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("quantity"))
    return tables.first_known(x, ["l_orderkey"], "l_linenumber")


@query("""SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1 ORDER BY p_brand, p_partkey""")
def best_by_several_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_retailprice")
    return matching.best_candidates(p, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")]).orderBy("p_brand", "p_partkey")


@query("""SELECT y.y AS value, count(o_orderkey) AS orders FROM generate_series(1992, 2001, 3) y(y) LEFT JOIN orders ON year(o_orderdate) BETWEEN y.y AND y.y + 2 GROUP BY 1""")
def steps_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = 1992 + 3 * F.floor((F.year("o_orderdate") - 1992) / 3)
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").groupBy(first.cast("long").alias("value")).agg(F.count("*").alias("orders"))
    return tables.steps(spark, 1992, 2002, 3).join(o, "value", "left").na.fill(0, ["orders"])


@query("""SELECT c.c_custkey AS record, s.s_suppkey AS candidate, 1.0 / count(*) OVER (PARTITION BY c.c_custkey) AS weight FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey""")
def candidate_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with every candidate of its polygon, by equal weights. The candidates of a polygon are counted
    before they meet the records, so that a hot polygon needs no window over the pairs, and its pairs are dealt out in blocks."""
    s = table(spark, sf_dir, "supplier", F.col("s_nationkey").alias("polygon"), F.col("s_suppkey").alias("candidate"))
    n = s.groupBy("polygon").agg((1.0 / F.count("*")).alias("weight"))
    c = table(spark, sf_dir, "customer", F.col("c_nationkey").alias("polygon"), F.col("c_custkey").alias("record"))
    return matching.blocked_join(c, s.join(n, "polygon"), ["polygon"], "record", "candidate").select("record", "candidate", "weight")


@query("""SELECT j.j, i.i, -5.0 + j.j * 2.5 AS xmin, 10.0 + i.i * 2.5 AS ymin, 6.25 AS area FROM generate_series(0, 29) j(j), generate_series(0, 19) i(i)""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spatial.grid_polygons(table(spark, sf_dir, "region", "r_regionkey"), 30, 20, -5.0, 10.0, 2.5)
    return g.select("j", "i", F.get("ring", F.lit(0))["x"].alias("xmin"), F.get("ring", F.lit(0))["y"].alias("ymin"), spatial.area(F.col("ring")).alias("area"))


@query("""WITH u AS (SELECT p_partkey AS node, p_size::DOUBLE AS area, 0 AS r FROM part WHERE p_size > 10 UNION ALL SELECT l_partkey, max(l_quantity), 1 FROM lineitem GROUP BY l_partkey)
SELECT node, arg_min(area, r) AS area FROM u GROUP BY node""")
def network_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two sources with an area; the first source's stays where both have a node."""
    one = table(spark, sf_dir, "part", F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("area")).filter("area > 10")
    two = table(spark, sf_dir, "lineitem", F.col("l_partkey").alias("node"), "l_quantity").groupBy("node").agg(F.max("l_quantity").alias("area"))
    return graph.first_nodes(one, two, key="node")


@query("""SELECT (max(p_partkey // 40) - min(p_partkey // 40) + 1)::BIGINT AS rows, 40::BIGINT AS columns, count(DISTINCT p_partkey) AS cells, (count(*) - count(DISTINCT p_partkey))::BIGINT AS repeats FROM part""")
def raster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .space import _cells

    return raster.shape_of(_cells(spark, sf_dir))


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, p_size::DOUBLE AS size, p_retailprice AS retail FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, {", ".join(FITTED)}, {len(ASSEMBLED)}::INTEGER AS assembled, {len(FITTED)}::INTEGER AS fitted FROM x""")
def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled features as one vector, and back to the columns that models are fitted on."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))  # noqa: E741
    p = table(spark, sf_dir, "part", "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"))
    rows = models.assembled(l.join(p, "p_partkey"), ASSEMBLED)
    part = models.chosen(rows, ASSEMBLED, FITTED)
    return part.select("l_orderkey", "l_linenumber", *FITTED, F.size("all").alias("assembled"), F.size("part").alias("fitted"))


#: Nine attributes, in the order in which they matter, two of them lists.
NINE = PrefixMatch(["sign", "nation", "tens", "flag", "county", "group", "zone", "zip", "occupancy"], block=2, multi=["county", "group"])
_NINE = """
r AS (SELECT c_custkey AS rec, CASE WHEN c_acctbal >= 0 THEN 'p' ELSE 'n' END AS sign, c_nationkey::VARCHAR AS nation, CASE WHEN c_custkey % 4 <> 0 THEN (floor(c_acctbal / 3000))::BIGINT::VARCHAR END AS tens,
  (c_custkey % 2)::VARCHAR AS flag, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 3)::VARCHAR END AS county, (c_custkey % 4)::VARCHAR AS grp, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 2)::VARCHAR END AS zone,
  (c_custkey % 6)::VARCHAR AS zip, 'R' AS occupancy FROM customer),
c AS (SELECT s_suppkey AS cand, CASE WHEN s_acctbal >= 0 THEN 'p' ELSE 'n' END AS sign, s_nationkey::VARCHAR AS nation, (floor(s_acctbal / 3000))::BIGINT::VARCHAR AS tens, (s_suppkey % 2)::VARCHAR AS flag,
  [(s_suppkey % 3)::VARCHAR, ((s_suppkey + 1) % 3)::VARCHAR] AS county, CASE WHEN s_suppkey % 5 <> 0 THEN [(s_suppkey % 4)::VARCHAR, '9'] END AS grp, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 2)::VARCHAR END AS zone,
  (s_suppkey % 6)::VARCHAR AS zip, CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'NR' END AS occupancy FROM supplier),
m AS (SELECT rec, cand, list_filter([CASE WHEN r.sign IS NOT NULL THEN 1 END, CASE WHEN r.nation IS NOT NULL THEN 1 END, CASE WHEN r.tens IS NOT NULL THEN coalesce(r.tens = c.tens, false)::INT END,
  coalesce(r.flag = c.flag, false)::INT, CASE WHEN r.county IS NOT NULL THEN coalesce(list_contains(c.county, r.county), false)::INT END, coalesce(list_contains(c.grp, r.grp), false)::INT,
  CASE WHEN r.zone IS NOT NULL THEN coalesce(r.zone = c.zone, false)::INT END, coalesce(r.zip = c.zip, false)::INT, coalesce(r.occupancy = c.occupancy, false)::INT], lambda x: x IS NOT NULL) AS marks
  FROM r JOIN c ON c.sign = r.sign AND c.nation = r.nation),
d AS (SELECT rec, cand, coalesce(nullif(list_position(marks, 0), 0) - 1, len(marks))::INTEGER AS d FROM m),
b AS (SELECT rec, max(d) AS p FROM d GROUP BY rec)
"""


@query(f"""WITH {_NINE}, n AS (SELECT d.rec, count(*) AS n FROM d JOIN b ON b.rec = d.rec AND b.p = d.d GROUP BY 1)
SELECT r.rec, coalesce(b.p, 0)::INTEGER AS match_precision, coalesce(n.n, 0)::BIGINT AS num_matches FROM r LEFT JOIN b ON b.rec = r.rec LEFT JOIN n ON n.rec = r.rec""")
def nine_attribute_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    sign = lambda c: F.when(F.col(c) >= 0, "p").otherwise("n").alias("sign")
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(
        k.alias("rec"), sign("c_acctbal"), text(F.col("c_nationkey")).alias("nation"), F.when(k % 4 != 0, text(F.floor(F.col("c_acctbal") / 3000))).alias("tens"), text(k % 2).alias("flag"),
        F.when(k % 5 != 0, text(k % 3)).alias("county"), text(k % 4).alias("group"), F.when(k % 3 != 0, text(k % 2)).alias("zone"), text(k % 6).alias("zip"), F.lit("R").alias("occupancy"),
    )
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(
        k.alias("cand"), sign("s_acctbal"), text(F.col("s_nationkey")).alias("nation"), text(F.floor(F.col("s_acctbal") / 3000)).alias("tens"), text(k % 2).alias("flag"),
        F.array(text(k % 3), text((k + 1) % 3)).alias("county_values"), F.when(k % 5 != 0, F.array(text(k % 4), F.lit("9"))).alias("group_values"), F.when(k % 7 != 0, text(k % 2)).alias("zone"), text(k % 6).alias("zip"),
        F.when(k % 2 == 0, "R").otherwise("NR").alias("occupancy"),
    )
    return NINE.run(r, c, "rec", "cand")[0].select("rec", "match_precision", "num_matches")
