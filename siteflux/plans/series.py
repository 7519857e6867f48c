"""Queries on calendars, rolling windows and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import timeseries as ts
from ..operators.nearest import nearest_rows
from ..sources.tables import table
from .registry import query

#: A small catalogue of events: number, first and last day.
CATALOGUE = [(1, "2024-01-02", "2024-01-04"), (2, "2024-01-08", "2024-01-12"), (3, "2024-01-11", "2024-01-13"), (4, "2024-01-20", "2024-01-25")]
CATALOGUE_SQL = "(VALUES " + ", ".join(f"({n}, TIMESTAMP '{a} 00:00:00', TIMESTAMP '{b} 23:59:59')" for n, a, b in CATALOGUE) + ') AS c(event, "start", "end")'


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("event"), F.lit(f"{a} 00:00:00").cast("timestamp_ntz").alias("start"), F.lit(f"{b} 23:59:59").cast("timestamp_ntz").alias("end")) for n, a, b in CATALOGUE]
    return spark.range(1).select(F.inline(F.array(*rows)))


@query("""
WITH p AS (
  SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS opened, CAST(max(l_shipdate) AS DATE) AS closed
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate),
spine AS (
  SELECT g.o_orderpriority, CAST(d.d AS DATE) AS date
  FROM (SELECT DISTINCT o_orderpriority FROM p) g, generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) AS d(d)),
i AS (SELECT o_orderpriority, opened AS date, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT o_orderpriority, closed AS date, count(*) AS n FROM p GROUP BY ALL),
f AS (
  SELECT s.o_orderpriority, s.date, coalesce(i.n, 0)::BIGINT AS inflow, coalesce(o.n, 0)::BIGINT AS outflow
  FROM spine s LEFT JOIN i ON i.o_orderpriority = s.o_orderpriority AND i.date = s.date LEFT JOIN o ON o.o_orderpriority = s.o_orderpriority AND o.date = s.date)
SELECT o_orderpriority, date, inflow, outflow, inflow - outflow AS netflow,
       (sum(inflow - outflow) OVER (PARTITION BY o_orderpriority ORDER BY date ROWS UNBOUNDED PRECEDING))::BIGINT AS stock FROM f
""")
def policies_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate")
    p = orders.join(closed, orders["o_orderkey"] == closed["l_orderkey"]).select("o_orderpriority", F.col("o_orderdate").alias("opened"), "closed", F.lit(1).alias("n"))
    return ts.stock_from_flows(p, ["o_orderpriority"], "opened", "closed", "n", "1995-01-01", "2001-12-31")


@query("""
WITH spine AS (
  SELECT g.event_type, CAST(d.d AS DATE) AS date
  FROM (SELECT DISTINCT event_type FROM events) g, generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) AS d(d)),
n AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL)
SELECT s.event_type, s.date, coalesce(n.n, 0)::BIGINT AS claim_count FROM spine s LEFT JOIN n ON n.event_type = s.event_type AND n.date = s.date
""")
def daily_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "ts").withColumn("n", F.lit(1))
    return ts.daily_counts(e, ["event_type"], "ts", "n", "2023-12-25", "2024-02-05")


@query("""
WITH m AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS v FROM events GROUP BY ALL),
span AS (SELECT user_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM m GROUP BY user_id)
SELECT s.user_id, s.date, m.v AS value_max FROM span s LEFT JOIN m ON m.user_id = s.user_id AND m.date = s.date
""")
def daily_max_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.daily_max(table(spark, sf_dir, "events", "user_id", "ts", "value"), ["user_id"], "ts", "value")


@query("SELECT user_id, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS middle FROM events GROUP BY user_id")
def event_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "value")
    return e.groupBy("user_id").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.median("value"), 6).alias("middle"))


@query(f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS v FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 250) GROUP BY ALL)
SELECT c.event, d.user_id, max(d.v) AS event_max FROM d JOIN {CATALOGUE_SQL} ON d.date BETWEEN c."start" AND c."end" GROUP BY ALL
""")
def event_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "ts", "value")
    #: Entities with an implausible value are left out whole.
    dropped = e.filter("value > 250").select("user_id").distinct()
    daily = ts.daily_max(e.join(dropped, "user_id", "left_anti"), ["user_id"], "ts", "value", dense=False).withColumn("at", F.col("date").cast("timestamp_ntz"))
    return ev.window_max(daily, "at", "value_max", ["user_id"], catalogue(spark))


_COUNTS = f"""
claims AS (SELECT c.event, e.user_id AS key, count(*) AS n FROM events e JOIN {CATALOGUE_SQL} ON e.ts BETWEEN c."start" AND c."end" WHERE e.event_type = 'error' GROUP BY ALL),
pol AS (SELECT o_custkey % 15 AS key, DATE '2023-12-15' + CAST(o_orderkey % 40 AS INTEGER) AS eff,
        DATE '2023-12-15' + CAST(o_orderkey % 40 + o_orderkey % 20 AS INTEGER) AS term FROM orders),
pols AS (SELECT c.event, p.key, count(*) AS n FROM pol p JOIN {CATALOGUE_SQL}
        ON p.eff <= greatest(c."start" + (c."end" - c."start") / 2, TIMESTAMP '2010-01-01') AND p.term >= greatest(c."start" + (c."end" - c."start") / 2, TIMESTAMP '2010-01-01') GROUP BY ALL),
b AS (SELECT c_custkey % 15 AS key, count(*) AS nb FROM customer GROUP BY ALL),
j AS (SELECT coalesce(cl.event, p.event) AS event, coalesce(cl.key, p.key) AS key, coalesce(cl.n, 0) AS num_claims, coalesce(p.n, 0) AS num_policies
      FROM claims cl FULL JOIN pols p ON cl.event = p.event AND cl.key = p.key),
k AS (SELECT j.*, coalesce(b.nb, 0) AS num_buildings, least(num_claims, coalesce(b.nb, 0)) AS num_presence FROM j LEFT JOIN b ON b.key = j.key),
pa AS (SELECT key, event, num_claims, num_policies, num_buildings, num_presence,
       least(greatest(num_policies - num_claims, 0), num_buildings - num_presence) AS num_absence FROM k)
"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type").filter("event_type = 'error'")
    claims = ev.inside(e, "ts", catalogue(spark)).select("event", F.col("user_id").alias("key"))
    day = lambda n: F.date_add(F.lit("2023-12-15").cast("date"), n.cast("int")).cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    o = o.select((F.col("o_custkey") % 15).alias("key"), day(F.col("o_orderkey") % 40).alias("eff"), day(F.col("o_orderkey") % 40 + F.col("o_orderkey") % 20).alias("term"))
    policies = ev.in_force(o, "eff", "term", catalogue(spark)).select("event", "key")
    b = table(spark, sf_dir, "customer", "c_custkey").groupBy((F.col("c_custkey") % 15).alias("key")).agg(F.count("*").alias("num_buildings"))
    return ev.presence_absence(claims, policies, b, ["event", "key"], "key")


@query(f"WITH {_COUNTS} SELECT * FROM pa")
def presence_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"""WITH {_COUNTS} SELECT event, sum(num_policies)::BIGINT AS num_policies, sum(num_claims)::BIGINT AS num_claims, sum(num_presence)::BIGINT AS num_presence,
sum(num_absence)::BIGINT AS num_absence, round((sum(num_presence) + sum(num_absence)) / greatest(sum(num_policies), sum(num_claims)), 6) AS kept_ratio FROM pa GROUP BY event""")
def presence_absence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.totals(_counts(spark, sf_dir), "event").withColumn("kept_ratio", F.round("kept_ratio", 6))


_HOURLY = """
sums AS (SELECT event_type, date_trunc('hour', ts) AS hour, sum(value) AS total FROM events GROUP BY ALL),
span AS (SELECT unnest(generate_series((SELECT min(hour) FROM sums), (SELECT max(hour) FROM sums), INTERVAL 1 HOUR)) AS hour),
hourly AS (SELECT t.event_type, s.hour, coalesce(x.total, 0.0) AS total FROM span s CROSS JOIN (SELECT DISTINCT event_type FROM events) t
  LEFT JOIN sums x ON x.hour = s.hour AND x.event_type = t.event_type)
"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.hourly(table(spark, sf_dir, "events", "event_type", "ts", "value"), ["event_type"], "ts", "value")


def _mean_sql(n: int, by: str = "event_type") -> str:
    w = f"(PARTITION BY {by} ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(total) OVER {w} = {n} THEN avg(total) OVER {w} END, 6)"


@query(f"WITH {_HOURLY} SELECT event_type, hour, {_mean_sql(6)} AS mean_6, {_mean_sql(12)} AS mean_12, {_mean_sql(24)} AS mean_24, {_mean_sql(6, 'event_type, date_trunc(' + chr(39) + 'day' + chr(39) + ', hour)')} AS mean_6_by_day FROM hourly")
def rolling_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v, key = _hourly(spark, sf_dir), F.col("total"), ["event_type"]
    means = {f"mean_{n}": F.round(ts.full_window(v, n, key, "hour"), 6) for n in (6, 12, 24)}
    return h.select("event_type", "hour", *[c.alias(n) for n, c in means.items()], F.round(ts.full_window(v, 6, key, "hour", reset_by=F.to_date("hour")), 6).alias("mean_6_by_day"))


@query(f"""WITH {_HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k FROM hourly)
SELECT a.event_type, a.hour, round(CASE WHEN a.k >= 120 THEN sum(b.total * pow(0.9, (a.k - b.k) / 24.0)) END, 6) AS api
FROM n a JOIN n b ON a.event_type = b.event_type AND b.k BETWEEN a.k - 119 AND a.k GROUP BY a.event_type, a.hour, a.k""")
def antecedent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).select("event_type", "hour", F.round(ts.antecedent_index(F.col("total"), ["event_type"], "hour"), 6).alias("api"))


@query(f"""WITH {_HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k FROM hourly),
s AS (SELECT event_type, hour, {_mean_sql(6)} AS mean_6 FROM n)
SELECT c.event, s.event_type, max(s.mean_6) AS peak, arg_min(s.mean_6, s.hour) AS at_start FROM s JOIN {CATALOGUE_SQL} ON s.hour BETWEEN c."start" AND c."end" GROUP BY ALL""")
def event_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hourly(spark, sf_dir).withColumn("mean_6", F.round(ts.full_window(F.col("total"), 6, ["event_type"], "hour"), 6))
    joined = ev.inside(h, "hour", catalogue(spark))
    return joined.groupBy("event", "event_type").agg(F.max("mean_6").alias("peak"), ts.at_start("mean_6", "hour", F.col("start"), F.col("end")).alias("at_start"))


@query("SELECT o_orderpriority, year(o_orderdate)::INTEGER AS year, max(o_totalprice) AS annual_max FROM orders GROUP BY ALL")
def annual_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.annual_maxima(table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_totalprice"), ["o_orderpriority"], "o_orderdate", "o_totalprice")


@query("""WITH a AS (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, user_id, ts, value FROM a WHERE k = 1""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import first_rows

    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("_day", F.to_date("ts"))
    return first_rows(e, ["user_id", "_day"], [F.col("ts"), F.col("event_id")]).drop("_day")


@query("""SELECT DISTINCT k AS key FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT user_id FROM events)""")
def union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [table(spark, sf_dir, t, c).select(F.col(c).alias("key")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("events", "user_id"))]
    return keys[0].unionByName(keys[1]).unionByName(keys[2]).distinct()


@query("""SELECT n_nationkey AS chunk FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 AND c_nationkey IS NOT NULL)""")
def semi_anti_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import pending

    done = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("chunk"))
    return pending(table(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").alias("chunk")), done, ["chunk"])


@query("""WITH u AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, 0 AS r FROM orders WHERE o_orderpriority < '3'
UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_totalprice, 1 FROM orders WHERE o_orderpriority >= '3')
SELECT k AS custkey, d AS day, arg_min(v, r) AS price FROM (SELECT k, d, r, max(v) AS v FROM u GROUP BY ALL) GROUP BY k, d""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import first_source

    o = table(spark, sf_dir, "orders", "o_orderpriority", "o_custkey", "o_orderdate", "o_totalprice")
    part = lambda urgent: o.filter((F.col("o_orderpriority") < "3") == urgent).groupBy(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    return first_source([part(True), part(False)], ["custkey", "day"])


@query("""SELECT o_orderkey, rank_no FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority, o_orderstatus) AS rank_no FROM orders)""")
def change_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of the distinct key of each row: the keys are numbered over range-sorted parts, then joined back."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    keys = o.select("o_orderpriority", "o_orderstatus").distinct()
    ranked = ts.numbered(keys, ["o_orderpriority", "o_orderstatus"], "rank_no")
    return o.join(ranked, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "rank_no")


@query("""SELECT event_id, ts + INTERVAL 90 MINUTE AS naive_ts, CASE WHEN value <= 50 THEN value END AS masked, year(ts)::INTEGER AS yr FROM events""")
def timezone_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import naive
    from ..functions.physics import masked_above

    e = table(spark, sf_dir, "events", "event_id", "ts", "value")
    text = F.concat(F.date_format(F.col("ts") + F.expr("interval 90 minutes"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return e.select("event_id", naive(text).alias("naive_ts"), masked_above(F.col("value"), 50.0).alias("masked"), F.year("ts").alias("yr"))


@query("""WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, ts FROM events),
b AS (SELECT e.event_id, p.event_id AS before, epoch_us(e.ts) - epoch_us(p.ts) AS bd FROM e ASOF JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts),
f AS (SELECT e.event_id, p.event_id AS after, epoch_us(p.ts) - epoch_us(e.ts) AS fd FROM e ASOF JOIN p ON p.user_id = e.user_id AND p.ts >= e.ts)
SELECT e.event_id, b.before, f.after, CASE WHEN f.after IS NULL OR bd <= fd THEN b.before ELSE f.after END AS nearest, CASE WHEN least(bd, fd) <= 3600000000 THEN CASE WHEN f.after IS NULL OR bd <= fd THEN b.before ELSE f.after END END AS within_hour
FROM e LEFT JOIN b USING (event_id) LEFT JOIN f USING (event_id)""")
def nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the same user's last purchase until then, the next one from then, the nearer of both, and that if it is within
    an hour."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought"))
    events = e.select("event_id", "user_id", "ts")
    found = nearest_rows(events, p, ["user_id"], "ts", ["bought"], "both")
    close = F.abs(F.timestamp_diff("MICROSECOND", F.col("near_ts"), F.col("ts"))) <= 3_600_000_000
    return found.select("event_id", F.col("before_bought").alias("before"), F.col("after_bought").alias("after"), F.col("near_bought").alias("nearest"), F.when(close, F.col("near_bought")).alias("within_hour"))
