"""Calendars, stocks from flows, full-window intensities, antecedent indices, annual maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .iterate import cut


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """date from start to end, both included."""
    span = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(span).alias("date"))


def _by_day(df: DataFrame, keys: list[str], day: str, count: str, name: str) -> DataFrame:
    return df.groupBy(*keys, F.col(day).cast("date").alias("date")).agg(F.sum(count).alias(name))


def daily_counts(df: DataFrame, keys: list[str], day: str, count: str, start: str, end: str, name: str = "claim_count") -> DataFrame:
    """Sums by key and day on a dense calendar; days off it are discarded."""
    spine = df.select(*keys).distinct().crossJoin(F.broadcast(days(df.sparkSession, start, end)))
    sums = _by_day(df, keys, day, count, name)
    return spine.join(sums, [*keys, "date"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def stock_from_flows(df: DataFrame, keys: list[str], opened: str, closed: str, count: str, start: str, end: str) -> DataFrame:
    """inflow, outflow, netflow and stock of each key and day on a dense calendar.

    A row is in stock from its opening day up to, not with, its closing day. Flows off the calendar are
    discarded, so what opened before it only leaves. Rows with any null don't count.
    """
    known = df.select(*keys, opened, closed, count).na.drop("any")
    spine = known.select(*keys).distinct().crossJoin(F.broadcast(days(df.sparkSession, start, end)))
    flows = _by_day(known, keys, opened, count, "inflow").unionByName(_by_day(known, keys, closed, count, "outflow"), allowMissingColumns=True)
    flows = flows.groupBy(*keys, "date").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    out = spine.join(flows, [*keys, "date"], "left").na.fill(0, ["inflow", "outflow"])
    out = out.withColumn("netflow", F.col("inflow") - F.col("outflow"))
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("stock", F.sum("netflow").over(run))


def daily_max(df: DataFrame, keys: list[str], ts: str, value: str, dense: bool = True) -> DataFrame:
    """date and highest value by key; NaN counts as missing. dense: days without rows between a
    key's first and last day have null."""
    low = df.groupBy(*keys, F.col(ts).cast("date").alias("date")).agg(F.max(F.when(~F.isnan(value), F.col(value))).alias("value_max"))
    if not dense:
        return low
    span = low.groupBy(*keys).agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return span.join(low, [*keys, "date"], "left")


def full_window(value: Column, n: int, keys: list, order, reset_by: Column | None = None, how: str = "mean") -> Column:
    """The mean (or sum) of the last n values, null unless all n are there. reset_by starts anew, as
    with a year that is rolled by itself."""
    w = Window.partitionBy(*keys, *([] if reset_by is None else [reset_by])).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, (F.avg if how == "mean" else F.sum)(value).over(w))


def antecedent_index(value: Column, keys: list, order, hours: int = 120, k: float = 0.9) -> Column:
    """Sum of value * k^(t / 24) over the last values, t hours back; null unless all are there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(hours - 1), 0)
    held = F.collect_list(value).over(w)
    weights = F.array(*[F.lit(k ** (j / 24.0)) for j in range(hours - 1, -1, -1)])
    total = F.aggregate(F.zip_with(held, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(held) == hours, total)


def hourly(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """hour and total by key on a dense hourly calendar from the first to the last hour of all rows."""
    sums = df.groupBy(*keys, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.sum(value).alias("total"))
    span = sums.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(spine)) if keys else spine  # hours of a calendar
    return grid.join(sums, [*keys, "hour"], "left").na.fill(0.0, ["total"])


def annual_maxima(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.max(v).alias("annual_max"))


def at_start(value: str, ts: str, start: Column, end: Column) -> Column:
    """Aggregate: the value at the first time inside [start, end]."""
    return F.min_by(F.col(value), F.when(F.col(ts).between(start, end), F.col(ts)))


def numbered(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with the number of each row in an order, from 1: rows are range-sorted, a part's rows are counted where they lie, and the
    parts' counts, one number each, are added up. No window over all rows; nulls come first, equal rows in any order."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # one row a part
    before, total = {}, 0
    for r in counts:
        before[r["_part"]], total = total, total + r["_n"]
    starts = spark.createDataFrame([*before.items()] or [(0, 0)], "_part long, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + inside).alias(name))
