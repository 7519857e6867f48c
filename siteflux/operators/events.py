"""Counting records inside events, and assembling features by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A catalogue of at most so many events is broadcast; a larger one is dealt out by day or span.
SMALL_CATALOGUE = 10_000
#: Ranges of records meet an event's midpoint in spans of so many days.
SPAN = 32


def _sent(events: DataFrame) -> DataFrame:
    return F.broadcast(events) if events.limit(SMALL_CATALOGUE + 1).count() <= SMALL_CATALOGUE else events


def _spans(first: Column, last: Column, days: int) -> Column:
    """Numbers of the spans of days that a closed range touches; none if it has no or unordered ends."""
    number = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    return F.explode(F.when(first <= last, F.sequence(number(first), number(last))))


def inside(facts: DataFrame, ts: str, events: DataFrame) -> DataFrame:
    """Rows of facts with each event (event, start, end) whose closed range holds their time."""
    days = events.withColumn("_day", _spans(F.col("start"), F.col("end"), 1))
    dated = facts.withColumn("_day", F.unix_date(F.to_date(ts)).cast("long"))
    return dated.join(_sent(days), "_day").filter(F.col(ts).between(F.col("start"), F.col("end"))).drop("_day")


def in_force(policies: DataFrame, opened: str, closed: str, events: DataFrame, floor: str = "2010-01-01") -> DataFrame:
    """Rows whose closed range holds an event's midpoint; midpoints before floor count as floor."""
    middle = F.greatest(F.col("start") + (F.col("end") - F.col("start")) / 2, F.lit(floor).cast("timestamp_ntz"))
    at = events.withColumn("_middle", middle).withColumn("_span", F.floor(F.unix_date(F.to_date("_middle")) / SPAN))
    held = policies.withColumn("_span", _spans(F.col(opened), F.col(closed), SPAN))
    return held.join(_sent(at), "_span").filter(F.col("_middle").between(F.col(opened), F.col(closed))).drop("_span", "_middle")


def presence_absence(claims: DataFrame, policies: DataFrame, buildings: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Counts by event and key.

    num_presence = min(claims, buildings); num_absence = min(max(policies - claims, 0), buildings -
    presence). claims and policies have one row for each record and event; buildings has num_buildings
    by key, and keys without buildings have none.
    """
    c = claims.groupBy(*keys).agg(F.count("*").alias("num_claims"))
    p = policies.groupBy(*keys).agg(F.count("*").alias("num_policies"))
    out = c.join(p, keys, "full_outer").join(buildings.select(key, "num_buildings"), key, "left")
    out = out.na.fill(0, ["num_claims", "num_policies", "num_buildings"])
    out = out.withColumn("num_presence", F.least("num_claims", "num_buildings"))
    spare = F.greatest(F.col("num_policies") - F.col("num_claims"), F.lit(0))
    return out.withColumn("num_absence", F.least(spare, F.col("num_buildings") - F.col("num_presence")))


def totals(counts: DataFrame, event: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("num_policies", "num_claims", "num_presence", "num_absence")]
    out = counts.groupBy(event).agg(*sums)
    return out.withColumn("kept_ratio", F.try_divide(F.col("num_presence") + F.col("num_absence"), F.greatest("num_policies", "num_claims")))


def window_max(values: DataFrame, ts: str, value: str, by: list[str], events: DataFrame) -> DataFrame:
    """Highest value by event and entity inside the event's range."""
    return inside(values, ts, events).groupBy("event", *by).agg(F.max(value).alias("event_max"))


def rolled_up(rows: DataFrame, identity: list[str], constants: list[str], features: list[str]) -> DataFrame:
    """Means of features for each identity; constants are the same in all of its rows."""
    return rows.groupBy(*identity).agg(*[F.max(c).alias(c) for c in constants], *[F.try_divide(F.sum(f).cast("double"), F.count(f)).alias(f) for f in features])
