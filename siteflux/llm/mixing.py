"""Mixing sources to target weights along a time-varying curriculum.

Shares. Sources, by code point with null last, weigh 1, 2, 3, repeating. A target stops at
``MAX_REPEATS`` times its source's size and the excess goes to the others by weight. In order of
cap / weight the sources at their cap are a prefix, so one pass of running sums finds the level
that all others share.

Curriculum. A source's weight moves in a straight line over training time t in [0, 1]; the integral
of the schedule up to t, as a part of its whole, is G(t) = t + a (t^2 - t), where a is the source's
slope. The mix reads a source's documents in a fixed pseudo-random order, again and again, until its
target is met. The word offset at which a reading starts, divided by the target, is the demand met
so far, and the inverse of G gives the training position. The document at which the target is met
gives the words that are still missing.

Scale. Running word offsets need no window over a whole source: documents fall into ``BUCKETS`` hash
buckets of their source; sums of buckets are added up first, and each bucket then runs its own
window. The sources themselves are ranked and added up in range-sorted parts. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

MAX_REPEATS = 3
BUCKETS = 2048
#: Slopes of the weight schedules, by the source's weight 1, 2, 3.
SLOPES = (-0.5, 0.0, 0.5)


def position_of(part: Column, slope: Column) -> Column:
    """The time t in [0, 1] with t + a (t^2 - t) = part."""
    b = F.lit(1.0) - slope
    root = F.sqrt(b * b + F.lit(4.0) * slope * part)
    return F.when(part <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * part / (b + root))


def running(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """df with _place and _before_<column>: the number of rows, and each column's sum, ahead of a row in an
    order without ties. Range-sorted parts run their own windows; only one row a part is added up in one task."""
    rows = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_part", F.shiftright("_id", 33)))
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in columns])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    starts = sums.select("_part", start("_n").alias("_n"), *[start(f"_sum_{c}").alias(f"_sum_{c}") for c in columns])
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    own = {f"_before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    placed = rows.withColumns({"_place": F.coalesce(F.count("*").over(inside), F.lit(0)), **own}).join(starts, "_part")
    total = {"_place": F.col("_place") + F.col("_n"), **{f"_before_{c}": F.col(f"_before_{c}") + F.col(f"_sum_{c}") for c in columns}}
    return placed.withColumns(total).drop("_id", "_part", "_n", *[f"_sum_{c}" for c in columns])


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, slope and target of each source of (source, size). However many sources
    there are, no task sees them all; three numbers reach the driver."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    weighed = running(by_source, [by_name], []).withColumn("weight", F.pmod("_place", F.lit(3)) + 1).drop("_place")
    weighed = weighed.withColumn("_cap", MAX_REPEATS * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    levels = cut(running(weighed, [F.col("_ratio"), by_name], ["_cap", "weight"]))
    size, weight = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size).cast("long") - F.col("_before__cap")).cast("double") / (F.lit(weight).cast("long") - F.col("_before_weight"))
    fitting = levels.withColumn("_level", level).filter(F.col("_level") * F.col("weight") <= F.col("_cap"))
    #: The level of the first that fits; those after it have lower ones, as too much counts as capped there.
    shared = fitting.agg(F.max("_level")).first()[0]
    cap = F.col("_cap").cast("double")
    target = F.least(F.coalesce(F.lit(shared).cast("double") * F.col("weight"), cap), cap)
    slope = F.element_at(F.array(*[F.lit(x) for x in SLOPES]), F.col("weight").cast("int"))
    return levels.select("source", "source_size", "weight", slope.alias("slope"), target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with doc_id, size, source_size, target, taken, offset, slope,
    order and row, in no particular order: how many of the document's words the mix takes, repeats
    counted. row is a hash of the whole row, which tells rows of one id apart.

    A null text has no words and gives none. Documents without an id, and repeated rows, count each
    as a document. An empty table gives no rows.
    """
    #: Of the text too, so that rows of one id, or of none, don't meet in one bucket.
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(docs).alias("row"), key.alias("order")))
    keyed = sizes
    keyed = keyed.withColumn("_bucket", F.pmod(F.conv(F.substring("order", 1, 7), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    starts = starts.join(source_targets(sizes).withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
    inside = Window.partitionBy("source", "_bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = run.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    offset = F.col("_start") + F.col("_run")
    return placed.select(
        "doc_id", "size", "source_size", "target", taken_words(offset).alias("taken"), offset.alias("offset"), "slope", "order", "row"
    )


def row_key(docs: DataFrame) -> Column:
    """A hash of a whole row (maps, which have no order, left out), which tells rows of one id apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])


def taken_words(offset: Column) -> Column:
    whole = F.floor("target").cast("long")
    return sum(
        (F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - e * F.col("source_size") - offset)) for e in range(MAX_REPEATS)),
        F.lit(0).cast("long"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each reading of a document: doc_id, row, epoch, position, size, words and order.
    Sorted by position, then order, they are the curriculum."""
    start = F.col("offset") + F.col("epoch") * F.col("source_size")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target").cast("long") - start))
    readings = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    readings = readings.withColumn("words", words).filter("words > 0")
    position = position_of(start.cast("double") / F.col("target"), F.col("slope"))
    return readings.select("doc_id", "row", "epoch", position.alias("position"), "size", "words", "order")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, range-sorted by position, with the columns of docs.

    A document is there once for each reading; the reading that meets its source's target counts
    if the mix takes half of its words or more, and whole documents come out. Documents without words
    are not read."""
    readings = training_order(mix(docs)).filter(2 * F.col("words") >= F.col("size"))
    readings = readings.select("doc_id", "row", "position", "order")
    #: Whole rows travel as one column, so that no name of docs can clash.
    texts = docs.select(F.col("doc_id").alias("_id"), row_key(docs).alias("_row"), F.struct(*[F.col(c) for c in docs.columns]).alias("_whole"))
    texts = texts.dropDuplicates(["_id", "_row"])  # equal rows: each has readings of its own
    joined = texts.join(readings, (F.col("_row") == F.col("row")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    return joined.orderBy("position", "order").select("_whole.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes and its first training position, range-sorted
    by that; documents that are not taken have none and come last."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.when(F.col("taken") > 0, F.round(position_of(F.col("offset").cast("double") / F.col("target"), F.col("slope")), 9))
    ordered = mixed.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "order", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM weighed),
shared AS (SELECT arg_min(lev, cap / weight) AS s FROM levels WHERE lev * weight <= cap),
targets AS (
  SELECT source, source_size, least(coalesce(s * weight, cap::DOUBLE), cap::DOUBLE) AS target, [-0.5, 0.0, 0.5][weight]::DOUBLE AS a
  FROM levels LEFT JOIN shared ON true),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY ('0x' || substr(k, 1, 7))::BIGINT % 2048, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (greatest(0, least(size, floor(target)::BIGINT - c)) + greatest(0, least(size, floor(target)::BIGINT - source_size - c))
    + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - c)))::BIGINT AS taken FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN c = 0 THEN 0.0::DOUBLE
         ELSE round(2.0::DOUBLE * (c::DOUBLE / target) / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * (c::DOUBLE / target))), 9) END END AS position
FROM counted
"""
