"""Monte-Carlo assignment without replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut

#: Groups that tasks get a copy of; more of them are joined by exchanges.
BROADCAST = 100_000


def hash_order(seed: int, *columns: str) -> Column:
    """A pseudo-random order that reruns, other engines and retried tasks share."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _share(n: Column, of: Column) -> Column:
    """The share of hashes to let through so that n of so many rows are among them but for one case in many millions."""
    return (n + 8 * F.sqrt(n) + 40) / of


def _drawn(groups: DataFrame, rows: Callable[[DataFrame], DataFrame], order: Column, item: str) -> DataFrame:
    """The first _n rows of each group by order, a hash in hex digits, with their place as _place. groups has _g, _n and _of, a
    group's number of rows; rows(groups) has the rows of some groups.

    Hashes are spread evenly, so the first rows lie under a bound that their share gives. Only rows under it are written and
    sorted; a group that has too few of them is drawn from all of its rows."""
    #: 12 digits are 48 bits, which a double holds.
    bound = F.lpad(F.lower(F.hex((F.least(F.lit(1.0), _share(F.col("_n"), F.col("_of"))) * float((1 << 48) - 1)).cast("long"))), 12, "0")
    asked = cut(groups.filter("_n > 0").withColumn("_bound", bound))
    few = asked.count() <= BROADCAST
    sent = lambda g: F.broadcast(g) if few else g
    hashed = lambda g: rows(sent(g)).withColumn("_hash", order)
    some = cut(hashed(asked).filter(F.substring("_hash", 1, 12) <= F.col("_bound")))
    found = some.groupBy("_g").agg(F.count("*").alias("_m"))
    short = cut(asked.join(found, "_g", "left").filter(F.coalesce("_m", F.lit(0)) < F.least("_n", "_of")).select(asked.columns))
    if not short.isEmpty():
        some = some.join(sent(short.select("_g")), "_g", "left_anti").unionByName(hashed(short))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_hash", item))
    return some.withColumn("_place", place).filter("_place <= _n")


def sample_per_group(df: DataFrame, keys: list[str], n: Column, seed: int, item: str) -> DataFrame:
    """Exactly n rows of each group (all, if it has fewer), without replacement."""
    #: A struct, which null keys don't keep from joins.
    rows = df.withColumn("_g", F.struct(*keys)).withColumn("_own", n)
    groups = rows.groupBy("_g").agg(F.max("_own").alias("_n"), F.count("*").alias("_of"))
    drawn = _drawn(groups, lambda g: rows.join(g, "_g"), hash_order(seed, *keys, item), item)
    return drawn.filter("_place <= _own").select(df.columns)


def assign(counts: DataFrame, lookup: DataFrame, key: str, item: str, replicates: int, seed: int) -> DataFrame:
    """replicate, key, item and flooded: in each replicate a key's num_presence + num_absence items are
    drawn and the first num_presence of them are 1.

    Keys that draw nothing leave before the candidates are expanded, and candidates whose hash is too high to be drawn
    leave before they are dealt out; see _drawn()."""
    items = lookup.select(key, item)
    asked = counts.filter("num_presence + num_absence > 0").select(key, "num_presence", F.expr("num_presence + num_absence AS _n"))
    asked = asked.join(items.groupBy(key).agg(F.count("*").alias("_of")), key)
    groups = asked.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_g", F.struct("replicate", key))
    drawn = _drawn(groups, lambda g: items.join(g, key), hash_order(seed, "replicate", key, item), item)
    return drawn.select("replicate", key, item, (F.col("_place") <= F.col("num_presence")).cast("int").alias("flooded"))
