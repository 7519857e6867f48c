"""Joins to the nearest row on an irregular axis, such as the last reading before a time.

Both sides lie in one table that is sorted by key and axis over range-sorted parts. A task walks through its part with the last
row of the right side in hand; what it needs from before its part is the last such row of the parts before, one
row a part, which the driver hands on. No key has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut


def _filled(both: DataFrame, descending: bool) -> DataFrame:
    """_l and _r of the rows with a left side: the right side's last row of the key before it, along the order."""
    spark = both.sparkSession
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    #: On equal places the right side comes first, so that it counts either way.
    order = [F.col("_h"), F.col("_key"), way("_at"), F.desc("_right"), way("_tie")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(both.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    kind = ranged.schema["_r"].dataType.simpleString()

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a part: its first and last key, and the last right row of the last key."""
        first = last = row = None
        for b in batches:
            if not b.num_rows:
                continue
            h, right = b.column("_h").to_numpy(), b.column("_right").to_numpy(zero_copy_only=False)
            first = int(h[0]) if first is None else first
            at = np.flatnonzero(right & (h == h[-1]))
            if len(at):
                row = b.column("_r").slice(int(at[-1]), 1)
            elif last != int(h[-1]):
                row = None
            last = int(h[-1])
        if first is not None:
            number = TaskContext.get().partitionId()
            row = pa.nulls(1, ranged_type) if row is None else row
            yield pa.RecordBatch.from_arrays([pa.array([number], "int32"), pa.array([first]), pa.array([last]), row], ["part", "first", "last", "row"])

    from pyspark.sql.pandas.types import to_arrow_type

    ranged_type = to_arrow_type(ranged.schema["_r"].dataType)
    #: One row for each part.
    found = ranged.mapInArrow(tails, f"part int, first long, last long, row {kind}").orderBy("part").toArrow().combine_chunks()
    carried: dict[int, tuple[int, pa.Array]] = {}
    key, row = None, None
    for k in range(found.num_rows):
        part, first, last = (found.column(c)[k].as_py() for c in ("part", "first", "last"))
        own = found.column("row").slice(k, 1).combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        if key == first and row is not None:
            carried[part] = (key, row)
        if own.is_valid()[0].as_py():
            key, row = last, own
        elif last != key:
            key, row = last, None
    sent = spark.sparkContext.broadcast({p: (k, r.to_pylist()) for p, (k, r) in carried.items()})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = sent.value.get(TaskContext.get().partitionId(), (None, None))
        row = None if row is None else pa.array(row, ranged_type)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h, right = b.column("_h").to_numpy(), b.column("_right").to_numpy(zero_copy_only=False)
            place, new = np.arange(n), np.concatenate(([True], h[1:] != h[:-1]))
            start = np.maximum.accumulate(np.where(new, place, 0))
            last = np.maximum.accumulate(np.where(right, place, -1))
            take = np.where(last >= start, last, -1)
            rows = b.column("_r")
            if row is not None and key == h[0]:
                rows = pa.concat_arrays([rows, row.cast(rows.type)])
                take = np.where((take < 0) & (start == 0), n, take)
            left = np.flatnonzero(~right)
            mask = take[left] < 0
            yield pa.RecordBatch.from_arrays([b.column("_l").take(pa.array(left)), rows.take(pa.array(np.where(mask, 0, take[left]), mask=mask))], ["_l", "_r"])
            if take[-1] >= 0:
                row = rows.slice(int(take[-1]), 1)
            elif key != h[-1]:
                row = None
            key = h[-1]

    return ranged.mapInArrow(fill, f"_l {ranged.schema['_l'].dataType.simpleString()}, _r {kind}")


def nearest_rows(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], direction: str = "backward", within: float | None = None) -> DataFrame:
    """left's rows with the columns take of the right row of the same keys that is nearest on the axis at: the last one at or before
    it (backward), the first at or after it (forward), or the nearer of both, the earlier if they are as near (nearest).

    Of right rows that share keys and place one counts, by the hash of what is taken. within: the farthest that counts, in the axis'
    unit, seconds for times. Left rows without such a row, a place or a key have nulls. Columns are named near_ and the taken one;
    with the direction both there are also before_ and after_, for two walks in all."""
    kinds = dict(left.dtypes)
    row = F.struct(F.col(at).alias("_place"), *[F.col(c) for c in take])
    key, tie = F.struct(*[F.col(k) for k in keys]), F.xxhash64(*[F.col(c) for c in take])
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    named = [F.xxhash64(*keys).alias("_h"), key.alias("_key"), F.col(at).alias("_at")]
    right_type, left_type = right.select(row.alias("r")).schema["r"].dataType, left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    theirs = right.filter(known).select(*named, F.lit(True).alias("_right"), tie.alias("_tie"), F.lit(None).cast(left_type).alias("_l"), row.alias("_r"))
    whole = F.struct(*[F.col(c) for c in left.columns])

    def joined(rows: DataFrame, descending: bool) -> DataFrame:
        ours = rows.select(*named, F.lit(False).alias("_right"), F.lit(0).cast("long").alias("_tie"), whole.alias("_l"), F.lit(None).cast(right_type).alias("_r"))
        return _filled(ours.unionByName(theirs), descending)

    def off(r: str) -> Column:
        a, b = F.col(f"_l.{at}"), F.col(f"{r}._place")
        timed = kinds[at].startswith("timestamp") or kinds[at] == "date"
        return F.abs(F.timestamp_diff("MICROSECOND", b, a) / 1e6 if timed else a.cast("double") - b.cast("double"))

    open_ = left.filter(known)
    if direction in ("nearest", "both"):
        #: The second walk carries what the first has found.
        first = joined(open_, False)
        again = first.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], F.col("_r").alias("_before"))
        whole = F.struct(*[F.col(c) for c in [*left.columns, "_before"]])
        left_type = again.select(whole.alias("l")).schema["l"].dataType
        theirs = theirs.withColumn("_l", F.lit(None).cast(left_type))
        both = joined(again, True)
        earlier = F.col("_r").isNull() | (F.col("_l._before").isNotNull() & (off("_l._before") <= off("_r")))
        found = both.select("_l", F.when(earlier, F.col("_l._before")).otherwise(F.col("_r")).alias("_r"), F.col("_l._before").alias("_before"), F.col("_r").alias("_after"))
    elif direction in ("backward", "forward"):
        found = joined(open_, direction == "forward")
    else:
        raise ValueError("direction is backward, forward, nearest or both")
    if within is not None:
        found = found.withColumn("_r", F.when(off("_r") <= within, F.col("_r")))
    named = {"near": "_r", **({"before": "_before", "after": "_after"} if direction == "both" else {})}
    taken = [F.col(f"{r}.{c}").alias(f"{name}_{to}") for name, r in named.items() for c, to in (*zip(take, take), ("_place", at))]
    out = found.select(*[F.col(f"_l.{c}").alias(c) for c in kinds], *taken)
    rest = left.filter(~F.coalesce(known, F.lit(False)))
    types = dict(out.dtypes)
    return out.unionByName(rest.select(*left.columns, *[F.lit(None).cast(types[c]).alias(c) for c in out.columns if c not in kinds]))
