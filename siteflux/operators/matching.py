"""Relaxing prefix match of records to candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut

#: Rows of either side in a block of pairs, about.
BLOCK = 2048


@dataclass
class PrefixMatch:
    """Matches on as many attributes as possible, from the most important on.

    A record's null attributes are left out. Of the others the least important go, one at a time, until a
    candidate agrees with all that are left. The first ``block`` attributes must agree; a record whose
    block has no candidate gets precision 0. For the attributes in ``multi`` a candidate has a list,
    ``<name>_values``, and agrees if the list has the value.

    Records and candidates enter as distinct combinations of attributes with counts, so a dense block
    costs combinations, not rows.
    """

    attributes: list[str]
    block: int
    multi: list[str] = field(default_factory=list)

    def _agrees(self, a: str) -> Column:
        if a in self.multi:
            return F.coalesce(F.array_contains(F.col(f"c.{a}_values"), F.col(f"r.{a}")), F.lit(False))
        return F.coalesce(F.col(f"r.{a}") == F.col(f"c.{a}"), F.lit(False))

    def _held(self) -> list[str]:
        return [f"{a}_values" if a in self.multi else a for a in self.attributes]

    def _depths(self, combos: DataFrame, classes: DataFrame) -> DataFrame:
        """Each combination with each candidate class of its block, and how many attributes agree."""
        block = self.attributes[: self.block]
        on = [F.col(f"r.{a}") == F.col(f"c.{a}") for a in block]
        pairs = combos.alias("r").join(classes.alias("c"), on, "inner")
        marks = F.array(*[F.when(F.col(f"r.{a}").isNotNull(), self._agrees(a)) for a in self.attributes])
        present = F.array_compact(marks)
        miss = F.array_position(present, False)
        depth = F.when(miss > 0, miss - 1).otherwise(F.size(present)).cast("int")
        return pairs.select("r._combo", "c._class", "c._rows", depth.alias("d"))

    def _keyed(self, best: DataFrame) -> DataFrame:
        """match_key and match_type for each combination with its precision."""
        parts = F.array_compact(
            F.array(*[F.when(F.col(a).isNotNull(), F.concat(F.lit(f"({a}=="), F.col(a).cast("string"), F.lit(")"))) for a in self.attributes])
        )
        names = F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in self.attributes]))
        d = F.col("match_precision")
        return best.withColumn("match_key", F.when(d > 0, F.concat_ws("&", F.slice(parts, 1, F.greatest(d, F.lit(1)))))).withColumn(
            "match_type", F.when(d > 0, F.concat_ws("+", F.slice(names, 1, F.greatest(d, F.lit(1)))))
        )

    def run(self, records: DataFrame, candidates: DataFrame, record_id: str, candidate_id: str) -> tuple[DataFrame, DataFrame]:
        """(record_id, match_key, match_type, match_precision, num_matches) for each record, and the
        distinct (match_key, candidate_id)."""
        # to_json leaves nulls out but names the rest, so it tells combinations apart; 128 bits of it do
        combo = F.md5(F.to_json(F.struct(*self.attributes)))
        cls = F.md5(F.to_json(F.struct(*self._held())))
        combos = records.select(combo.alias("_combo"), *self.attributes).dropDuplicates(["_combo"])
        keyed = candidates.withColumn("_class", cls)
        classes = keyed.groupBy("_class", *self._held()).agg(F.count("*").alias("_rows"))
        depths = cut(self._depths(combos, classes))  # read twice
        best = depths.groupBy("_combo", "d").agg(F.sum("_rows").alias("n")).groupBy("_combo")
        best = best.agg(F.max(F.struct("d", "n")).alias("_b")).select("_combo", F.col("_b.d").alias("match_precision"), F.col("_b.n").alias("num_matches"))
        found = combos.join(best, "_combo", "left").na.fill(0, ["match_precision", "num_matches"])
        found = self._keyed(found).select("_combo", "match_key", "match_type", "match_precision", "num_matches")
        info = records.select(record_id, combo.alias("_combo")).join(found, "_combo").drop("_combo")
        hits = depths.join(found.filter("match_precision > 0"), "_combo").filter("d = match_precision").select("match_key", "_class").distinct()
        lookup = hits.join(keyed.select("_class", candidate_id), "_class").select("match_key", candidate_id).distinct()
        return info, lookup


def best_candidates(pairs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first by order."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def in_blocks(left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """left and right with _l and _r: two rows that share by share one block (by, _l, _r), which has about so many rows of
    either side, so that a hot value's pairs are dealt out, however few rows they come from. Rows without a partner are left out."""
    n = left.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("_nl"))
    n = n.join(right.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("_nr")), by)
    out = []
    for df, key, own, other in ((left, left_id, "l", "r"), (right, right_id, "r", "l")):
        placed = df.join(n, by).withColumn(f"_{own}", F.pmod(F.xxhash64(key), f"_n{own}").cast("int"))
        out.append(placed.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).drop("_nl", "_nr").repartition(*by, "_l", "_r"))
    return out[0], out[1]


def blocked_join(left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, rows: int = BLOCK) -> DataFrame:
    """The inner join of left and right by equal values, as in_blocks() deals it out."""
    l, r = in_blocks(left, right, by, left_id, right_id, rows)  # noqa: E741
    return l.join(r, [*by, "_l", "_r"]).drop("_l", "_r")
