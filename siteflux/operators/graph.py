"""Flow networks: median imputation, reversal, upstream reach with a travel-time cutoff."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: Steps of reach() after which its parts are put together.
COMPACT = 16
#: Paths that reach() makes beforehand, as a multiple of the edges.
GROWTH = 8


def impute_median(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Nulls become the exact median of their group (aggregate and join, so no group meets in a window)."""
    mid = df.groupBy(F.col(by).alias("_by")).agg(*[F.median(c).alias(f"_{c}") for c in columns])
    joined = df.join(mid, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def edges_of(nodes: DataFrame, node: str, downstream: str, weight: str) -> DataFrame:
    """src, dst, weight of a table whose rows name their downstream node; 0 and null end a path."""
    return nodes.filter(F.col(downstream) != 0).select(F.col(node).alias("src"), F.col(downstream).alias("dst"), F.col(weight).alias("weight"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def first_nodes(*frames: DataFrame, key: str) -> DataFrame:
    """Nodes of several sources; of those that share a key the first source's stays."""
    from ..sources.tables import first_source

    return first_source(list(frames), [key])


def reach(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """source, node, dist: the shortest travel time to every node within the cutoff, each source
    itself included. Weights are not below 0, else the search might not end, so it raises an error. The frontier moves a stride of
    up to four edges at a time and only better distances go on, until none is left, so cycles end."""
    if edges.filter("weight < 0").take(1):
        raise ValueError("travel times are not below 0")
    known = frontier = cut(sources.select(F.col("node").alias("source"), F.col("node"), F.lit(0.0).alias("dist")).distinct())
    e = _strides(edges.filter(F.col("weight") <= cutoff).select(F.col("src").alias("node"), "dst", "weight"), cutoff)
    for k in itertools.count():
        step = frontier.join(e, "node").select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        step = step.filter(F.col("dist") <= cutoff).groupBy("source", "node").agg(F.min("dist").alias("dist"))
        old = known.groupBy("source", "node").agg(F.min("dist").alias("_old"))
        frontier = cut(step.join(old, ["source", "node"], "left").filter("_old IS NULL OR dist < _old").drop("_old"))
        if frontier.isEmpty():
            break
        #: Only the frontier is written; what is known is its parts, put together now and then.
        known = known.unionByName(frontier)
        if k % COMPACT == COMPACT - 1:
            known = cut(known.groupBy("source", "node").agg(F.min("dist").alias("dist")))
    return known.groupBy("source", "node").agg(F.min("dist").alias("dist"))


def _strides(edges: DataFrame, cutoff: float) -> DataFrame:
    """The edges, and paths of two and of four of them within the cutoff as edges of their own, as long as
    these are few: their number is known from the nodes' degrees before any path is made."""
    edges = cut(edges.groupBy("node", "dst").agg(F.min("weight").alias("weight")))
    most = GROWTH * edges.count()
    for _ in range(2):
        degree = edges.groupBy(F.col("node").alias("dst")).agg(F.count("*").alias("_n"))
        paths = edges.join(degree, "dst").agg(F.sum("_n")).first()[0] or 0
        if not 0 < paths <= most:
            break
        on = edges.select(F.col("node").alias("dst"), F.col("dst").alias("_to"), F.col("weight").alias("_w"))
        two = edges.join(on, "dst").select("node", F.col("_to").alias("dst"), (F.col("weight") + F.col("_w")).alias("weight")).filter(F.col("weight") <= cutoff)
        edges = cut(edges.unionByName(two).groupBy("node", "dst").agg(F.min("weight").alias("weight")))
    return edges


def within_thresholds(reached: DataFrame, thresholds: list[float]) -> DataFrame:
    """source, tau, node, dist: the nodes within each threshold, which nest."""
    taus = F.array(*[F.lit(float(t)) for t in thresholds])
    return reached.withColumn("tau", F.explode(taus)).filter(F.col("dist") <= F.col("tau"))


def upstream_mean(reached: DataFrame, areas: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Area-weighted mean over what each source and threshold reaches, by the columns in by; areas has
    node and area, values has node, value and by. Nodes without values don't count."""
    joined = reached.join(areas, "node").join(values, "node")
    area = F.sum("area").cast("double")
    total = F.try_divide(F.sum(F.col("value") * F.col("area")).cast("double"), area)
    return joined.groupBy("source", "tau", *by).agg(area.alias("area"), total.alias("mean_value"))
