"""Connected components of an undirected graph, by hooking trees and halving their paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


Keep = Callable[[DataFrame, str], DataFrame]


def labels(edges: DataFrame, keep: Keep = written) -> DataFrame:
    """id, label (the smallest id of its component) of every id in edges (a, b).

    Ids with one neighbour - most, where statements hang on documents - are set aside: what
    is left is labelled in rounds, and they get what their neighbour has. Intermediate tables
    are written with `keep`, which ends lineage. Aggregations combine on the map side; a join
    on a large tree's root has one row a key on its other side, and such a skewed join is one
    that Spark splits.
    """
    links = edges.filter("a <> b").select("a", "b")
    both = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "adjacency")
    degree = keep(both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("m")), "degrees")
    ends, inner = degree.filter("n = 1").select(F.col("a").alias("id"), "m"), degree.filter("n > 1").select("a")
    core = keep(both.join(inner, "a", "left_semi").join(inner.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "core")
    found = core.select(F.col("a").alias("id"), F.col("b").alias("label")) if core.isEmpty() else hooked(core, keep)
    pairs = ends.select(F.col("id").alias("m"), F.lit(True).alias("pair"))
    hung = ends.join(found.select(F.col("id").alias("m"), "label"), "m", "left").join(pairs, "m", "left")
    hung = keep(hung.select("id", F.coalesce("label", F.when(F.col("pair"), F.least("id", "m")).otherwise(F.col("m"))).alias("root")), "ends")
    rows = inner.withColumnRenamed("a", "id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("root")).unionByName(hung)
    least = hung.groupBy("root").agg(F.min("id").alias("m"))
    return rows.join(least, "root", "left").select("id", F.least("root", "m").alias("label"))


def hooked(both: DataFrame, keep: Keep) -> DataFrame:
    """id, label of the ids of a symmetric table of edges.

    Each id has a parent of a smaller id, so parents form trees. In a round an id sees the
    grandparents of its neighbours; the least it sees becomes its own parent, and also the
    parent of its old parent (so whole trees are hooked, not single ids), and then every
    parent is replaced by its parent. Path lengths halve, whatever the order of ids: a chain
    of n takes about log2 n rounds.
    """
    state = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("parent"))
    above = state.select(F.col("id").alias("parent"), F.col("parent").alias("up"))
    state = keep(state.join(above, "parent").select("id", "parent", "up"), "labels")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "up"), "b").groupBy(F.col("a").alias("id")).agg(F.min("up").alias("near"))
        seen = keep(state.join(near, "id").select("id", "parent", "up", F.least("up", "near").alias("best")), "seen")
        hook = seen.groupBy(F.col("parent").alias("id")).agg(F.min("best").alias("hook"))
        step = seen.join(hook, "id", "left").select("id", F.least("best", "hook").alias("now"), "parent", "up")
        above = step.select(F.col("id").alias("now"), F.col("now").alias("above"))
        moved = (F.col("now") != F.col("parent")) | (F.col("above") != F.col("up"))
        state = keep(step.join(above, "now").select("id", F.col("now").alias("parent"), F.col("above").alias("up"), moved.alias("moved")), "labels")
        if state.filter("moved").isEmpty():
            return state.select("id", F.col("parent").alias("label"))


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every distinct id. edges: a, b, both among ids."""
    found = labels(edges)
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
