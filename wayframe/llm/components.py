"""Connected components of a link table, by hooking each node on its smallest neighbour and contracting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, label) of each node of the links (a, b) and of known; label: the smallest id that links reach. Loops do no harm.

    Each round points every node to its smallest neighbour, or itself, and on to where that points; links then lead between what
    their ends point to, and those within one such node go. So links shrink fast, and a node's neighbours are never gathered.
    known: labels of earlier links, whose classes then are nodes from the start. Tables in the shared folder cut the lineage.
    """
    e = edges.select("a", "b")
    if known is not None:
        for c in ("a", "b"):
            e = e.join(known.select(F.col("id").alias(c), F.col("label").alias("l")), c, "left").withColumn(c, F.coalesce("l", c)).drop("l")
    e = e.where("a <> b")
    e = common.checkpointed(e.select("a", "b").union(e.select("b", "a")).distinct())
    labels = common.checkpointed(e.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
    while not e.isEmpty():
        near = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        step = common.checkpointed(near.join(near.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p")))
        moved_on = labels.join(step.select(F.col("a").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        labels = common.checkpointed(moved_on, labels)
        moved = e.join(step, "a").select(F.col("p").alias("x"), "b").join(step.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        e = common.checkpointed(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), e, step)
    if known is None:
        return labels
    on = known.join(labels.select(F.col("id").alias("label"), F.col("label").alias("n")), "label", "left").select("id", F.coalesce("n", "label").alias("label"))
    return common.checkpointed(on.union(labels.join(known, "id", "left_anti").select("id", "label")))
