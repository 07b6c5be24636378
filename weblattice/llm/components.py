"""Connected components of a graph given by its edges, without collecting any of it.

Each round every vertex points to the least of its neighbours and itself, in the order of a hash of the identifiers, and the edges
are drawn between what their ends point to. The hash keeps the number of rounds near the logarithm of the longest path. Each round is a written
table in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.sources.scratch import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """v and label of every vertex of ``edges`` (a, b); vertices of one component have the same label."""
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        step = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["to"].alias("to")), "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "label")
        else:
            old = labels
            labels = cut(old.join(step.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
            drop(old)
        moved = left.join(step.select(F.col("v").alias("a"), F.col("to").alias("na")), "a").join(step.select(F.col("v").alias("b"), F.col("to").alias("nb")), "b")
        old, left = left, cut(moved.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        drop(old)
        if labels is not None and not hasattr(labels, "scratch_path"):
            labels.scratch_path = step.scratch_path
        elif labels is not None and labels.scratch_path != step.scratch_path:
            drop(step)
    drop(left)
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("label")).limit(0)
