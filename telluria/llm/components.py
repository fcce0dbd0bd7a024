"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluria.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each end of the links ``a, b``; equal roots, one component.

    Each round hangs every node below its least neighbour, follows two steps and
    contracts the links to what the nodes hang from, so at least half of the
    nodes that still have links go.  A node with many links is only ever grouped
    by a minimum.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
                         .select("node", F.least("node", "up").alias("up")))
        over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialize(up.join(over, "up").select("node", F.col("top").alias("up")))
        moved = step.select(F.col("node").alias("root"), F.col("up").alias("top"))
        roots = step.select("node", F.col("up").alias("root")) if roots is None else (
            roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        roots = materialize(roots)
        edges = materialize(
            edges.join(step.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
