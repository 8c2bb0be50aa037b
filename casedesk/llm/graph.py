"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casedesk.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node it is connected to.

    Contraction: every node hooks onto its smallest neighbour, links are redrawn between what
    their ends hooked onto, and loops and repeats go. Each round at least halves the nodes that
    still have links; what is written in a round is all that the next one needs. A node with very
    many links is reduced to their minimum before the shuffle.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = materialize(ends.where("a <> b").distinct(), "links")
    both = edges.select("a").union(edges.select("b"))
    found = materialize(both.distinct().select(F.col("a").alias("node"),
                                               F.col("a").alias("component")), "components")
    while not edges.isEmpty():
        ways = edges.union(edges.select("b", "a"))
        hook = materialize(
            ways.groupBy("a").agg(F.min("b").alias("least"))
            .select("a", F.least("a", "least").alias("up")), "hooks")
        # Two steps at once: a chain of hooks gets half as long.
        far = hook.select(F.col("a").alias("up"), F.col("up").alias("far"))
        hook = materialize(hook.join(far, "up", "left")
                           .select("a", F.coalesce("far", "up").alias("up")), "hooks")
        left, right = hook.toDF("a", "x"), hook.toDF("b", "y")
        edges = materialize(
            edges.join(left, "a", "left").join(right, "b", "left")
            .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
            .where("a <> b").distinct(), "links")
        found = materialize(
            found.join(hook.toDF("component", "up"), "component", "left")
            .select("node", F.coalesce("up", "component").alias("component")), "components")
    return found
