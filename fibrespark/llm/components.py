"""Connected components of links between longs, as joins and grouped aggregates.

Each round every node points to the neighbour (or itself) that comes first in a fixed random order, and links are contracted along these
pointers; the nodes that stay are about halved, whatever the shape of the components. A hub's links are pre-aggregated
on the map side and its joins may be split by adaptive execution. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _order(node):
    return F.struct(F.xxhash64(node).alias("h"), node.alias("n"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """links (a, b), a written table, to (node, root): one row per node that has a link; nodes of one component share a root, which is one of them.

    ``known``: the result for links found before. Only what the new links join is contracted then, and the rows of ``known`` come first to their new roots.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    if known is not None:
        ra, rb = known.toDF("a", "ra"), known.toDF("b", "rb")
        edges = edges.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = written(edges.where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy("a").agg(F.least(F.min(_order(F.col("b"))), _order(F.first("a")))["n"].alias("to")).withColumnRenamed("a", "node"), "pointers")
        steps.append(point)
        left = edges.join(point, edges["a"] == point["node"]).select(F.col("to").alias("a"), "b")
        right = left.join(point, left["b"] == point["node"]).select("a", F.col("to").alias("b"))
        edges = written(right.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not steps:
        return links.sparkSession.createDataFrame([], "node long, root long") if known is None else known
    # roots of the last round are final; earlier pointers follow them
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = found.withColumnRenamed("node", "n")
        found = written(step.join(later, step["to"] == later["n"], "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    if known is None:
        return found
    moved = known.join(found.toDF("n", "r"), F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    return written(moved.unionByName(found.join(known.select("node"), "node", "left_anti")), "roots")
