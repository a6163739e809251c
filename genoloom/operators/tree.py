"""Clone trees as edge tables (parent, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.sources.files import kept


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def doubled(jumps: DataFrame, step: int, most: int) -> DataFrame:
    """Jumps (ancestor, node) over twice as many edges, written. With jumps over more edges than nodes there is a cycle."""
    if step > most and jumps.limit(1).count():
        raise ValueError("the tree has a cycle")
    further = jumps.select(F.col("ancestor").alias("mid"), "node").join(jumps.select("ancestor", F.col("node").alias("mid")), "mid")
    return kept(further.select("ancestor", "node"), "jumps")


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, depth), each node its own ancestor at depth 0; a row for each path where a node has several parents.

    Paths double in length each round: those of up to twice the length are those there are, and each node's jump of just
    that length followed by one of them. So a chain of any length takes the logarithm of it in rounds over written
    tables. A cycle is an error; null nodes have no edge.
    """
    jumps, step = kept(edges.filter("parent IS NOT NULL AND child IS NOT NULL").select(F.col("parent").alias("ancestor"), F.col("child").alias("node")), "jumps"), 1
    all_nodes = nodes(edges).filter("node IS NOT NULL")
    paths, most = kept(all_nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth")), "paths"), all_nodes.count()
    while jumps.limit(1).count():
        longer = jumps.select(F.col("ancestor").alias("mid"), "node").join(paths.select("ancestor", F.col("node").alias("mid"), "depth"), "mid")
        new = kept(longer.select("ancestor", "node", (F.col("depth") + step).alias("depth")), "paths")
        paths, jumps, step = paths.union(new), doubled(jumps, step, most), 2 * step
    return paths


def frequency(edges: DataFrame) -> DataFrame:
    """Nodes of each subtree, its root included, by sums over jumps of doubling length: no pair of nodes is formed but those of a jump."""
    jumps, step = kept(edges.filter("parent IS NOT NULL AND child IS NOT NULL").select(F.col("parent").alias("ancestor"), F.col("child").alias("node")), "jumps"), 1
    sums = kept(nodes(edges).filter("node IS NOT NULL").withColumn("freq", F.lit(1).cast("long")), "sums")
    most = sums.count()
    while jumps.limit(1).count():
        below = jumps.join(sums, "node").select(F.col("ancestor").alias("node"), "freq")
        sums = kept(sums.union(below).groupBy("node").agg(F.sum("freq").alias("freq")), "sums")
        jumps, step = doubled(jumps, step, most), 2 * step
    return sums


def allele_map(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(clone, variant): what a clone has itself or from an ancestor. ``parts``: (node, variant)."""
    return closure(edges).join(parts.select(F.col("node").alias("ancestor"), "variant"), "ancestor").select(F.col("node").alias("clone"), "variant").distinct()
