"""Connected components of undirected links, by hooking and pointer jumping over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from genoloom.llm.scratch import Scratch


def spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of ids that join as much as all given ones do, found by union over the task's links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node that ``links`` (a, b) touch with another; component is the smallest node reachable.

    Rounds of small-star and large-star: each node's smaller neighbours, then each node's larger ones, are linked to the
    smallest node around it, until all that is connected hangs on its smallest node. Minima are summed up before the
    shuffle and the joins are of plain tables, so a hub is no hot spot; the links never grow in number.
    """
    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct()
    (edges, before), k = noted(edges, scratch, f"{name}-0"), 0
    while True:
        least = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        around = edges.join(least, F.col("high") == F.col("node")).select("low", "least").filter("low <> least")
        star = least.select(F.col("node").alias("high"), F.col("least").alias("low")).union(around)
        top = star.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        new = star.join(top, F.col("low") == F.col("node"), "left").select("high", F.coalesce("least", "low").alias("low")).distinct()
        (edges, now), k = noted(new, scratch, f"{name}-{k + 1}"), k + 1
        scratch.drop(f"{name}-{k - 1}")
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
        before = now


def noted(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, dict]:
    """Writes links and notes, while they are written, how many they are and what they hash to together."""
    note = Observation()
    kept = scratch.keep(edges.observe(note, F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)")).alias("hash")), name)
    return kept, note.get
