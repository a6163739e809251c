"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.components import components, spanning
from genoloom.llm.scratch import Scratch

COSINE, RECALL = 0.93, 0.999
#: Rows the codebooks are fitted on at most (smallest hashes first), vectors a cell is to hold, and rows of a block. A half
#: has no more centres than rows it is fitted on, so a label of up to SAMPLE ** 2 * CELL_ROWS vectors (1.6e9) has its cells.
SAMPLE, CELL_ROWS, BLOCK_ROWS = 8192, 24, 512


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None])


def codebook(x: np.ndarray, size: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means centres of one half of the sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        for k in np.unique(own):
            centres[k] = x[own == k].mean(0)
    return centres


class Index:
    """Two codebooks, whose product is the grid of cells, and how far beyond its best cell a query's traversal goes."""

    def __init__(self, sample: np.ndarray, cells: int, cosine: float = COSINE, recall: float = RECALL):
        size = max(1, round(np.sqrt(cells)))
        self.books = [codebook(x, size, seed=i) for i, x in enumerate(halves(sample))]
        self.slack = self.calibrated(sample, cosine, recall)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [squared(h, b) for h, b in zip(halves(x), self.books, strict=True)]

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def calibrated(self, sample: np.ndarray, cosine: float, recall: float) -> float:
        """The slack within which the traversal meets, in the ``recall`` share of cases, the cell of a neighbour.

        The neighbours are made for the purpose, in random directions and exactly at ``cosine``, so they are the
        farthest that count.
        """
        noise = np.random.default_rng(11).standard_normal(sample.shape)
        noise -= (noise * sample).sum(1)[:, None] * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        other = cosine * sample + np.sqrt(max(0.0, 1 - cosine * cosine)) * noise
        (a, b), (c, d) = self.distances(sample), self.distances(other)
        rows = np.arange(len(sample))
        beyond = a[rows, c.argmin(1)] + b[rows, d.argmin(1)] - a.min(1) - b.min(1)
        return float(np.quantile(beyond, recall, method="higher")) + 1e-9

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector its cells by a multi-sequence traversal, nearest first, until the slack is used up."""
        a, b = self.distances(x)
        left, right = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        for i in range(len(x)):
            p, q = traversed(a[i, left[i]].tolist(), b[i, right[i]].tolist(), self.slack)
            yield left[i, p] * len(self.books[1]) + right[i, q]


def traversed(u: list[float], v: list[float], slack: float) -> tuple[list[int], list[int]]:
    """Places (p, q) of the sums u[p] + v[q], from the least to those within ``slack`` of it; u and v ascend.

    The frontier holds places both of whose neighbours before have been taken, so the next sum is on it.
    """
    heap, p, q = [(u[0] + v[0], 0, 0)], [], []
    most, row = u[0] + v[0] + slack, [0] * (len(u) + 1)
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        p.append(i)
        q.append(j)
        row[i] = j + 1
        # row[k] counts the places of row k taken; the next of a row is free once the row before is a place further
        if j + 1 < len(v) and (i == 0 or row[i - 1] > j + 1):
            heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
        if i + 1 < len(u) and row[i + 1] == j:
            heapq.heappush(heap, (u[i + 1] + v[j], i + 1, j))
    return p, q


def unit(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(df: DataFrame) -> DataFrame:
    """Distinct vectors (label, vector, first, copies) that can link: label and components known and finite, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = df.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))
    return good.groupBy("label", "vector").agg(F.min("vec").alias("first"), F.count("*").alias("copies"))


def block_links(query: np.ndarray, index: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(query @ index.T >= cosine)


def near_vectors(df: DataFrame, cosine: float = COSINE, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links within a label at ``cosine`` or more, in double precision.

    A row whose label, vector or a component is null, whose vector is zero or not finite, has no link and is kept.
    Vectors of different length never link. Equal vectors of a label are searched once and count each other. A row with
    a null key has a null component, counts for nobody and is kept.

    Each vector lies in one cell of the product grid; queries go to the cells of their traversal. A label's grid is as
    fine as its number of vectors asks for: 4, 16, 64, ... cells, a pair of codebooks each, which all labels of about that
    size share. A crowded cell is
    split over blocks of BLOCK_ROWS, queries of a block too, so no task holds more, however hot a vector is. A pair that
    either side's traversal meets counts for both.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "embeddings")
    rows = df.select(F.col(key).cast("long").alias("vec"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    found = scratch.keep(usable(rows).withColumn("size", F.size("vector")), "usable")
    counts = found.groupBy("label", "size").agg(F.count("*").alias("n"))
    counts = counts.select("label", "size", F.greatest(F.lit(0), F.round(F.log(4.0, F.col("n") / CELL_ROWS))).cast("int").alias("fine"))
    distinct = scratch.keep(found.join(counts, ["label", "size"]), "distinct")
    indexes = {}
    for size, levels in distinct.groupBy("size").agg(F.sort_array(F.collect_set("fine"))).collect():
        sample = distinct.filter(F.col("size") == size).orderBy(F.xxhash64("first")).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        indexes[size] = {fine: Index(unit(sample), 4**fine, cosine, recall) for fine in levels}
    shared = spark.sparkContext.broadcast(indexes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, fine = np.asarray(batch.column("size")).astype(np.int64), np.asarray(batch.column("fine"))
            for s, k in np.unique(np.stack([size, fine]), axis=1).T.tolist():
                part, index = batch.take(pa.array(np.flatnonzero((size == s) & (fine == k)))), shared.value[s][k]
                x = unit(part.column("vector"))
                cells = pa.array([c.astype(np.int32) for c in index.visits(x)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("first"), part.column("label"), part.column("size"), part.column("copies"), part.column("vector"), pa.array(index.cell(x).astype(np.int32)), cells], ["first", "label", "size", "copies", "vector", "cell", "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    shape = f"first long, label {kinds['label']}, size int, copies long, vector {kinds['vector']}"
    placed = scratch.keep(distinct.mapInArrow(assign, f"{shape}, cell int, cells array<int>"), "placed")
    place = ["label", "size", "cell"]
    asked = placed.select("first", "label", "size", F.col("cell").alias("own"), F.explode("cells").alias("cell"))
    loads = placed.groupBy(*place).agg(F.count("*").alias("rows")).join(asked.groupBy(*place).agg(F.count("*").alias("queries")), place, "inner")
    loads = scratch.keep(loads.select(*place, *(F.ceil(F.col(x) / BLOCK_ROWS).cast("int").alias(y) for x, y in (("rows", "row_blocks"), ("queries", "query_blocks")))), "loads")

    def blocks(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    def part(name: str):
        return F.pmod(F.xxhash64("first"), F.col(name)).cast("int")

    stored = placed.select("first", "label", "size", "cell", "copies", "vector", "cells").join(loads, place)
    stored = stored.select(*place, part("row_blocks").alias("i"), blocks("query_blocks").alias("j"), "first", "copies", "vector", F.col("cells").alias("visited"))
    queries = placed.select("first", "label", "size", F.col("cell").alias("own"), "copies", "vector", F.explode("cells").alias("cell")).join(loads, place)
    queries = queries.select(*place, blocks("row_blocks").alias("i"), part("query_blocks").alias("j"), "first", "copies", "vector", "own")
    group = [*place, "i", "j"]
    stored = scratch.keep(stored, "stored")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            left, right = left.combine_chunks(), right.combine_chunks()
            q, s = block_links(unit(left["vector"].combine_chunks()), unit(right["vector"].combine_chunks()), cosine)
            a, b = np.asarray(left["first"]), np.asarray(right["first"])
            apart = a[q] != b[s]
            q, s = q[apart], s[apart]
            own, visited = np.asarray(left["own"]), right["visited"].combine_chunks()
            sizes = np.asarray(visited.value_lengths())
            met = np.repeat(np.arange(len(b)), sizes).astype(np.int64) << 32 | np.asarray(visited.flatten())
            back = np.isin(s.astype(np.int64) << 32 | own[q], met)
            weight_q, weight_s = np.asarray(left["copies"]), np.asarray(right["copies"])
            n_q = np.bincount(q, weight_s[s], len(a)).astype(np.int64)
            n_s = np.bincount(s[~back], weight_q[q[~back]], len(b)).astype(np.int64)
            found = [(int(x), int(c), -1) for x, c in zip(np.concatenate([a, b]), np.concatenate([n_q, n_s]), strict=True) if c]
            found += [(x, 0, y) for x, y in spanning(a[q], b[s])]
        x, c, y = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"first": pa.array(x, pa.int64()), "links": pa.array(c, pa.int64()), "other": pa.array(y, pa.int64())})

    found = scratch.keep(queries.groupBy(*group).cogroup(stored.groupBy(*group)).applyInArrow(compare, "first long, links long, other long"), "found")
    counts = found.filter("links > 0").groupBy("first").agg(F.sum("links").alias("links"))
    labels = components(found.filter("links = 0").select(F.col("first").alias("a"), F.col("other").alias("b")), scratch)
    classes = scratch.keep(distinct.join(counts, "first", "left").join(labels.withColumnRenamed("node", "first"), "first", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")), "classes")
    joined = rows.join(classes, ["label", "vector"], "left")
    alone = F.col("vec").isNull()
    out = joined.select(F.col("vec").alias(key), F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(~alone, F.coalesce("component_id", "vec")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
