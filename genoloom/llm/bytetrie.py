"""Variable-order byte contexts: counting them with Spark, and walking a frozen context trie over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.worker import task

U = np.uint64
MOST_HELD = 1 << 20


class Symbols:
    """Byte symbols of some texts one after another, each text led by ``order`` pads; ``at`` are the places of real symbols."""

    def __init__(self, values: np.ndarray, count: np.ndarray, order: int, pad: int):
        self.count, self.order = count, order
        row = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(len(values)) + order * (row + 1)
        self.padded = np.full(len(values) + order * len(count), pad, np.uint8)
        self.padded[self.at] = values

    def codes(self) -> np.ndarray:
        """Each symbol with the ``order`` before it: the symbol in the lowest byte, older ones above."""
        code = np.zeros(len(self.at), U)
        for j in range(self.order + 1):
            code |= self.padded[self.at - j].astype(U) << U(8 * j)
        return code


def count_codes(rows: DataFrame, prepare: Callable[[pa.Array, int], Iterator[tuple[int, Symbols]]], order: int, label: str, text: str) -> DataFrame:
    """(label, code, n) over all ``rows``; each task sums what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            name, code, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            by = np.lexsort((code, name))
            name, code, n = name[by], code[by], n[by]
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (name[1:] != name[:-1])]))
            return name[new], code[new], np.add.reduceat(n, new)

        for batch in batches:
            own = np.array([names.setdefault(x, len(names)) for x in batch.column(label).to_pylist()], np.int64)
            for first, symbols in prepare(batch.column(text), order):
                of = np.repeat(own[first : first + len(symbols.count)], symbols.count)
                codes = symbols.codes()
                for k in np.unique(of):
                    code, n = np.unique(codes[of == k], return_counts=True)
                    held.append((np.full(len(code), k), code, n))
                if sum(len(x[0]) for x in held) > MOST_HELD:
                    held[:] = [merged()]
        if held:
            name, code, n = merged()
            values = pa.array(list(names), pa.string())
            for a in range(0, len(code), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([values.take(pa.array(name[b])), pa.array(code[b].view(np.int64)), pa.array(n[b])], ["label", "code", "n"])

    parts = rows.select(F.col(label).cast("string").alias(label), text).mapInArrow(task("counts", run), "label string, code long, n long")
    return parts.groupBy("label", "code").agg(F.sum("n").alias("n"))


def frequent_contexts(grams: DataFrame, order: int, share: float) -> DataFrame:
    """(label, depth, code, n): next-symbol counts of every context that makes up ``share`` of its label's symbols or more.

    A label has at most 1 / share such contexts of each depth, whatever the corpus, so the result is bounded and fit to
    be collected and broadcast. Suffixes of a kept context are kept.
    """
    depths = F.array([F.struct(F.lit(k).alias("depth"), F.col("code").bitwiseAND(F.lit((1 << (8 * k + 8)) - 1)).alias("code")) for k in range(order + 1)])
    counts = grams.select("label", F.explode(depths).alias("x"), "n").groupBy("label", "x.depth", "x.code").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("label", "depth", F.shiftrightunsigned("code", 8).alias("context")).agg(F.sum("n").alias("total"))
    whole = totals.filter("depth = 0").select(F.col("label").alias("l"), F.col("total").alias("whole"))
    kept = totals.join(whole, F.col("l") == F.col("label")).filter(F.col("total") >= share * F.col("whole")).select("label", "depth", "context")
    return counts.withColumn("context", F.shiftrightunsigned("code", 8)).join(kept, ["label", "depth", "context"], "left_semi").select("label", "depth", "code", "n")


class Trie:
    """Contexts as nodes, the empty one 0; a child adds one older symbol, so a node's parent is its suffix.

    ``child`` also has a resting copy of each node, where a walk stays once the older symbol has no child: the last
    place is the longest stored suffix.
    """

    def __init__(self, depths: list[np.ndarray], seen: np.ndarray):
        """depths[k]: sorted codes of the contexts of k symbols (depths[0] is [0]); seen: byte values that occur."""
        self.depth = len(depths) - 1
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width, self.seen = len(seen) + 1, seen
        self.depths, self.first = depths, np.concatenate([[0], np.cumsum([len(x) for x in depths])])
        self.nodes = int(self.first[-1])
        self.parent = np.zeros(self.nodes, np.int64)
        self.child = np.empty((2 * self.nodes, self.width), np.int32)
        self.child[:] = np.tile(np.arange(self.nodes, 2 * self.nodes, dtype=np.int32), 2)[:, None]
        for k in range(1, self.depth + 1):
            ids = np.arange(self.first[k], self.first[k + 1])
            self.parent[ids] = self.node(k - 1, depths[k] & U((1 << (8 * (k - 1))) - 1))
            oldest = (depths[k] >> U(8 * (k - 1))) & U(255)
            self.child[self.parent[ids], self.symbol[oldest.astype(np.int64)]] = ids

    def node(self, k: int, contexts: np.ndarray) -> np.ndarray:
        return self.first[k] + np.searchsorted(self.depths[k], contexts)

    def states(self, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol the longest stored suffix before it, and its own number."""
        numbers, lead = self.symbol[symbols.padded], self.depth
        child, node = self.child.reshape(-1), np.zeros(max(0, len(numbers) - lead), np.int64)
        for d in range(1, lead + 1):
            node = child[node * self.width + numbers[lead - d : len(numbers) - d]].astype(np.int64)
        return node[symbols.at - lead] % self.nodes, numbers[symbols.at]


def sum_by_row(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, empty ones 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    end = np.cumsum(count)
    return total[end] - total[end - count]
