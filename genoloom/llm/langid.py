"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.bytetrie import Symbols, Trie, count_codes, frequent_contexts, sum_by_row
from genoloom.llm.worker import task

ORDER, SHARE, MOST_BITS = 4, 1e-5, 6.5
UNKNOWN = "und"
#: Letters keep their (lower-case) bytes, other ASCII characters are one symbol.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 else 32 for x in range(128)]


def prepare(text: pa.Array, order: int) -> Iterator[tuple[int, Symbols]]:
    for chunk in W.chunks(text):
        yield chunk.first, Symbols(FOLD[chunk.data], np.diff(chunk.offsets), order, 32)


class Model:
    """Frozen context trees of all languages in one trie, and the code length of each symbol after each context.

    A context predicts a symbol seen n times of its total t with n / (t + q), q being its number of different symbols,
    and escapes to its suffix with q / (t + q); below the empty context all 256 bytes are equal. So the cost of a
    symbol depends on the longest stored context alone and is laid down once, in bits.
    """

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        self.labels = sorted(counts["label"].unique())
        code, depth = counts["code"].to_numpy(np.int64).view(np.uint64), counts["depth"].to_numpy()
        n, own = counts["n"].to_numpy(np.float64), np.searchsorted(self.labels, counts["label"].to_numpy()) if len(counts) else np.zeros(0, np.int64)
        symbol, context = (code & np.uint64(255)).astype(np.int64), code >> np.uint64(8)
        depths = [np.zeros(1, np.uint64), *(np.unique(context[depth == k]) for k in range(1, order + 1))]
        self.trie = t = Trie(depths, np.unique(symbol[depth == 0]))
        self.cost = np.full((t.nodes, t.width, max(1, len(self.labels))), 8.0, np.float32)
        for k in range(order + 1):
            here = depth == k
            node, ids = t.node(k, context[here]), np.arange(t.first[k], t.first[k + 1])
            if k:
                self.cost[ids] = self.cost[t.parent[ids]]
            total, different = np.zeros((t.nodes, len(self.labels))), np.zeros((t.nodes, len(self.labels)))
            np.add.at(total, (node, own[here]), n[here])
            np.add.at(different, (node, own[here]), 1)
            x, y = np.nonzero(total)
            self.cost[x, :, y] -= np.log2(different[x, y] / (total[x, y] + different[x, y]))[:, None]
            self.cost[node, t.symbol[symbol[here]], own[here]] = -np.log2(n[here] / (total + different)[node, own[here]])

    def bits(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths of whole texts under each language, and their numbers of symbols."""
        bits, size = [np.zeros((0, self.cost.shape[2]))], [np.zeros(0, np.int64)]
        flat = self.cost.reshape(-1, self.cost.shape[2])
        for _, symbols in prepare(text, self.trie.depth):
            node, own = self.trie.states(symbols)
            bits.append(sum_by_row(flat[node * self.trie.width + own], symbols.count))
            size.append(symbols.count)
        return np.concatenate(bits), np.concatenate(size)


def train(labelled: DataFrame, order: int = ORDER, share: float = SHARE, lang: str = "lang", text: str = "text") -> Model:
    """Count all rows with a language; the model has at most ``order / share`` contexts a language."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return Model(frequent_contexts(count_codes(rows, prepare, order, lang, text), order, share).toArrow().to_pandas(), order)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(x) and any(map(str.isalpha, x)) for x in texts], bool)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the probability of that language among the learned ones) and bits_per_byte.

    Null text or text without a letter, or a model that has learned nothing, gives ``und`` with score 0 and null
    bits_per_byte. Of equal code lengths the first language by name is taken. Columns of these names are replaced.
    """
    names = ["lang_pred", "score", "bits_per_byte"]
    docs = W.without(docs, names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, bits_per_byte double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            bits, size = model.bits(batch.column(text))
            known = has_letter(batch.column(text).to_pylist()) & bool(model.labels)
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, np.int64)
            least = bits.min(axis=1, keepdims=True, initial=np.inf)
            odds = np.exp2(np.minimum(0, least - bits)).sum(axis=1)
            named = [model.labels[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
            score = np.where(known, 1 / np.maximum(odds, 1), 0.0)
            rate = pa.array(least[:, 0] / np.maximum(size, 1), mask=~known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(score), rate], [*batch.schema.names, *names])

    return docs.mapInArrow(task("langid", run), schema)


def in_fold(key: str, folds: int, fold: int):
    """Rows whose crc32 of the key as text leaves ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
