"""Best-fit-decreasing packing of token sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.bpe import WHOLE, Encoder, vocabulary
from genoloom.llm.scratch import Scratch
from genoloom.llm.worker import hold, task

CAPACITY, END_ID, SHARD_PIECES = 4096, 2, 2000
#: Pre-tokens that go to the library in a line, words that a worker remembers, and bytes of texts that are encoded at once.
LINE, MOST_KNOWN, SLICE_BYTES = 1024, 200_000, 2 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c counts those with c tokens left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def add(self, left: int, window: int) -> None:
        self.at.setdefault(left, []).append(window)
        i = self.leaves + left
        while i:
            self.tree[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of ``need`` or more that has a window, or -1."""
        i = self.leaves + need
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def take(self, left: int) -> int:
        i = self.leaves + left
        while i:
            self.tree[i] -= 1
            i >>= 1
        return self.at[left].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; pieces go in by descending length, each to the tightest window that holds it."""
    windows, offset, used, tree = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left = tree.tightest(lengths[i])
        window = used if left < 0 else tree.take(left)
        used, left = (used + 1, capacity) if left < 0 else (used, left)
        windows[i], offset[i] = window, capacity - left
        if left > lengths[i]:
            tree.add(left - lengths[i], window)
    return windows, offset


def forget() -> None:
    library_encoder.cache_clear()
    vocabulary.cache_clear()


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """The worker's encoder, whose pre-tokens, or whole words beyond printable ASCII, the tokenizers library encodes.

    Pre-tokens go to the library a line at a time; each ends with the one id that has the end-of-word suffix.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    hold("packing", forget)
    voc = vocabulary(path)
    library = voc.rules
    library.no_truncation()
    library.no_padding()
    closes = np.zeros(voc.size, bool)
    closes[[i for x, i in voc.ids.items() if x.endswith(voc.suffix)]] = True

    def merge(pieces: list[str]) -> Iterator[list[int]]:
        short = [x for x in pieces if x[0] != WHOLE]
        lines = library.encode_batch_fast([" ".join(short[i : i + LINE]) for i in range(0, len(short), LINE)], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(x.ids for x in lines)), np.int64)
        end = np.flatnonzero(closes[ids]) + 1
        flat, span = ids.tolist(), zip([0, *end[:-1].tolist()], end.tolist(), strict=False)
        whole = iter(library.encode_batch_fast([x[1:] for x in pieces if x[0] == WHOLE], add_special_tokens=False))
        for x in pieces:
            if x[0] == WHOLE:
                yield next(whole).ids
            else:
                a, b = next(span)
                yield flat[a:b]

    return Encoder(voc, merge, MOST_KNOWN)


def spans(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about ``most`` bytes; a longer text is a run of its own. Only a run is unpacked at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's ids and the end id, cut into full windows and a rest; with ``with_ids`` the ids themselves too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            for a, b in spans(texts):
                row, found, own = [], [], []
                for i, ids in enumerate(library_encoder(path).rows(texts.slice(a, b - a).to_pylist()), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        part = ids[s : s + capacity]
                        row.append(i)
                        found.append((s, len(part), zlib.crc32(part.tobytes()), len(ids)))
                        own.append(part)
                columns = [keys.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.list_(pa.int64()))] if with_ids else [])], [key, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(task("packing", run), f"`{key}` {kind}, {PIECES}" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: key, PIECES, sequence_id and offset there (and ids).

    A text over ``capacity`` ids is first cut into full windows. Pieces are dealt by a hash into shards of about
    ``shard_pieces``, and each shard is packed by itself, so that no task sees more; a shard leaves a window or two
    partly empty. Null text has the end id alone; rows with equal or null keys are packed each for itself. The
    sequence_id is the shard's number times 2**32 plus the window's number in the shard.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, path, capacity, end_id, with_ids, key, text), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def run(shard: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["shard"]).sort_by([(key, "ascending"), ("start", "ascending")])
        window, offset = best_fit(table["length"].to_pylist(), capacity)
        return table.append_column("sequence_id", pa.array([(shard[0].as_py() << 32) + x for x in window], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.withColumn("shard", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(shards))).groupBy("shard").applyInArrow(run, f"{schema}, sequence_id long, offset long")
