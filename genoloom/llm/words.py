"""Word splitting and hashing of Arrow text columns. A word is a run of bytes other than 0x20 and 0x09-0x0D."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 18
#: Different words that a worker remembers before it starts anew.
MOST_WORDS = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


@dataclass
class Chunk:
    """Some rows of a batch: their bytes one after another, and where each row's bytes begin (one more entry than rows)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts (null: empty) in chunks of about ``most`` bytes; a longer text is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Lexicon(dict):
    """Numbers words in the order of their coming, and has 128 bits of BLAKE2 of each."""

    def __init__(self):
        super().__init__()
        self.bits = array("Q")

    def __missing__(self, word: bytes) -> int:
        self.bits.frombytes(blake2b(word, digest_size=16).digest())
        self[word] = number = len(self)
        return number

    def numbers(self, rows: list[list[bytes]], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(rows)), np.int64, n)


#: The worker's own, from chunk to chunk.
LEXICON = Lexicon()


@dataclass
class Words:
    """Words of some texts in order: ``row`` numbers the text, ``count`` and ``first`` say how many a text has and from where.

    Equal words have equal ``number``, within one chunk; ``hash`` and ``other`` are independent and the same everywhere.
    """

    rows: list[list[bytes]]
    row: np.ndarray
    count: np.ndarray
    first: np.ndarray
    number: np.ndarray
    hash: np.ndarray
    other: np.ndarray


def split(chunk: Chunk, lower: bool = False) -> Words:
    global LEXICON
    if len(LEXICON) > MOST_WORDS:
        LEXICON = Lexicon()
    data = chunk.data.tobytes()
    if lower:
        data = data.lower()
    rows = [data[a:b].split() for a, b in pairwise(chunk.offsets.tolist())]
    count = np.fromiter(map(len, rows), np.int64, len(rows))
    number = LEXICON.numbers(rows, int(count.sum()))
    hashes = np.frombuffer(LEXICON.bits, U).reshape(-1, 2)[number] if len(number) else np.zeros((0, 2), U)
    return Words(rows, np.repeat(np.arange(len(rows)), count), count, np.cumsum(count) - count, number, np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1]))


def windows(values: np.ndarray, size: int, seed: int = BASE) -> np.ndarray:
    """A hash of each ``size`` consecutive values; the caller drops those that cross rows.

    Spans of 1, 2, 4, ... values are hashed from their halves, and a window from the spans that make it up. No step is
    linear in the values, so patterns that cancel out in a polynomial do not here.
    """
    n = len(values) - size + 1
    if n < 1:
        return np.zeros(0, U)
    span, part, at, total = 1, values, 0, np.full(n, seed, U)
    while True:
        if size & span:
            total = mix(total * U(BASE) + part[at : at + n])
            at += span
        if 2 * span > size:
            return total
        part = mix(part[:-span] * U(BASE) + mix(part[span:] + U(span)))
        span *= 2


def without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """``docs`` without columns of these names, in whatever case they are written."""
    taken = {x.lower() for x in names}
    return docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in taken))
