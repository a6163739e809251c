"""Byte-pair encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from genoloom.llm.words import without

#: Words that a worker remembers before it starts anew.
MOST_KNOWN = 300_000
#: Marks a whole word among pre-tokens.
WHOLE = "\0"


class Vocabulary:
    """A tokenizers file of the word-end BPE kind: normal form C, white space to blanks, lower case, a split pattern, bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        #: The split pattern on lower-case ASCII, besides whole words and line ends.
        self.split = re.compile(f"{WHOLE}[^\n]*|" + pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9") + "|\n")
        self.size = 1 + max(self.strings)
        self.rules = Tokenizer.from_file(path)
        #: pair -> (rank, merged id)
        self.merges = {self.ids[a] * self.size + self.ids[b]: (r, self.ids[a + b]) for r, (a, b) in enumerate(map(tuple, model["merges"]))}

    def pre_tokens(self, word: str) -> list[str | int]:
        """A word's normalised pre-tokens, as the letters of their bytes, and ids of special tokens in it."""
        if "<|" not in word:
            return self.plain(word)
        parts = filter(None, self.split_special.split(word))
        return [x for part in parts for x in ([self.special[part]] if part in self.special else self.plain(part))]

    def plain(self, part: str) -> list[str]:
        return [x for x, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part))]

    def spelt(self, piece: str) -> list[int]:
        """Ids of a pre-token's letters, the last with the suffix."""
        return [*(self.ids[c] for c in piece[:-1]), self.ids[piece[-1] + self.suffix]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(voc: Vocabulary, pieces: list[str]) -> list[list[int]]:
    """Ids of each pre-token.

    All pre-tokens lie in one array of symbols with links to the neighbours. The index maps each mergeable pair to the
    places of its left symbols; ranks that have places are active and are applied in ascending order, each to all its
    places from left to right. A merge appends the places of the two pairs it forms and leaves those it breaks to be
    recognised by their changed symbols. A merge forms pairs of later ranks only, so a rank is applied once.
    """
    symbols: list[int] = []
    after: list[int] = []
    before: list[int] = []
    first: list[int] = []
    places: dict[int, list[int]] = {}
    size, merges = voc.size, voc.merges
    for piece in pieces:
        at = len(symbols)
        first.append(at)
        symbols += voc.spelt(piece)
        end = len(symbols)
        before += [-1, *range(at, end - 1)]
        after += [*range(at + 1, end), -1]
        for i in range(at, end - 1):
            pair = symbols[i] * size + symbols[i + 1]
            if pair in merges:
                places.setdefault(pair, []).append(i)
    active = [(merges[pair][0], pair) for pair in places]
    heapq.heapify(active)
    while active:
        _, pair = heapq.heappop(active)
        left, right = divmod(pair, size)
        merged = merges[pair][1]
        for i in sorted(places.pop(pair)):
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            k, h = after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
            for at, new in ((h, symbols[h] * size + merged if h >= 0 else -1), (i, merged * size + symbols[k] if k >= 0 else -1)):
                if new in merges:
                    if new not in places:
                        places[new] = []
                        heapq.heappush(active, (merges[new][0], new))
                    places[new].append(at)
    out = []
    for i in first:
        own = []
        while i >= 0:
            own.append(symbols[i])
            i = after[i]
        out.append(own)
    return out


class Numbered(dict):
    """Numbers keys as they come; ``fresh`` are those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number

    def numbers(self, keys: Iterable, n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, n)


class Runs:
    """Arrays of numbers one after another."""

    def __init__(self):
        self.start, self.values = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.start.append(self.start[-1][-1] + np.cumsum(sizes))
        self.values.append(values)

    def of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the given runs one after another, and their numbers."""
        for name in ("start", "values"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        start = self.start[0]
        size = start[runs + 1] - start[runs]
        at = np.arange(int(size.sum())) + np.repeat(start[runs] - (np.cumsum(size) - size), size)
        return self.values[0][at], size


class Encoder:
    """Ids of whole texts. ASCII white space ends words, and no pre-token reaches over it.

    Each different word, and each different pre-token, is worked out once and remembered from slice to slice; with over
    ``most`` words, or twice as many pre-tokens, remembered, the next slice starts anew, so memory is bounded. ``merge``
    gives the ids of each of some pre-tokens of printable ASCII or, marked by WHOLE, of words with other characters or special tokens.
    """

    def __init__(self, voc: Vocabulary, merge: Callable[[list[str]], Iterable[list[int]]], most: int = MOST_KNOWN):
        self.voc, self.merge, self.most = voc, merge, most
        self.forget()

    def forget(self) -> None:
        self.words, self.parts, self.pieces, self.ids = Numbered(), Runs(), Numbered(), Runs()

    def forget_words(self) -> None:
        """Pre-tokens stay for as long as they are within the bound."""
        if len(self.pieces) > 2 * self.most:
            self.forget()
        self.words, self.parts = Numbered(), Runs()

    def learn(self) -> None:
        """Works out the words that are new, together."""
        text = b"\n".join(self.words.fresh).decode()
        words = (w.lower() if w.isascii() and w.isprintable() and "<|" not in w else WHOLE + w for w in text.split("\n"))
        found = self.voc.split.findall("\n".join(words) + "\n")
        number = self.pieces.numbers(found, len(found))
        end = number == self.pieces["\n"]
        self.parts.add(number[~end], np.diff(np.flatnonzero(end), prepend=-1) - 1)
        ids = list(self.merge([x for x in self.pieces.fresh if x != "\n"]))
        sizes = np.fromiter((0 if x == "\n" else -1 for x in self.pieces.fresh), np.int64, len(self.pieces.fresh))
        sizes[sizes < 0] = list(map(len, ids))
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.int64), sizes)
        self.words.fresh, self.pieces.fresh = [], []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (null: empty) one after another, and their numbers."""
        if len(self.words) > self.most:
            self.forget_words()
        rows = [(x or "").encode().split() for x in texts]
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        gc.disable()  # many small lists come up, none in a cycle
        try:
            number = self.words.numbers(chain.from_iterable(rows), int(count.sum()))
            if self.words.fresh:
                self.learn()
        finally:
            gc.enable()
        parts, n_parts = self.parts.of(number)
        ids, n_ids = self.ids.of(parts)
        total = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(n_parts)])][np.concatenate([[0], np.cumsum(count)])]
        return ids.astype("<u4"), np.diff(total)

    def rows(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        ids, count = self.encode(texts)
        yield from np.split(ids, np.cumsum(count)[:-1]) if len(count) else ()


def merged(voc: Vocabulary, pieces: list[str]) -> Iterator[list[int]]:
    """Ids of each piece, merged by the pair occurrence index, all different pre-tokens together."""
    rows = [voc.pre_tokens(x[1:]) if x[0] == WHOLE else [x] for x in pieces]
    different = list({p for row in rows for p in row if isinstance(p, str)})
    ids = dict(zip(different, merge_all(voc, different), strict=True))
    for row in rows:
        yield ids[row[0]] if len(row) == 1 and isinstance(row[0], str) else [i for p in row for i in ((p,) if isinstance(p, int) else ids[p])]


class Texts:
    """The decimal ids and the decoded form of each id, to be joined."""

    def __init__(self, voc: Vocabulary):
        self.decimal = np.array(list(map(str, range(voc.size))), object)
        self.string = np.array([voc.strings.get(i, "") for i in range(voc.size)], object)

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        return len(ids), sha(" ".join(self.decimal[ids].tolist())), sha(" ".join(self.string[ids].tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.string[ids].tolist())


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Encoder, Texts]:
    """The worker's encoder, which merges by the pair occurrence index."""
    voc = vocabulary(path)
    return Encoder(voc, lambda pieces: merged(voc, pieces)), Texts(voc)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slices(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about ``most`` characters; a longer text is a run of its own."""
    a = size = 0
    for i, text in enumerate(texts):
        if i > a and size + len(text or "") > most:
            yield a, i
            a, size = i, 0
        size += len(text or "")
    if a < len(texts):
        yield a, len(texts)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, special tokens in a text being such. Null text is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own, forms = encoder(path)
            got = [forms.digests(ids) for a, b in slices(texts) for ids in own.rows(texts[a:b])]
            n, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the ids of each text as an array column ``ids`` and the text they decode to as ``decoded``.

    Columns of these names are replaced. Null text has no ids.
    """
    docs = without(docs, ["ids", "decoded"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            own, forms = encoder(path)
            ids = [x for a, b in slices(texts) for x in own.rows(texts[a:b])]
            columns = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(map(forms.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)
