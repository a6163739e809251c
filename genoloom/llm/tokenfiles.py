"""Files of token ids: independent zstandard frames, an index of documents, and a trailing seek table with checksums.

A file is, one after another: data frames of ``frame_ids`` ids each (little-endian unsigned 32-bit; the last is shorter),
a skippable frame with the index of documents (zstandard of an Arrow stream of key and number of ids), and a skippable
frame with the seek table in the public seekable layout: for each frame before it the compressed size, the size when
decompressed and the low 32 bits of its XXH64; then the number of frames, a descriptor byte and the closing mark. So any
zstandard reader gets the plain ids, and a reader of some documents decompresses only the frames they lie in.
"""

from __future__ import annotations

import gc
import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from genoloom.llm.bpe import Numbered, Runs, slices
from genoloom.llm.scratch import Scratch
from genoloom.sources.files import qualified

END_ID, FRAME_IDS, SHARD_IDS, PART_BYTES = 2, 1 << 17, 1 << 22, 64 << 20
#: Fixed values of the seekable layout: marks of skippable frames (the index, the seek table) and the closing mark.
INDEX_MARK, TABLE_MARK, CLOSING_MARK = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
ENTRY, CLOSING, SKIPPABLE = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
MANIFEST = "file string, part int, nth int, documents long, ids long, bytes long"
#: Words that a worker remembers before it starts anew.
MOST_KNOWN = 500_000
#: White space of ASCII; a text with other white space goes to the library whole, as does one with any of it before a blank.
WHITE = " \t\n\v\f\r"
SPACED = [f"{x} " for x in WHITE]


class ByteEncoder:
    """Ids of whole texts by a tokenizers file of the byte-level BPE kind.

    A text is cut before each blank, as the file's rule never splits elsewhere than a whole text would be while no white
    space meets a blank. Each different word is split by the file's rule once, each different pre-token goes to the
    library's model once, and both are remembered up to ``most`` words. Texts with white space before a blank, special
    tokens, or a character that the rule's two implementations could see differently go to the library whole.
    """

    def __init__(self, path: str, most: int = MOST_KNOWN):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.split, self.most = regex.compile(PATTERN), most
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The letter of each byte; those of 192 and above are the characters of their numbers.
        self.letter = [letters.pre_tokenize_str(chr(i) if i < 128 else bytes([0xC0 | i >> 6, 0x80 | i & 63]).decode())[0][0][-1] for i in range(192)] + [chr(i) for i in range(192, 256)]
        self.seen: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.words, self.parts, self.pieces, self.ids = Numbered(), Runs(), Numbered(), Runs()

    def plain(self, character: str) -> bool:
        """Whether both implementations put the character into the same class: they cut it alike beside a letter, a number, a sign and a blank."""
        if character not in self.seen:
            probes = [f"{a}{character}{b}" for a in "a1! \n" for b in "a1! \n"]
            own = [[len(x) for x in self.split.findall(p)] for p in probes]
            theirs = [[b - a for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(p)] for p in probes]
            self.seen[character] = own == theirs and character.isalpha() == (own[0] == [3]) and (not character.isspace() or character in WHITE)
        return self.seen[character]

    def direct(self, text: str) -> bool:
        """Whether the text may be cut before each blank."""
        return not any(x in text for x in SPACED) and not any(x in text for x in self.special) and all(map(self.plain, set(text)))

    def learn(self) -> None:
        found = [[x] if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) else self.split.findall(x) for x in self.words.fresh]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.parts.add(self.pieces.numbers(chain.from_iterable(found), int(sizes.sum())), sizes)
        tokenize = self.library.model.tokenize
        ids = [[x.id for x in tokenize(self.spelt(piece))] for piece in self.pieces.fresh]
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))
        self.words.fresh, self.pieces.fresh = [], []

    def spelt(self, piece: str) -> str:
        """The letters of a pre-token's bytes. ASCII letters and digits stand for themselves."""
        if piece[1:].isascii() and piece[1:].isalnum():
            return self.letter[ord(piece[0])] + piece[1:] if piece[0].isascii() else "".join([self.letter[b] for b in piece.encode()])
        return "".join([self.letter[b] for b in piece.encode()])

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: empty)."""
        if len(self.words) > self.most:
            self.forget()
        gc.disable()  # many small lists come up, none in a cycle
        try:
            return self.encoded(texts)
        finally:
            gc.enable()

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [x or "" for x in texts]
        direct = [self.direct(x) for x in texts]
        words = [x.replace(" ", "\0 ").split("\0") if ok and "\0" not in x else None for x, ok in zip(texts, direct, strict=True)]
        whole = iter(self.library.encode_batch_fast([x for x, w in zip(texts, words, strict=True) if w is None], add_special_tokens=False))
        own = [w for w in words if w is not None]
        count = np.fromiter(map(len, own), np.int64, len(own))
        number = self.words.numbers(chain.from_iterable(own), int(count.sum()))
        if self.words.fresh:
            self.learn()
        parts, n_parts = self.parts.of(number)
        ids, n_ids = self.ids.of(parts)
        ends = np.concatenate([[0], np.cumsum(n_ids)])[np.concatenate([[0], np.cumsum(n_parts)])][np.cumsum(count)].tolist() if own else []
        runs = iter(np.split(ids.astype("<u4"), ends[:-1]) if ends else ())
        return [next(runs) if w is not None else np.array(next(whole).ids, "<u4") for w in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteEncoder(path)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address and its path there."""
    return pafs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (pafs.LocalFileSystem(), os.path.abspath(folder))


class Writer:
    """Writes one file. Frames go out as they fill up; only the index of the documents is held until the end."""

    def __init__(self, out, kind: pa.DataType, frame_ids: int = FRAME_IDS):
        self.out, self.kind, self.frame_ids = out, kind, frame_ids
        self.pack = zstandard.ZstdCompressor(level=1)
        self.keys, self.sizes, self.table, self.held, self.n_held, self.ids, self.bytes = [], [], [], [], 0, 0, 0

    def put(self, block: bytes, size: int, checksum: int) -> None:
        self.out.write(block)
        self.bytes += len(block)
        self.table.append((len(block), size, checksum))

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= self.frame_ids:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.frame_ids
            for i in range(0, cut, self.frame_ids):
                self.frame(whole[i : i + self.frame_ids])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        self.put(self.pack.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)

    def close(self) -> None:
        if self.n_held:
            self.frame(np.concatenate(self.held))
        stream = io.BytesIO()
        index = pa.table({"key": pa.array(self.keys, self.kind), "ids": pa.array(self.sizes, pa.int64())})
        with pa.ipc.new_stream(stream, index.schema) as w:
            w.write_table(index)
        body = self.pack.compress(stream.getvalue())
        self.put(SKIPPABLE.pack(INDEX_MARK, len(body)) + body, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        body = b"".join(ENTRY.pack(*x) for x in self.table) + CLOSING.pack(len(self.table), HAS_CHECKSUMS, CLOSING_MARK)
        self.out.write(SKIPPABLE.pack(TABLE_MARK, len(body)) + body)
        self.bytes += SKIPPABLE.size + len(body)
        self.out.close()


class Reader:
    """Reads one file by its seek table. ``opened`` counts the frames that were decompressed."""

    def __init__(self, file):
        self.file, self.opened, size = file, 0, file.size()
        frames, descriptor, mark = CLOSING.unpack(self.at(size - CLOSING.size, CLOSING.size))
        if mark != CLOSING_MARK or not descriptor & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        body = frames * ENTRY.size + CLOSING.size
        head, table = self.at(size - body - SKIPPABLE.size, SKIPPABLE.size), self.at(size - body, frames * ENTRY.size)
        if SKIPPABLE.unpack(head) != (TABLE_MARK, body):
            raise ValueError("the seek table is not as long as it says")
        self.table = list(ENTRY.iter_unpack(table))
        self.place = np.concatenate([[0], np.cumsum([x[0] for x in self.table])]).tolist()
        *self.data, (length, _, _) = self.table
        raw = self.at(self.place[-2], length)
        if SKIPPABLE.unpack_from(raw) != (INDEX_MARK, length - SKIPPABLE.size):
            raise ValueError("no index of documents before the seek table")
        index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw[SKIPPABLE.size :])).read_all()
        self.keys, self.sizes = index["key"].combine_chunks(), index["ids"].to_numpy()
        self.start = np.cumsum(self.sizes) - self.sizes
        self.frame_ids = self.data[0][1] // 4 if self.data else 1
        self.held: tuple[int, np.ndarray] | None = None

    def at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def frame(self, i: int) -> np.ndarray:
        """Ids of a frame, checked against its checksum; the last one asked for is held."""
        if not self.held or self.held[0] != i:
            length, size, checksum = self.data[i]
            raw = zstandard.ZstdDecompressor().decompress(self.at(self.place[i], length), max_output_size=size)
            self.opened += 1
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {i} is not what its checksum says")
            self.held = i, np.frombuffer(raw, "<u4")
        return self.held[1]

    def parts(self, document: int) -> Iterator[np.ndarray]:
        """The ids of a document, by the frames it lies in."""
        a, b = int(self.start[document]), int(self.start[document] + self.sizes[document])
        while a < b:
            i, inside = divmod(a, self.frame_ids)
            part = self.frame(i)[inside : inside + b - a]
            yield part
            a += len(part)

    def ids(self, document: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.parts(document)])

    def checksum(self, document: int) -> int:
        crc = 0
        for part in self.parts(document):
            crc = zlib.crc32(part.tobytes(), crc)
        return crc


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS, shard_ids: int = SHARD_IDS, part_bytes: int = PART_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes ``docs`` by the tokenizers file ``path`` and writes them in ascending order of key; one row of MANIFEST a file.

    Files follow one another by ``part`` and ``nth``. Rows are put into ranges of (key, hash of text, place), so equal
    keys, or equal rows, spread over parts too, and a part begins a new file every ``shard_ids`` ids: a task holds a
    frame and the index of a file, however large the part. A file is written under a name of its own and moved when it is
    whole, so a task that runs again leaves the same file. Null keys come first; among equal keys the hash of the text
    decides. Null text is empty and has the end id alone. Other columns are not read. No rows, no files. The manifest is
    evaluated each time it is read: write it before use.
    """
    folder = qualified(docs.sparkSession, folder)
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = [F.asc_nulls_first("k"), F.col("h"), F.col("place")]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, system, writer, done = TaskContext.get().partitionId(), file_system(folder), None, []

        def finish() -> None:
            writer.close()
            system[0].move(temporary, f"{system[1]}/{name}")
            done.append((name, part, len(done), len(writer.keys), writer.ids, writer.bytes))

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for k, ids in zip(keys.slice(a, b - a).to_pylist(), encoder(path).rows(texts[a:b]), strict=True):
                    if writer is None:
                        name = f"{part:08d}-{len(done):06d}.ids.zst"
                        temporary = f"{system[1]}/_{name}.{uuid.uuid4().hex}"
                        system[0].create_dir(system[1], recursive=True)
                        writer = Writer(system[0].open_output_stream(temporary, compression=None), keys.type, frame_ids)
                    writer.add(k, np.append(ids, np.uint32(end_id)).astype("<u4"))
                    if writer.ids >= shard_ids:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        names = MANIFEST.replace(",", "").split()
        columns = list(zip(*done, strict=True)) or [()] * 6
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, names[1::2], strict=True)], names[::2])

    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "t")
    assert kind == sorted_rows.schema["k"].dataType.simpleString()
    return sorted_rows.mapInArrow(run, MANIFEST)


def read(manifest: DataFrame, folder: str, kind: str = "long", with_ids: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, and with ``with_ids`` the ids) of each document of the files in ``manifest``.

    ``start`` counts the ids of all documents before it: those of earlier files come from one window over the manifest
    (a row a file), the others from the file's index. Frames are decompressed one at a time and checked.
    """
    folder = qualified(manifest.sparkSession, folder)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("before")).repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    rows_at_once = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f)
                    for a in range(0, len(reader.keys), rows_at_once):
                        b = min(len(reader.keys), a + rows_at_once)
                        columns = [reader.keys.slice(a, b - a), pa.array(reader.start[a:b] + first), pa.array(reader.sizes[a:b]), pa.array([reader.checksum(i) for i in range(a, b)], pa.int64())]
                        ids = [pa.array([reader.ids(i).astype(np.int64) for i in range(a, b)], pa.list_(pa.int64()))] if with_ids else []
                        yield pa.RecordBatch.from_arrays([*columns, *ids], [key, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return files.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_documents(files: DataFrame, wanted: DataFrame, folder: str, kind: str = "long", key: str = "doc_id") -> DataFrame:
    """(key, ids) of the ``wanted`` keys only: each file's index is read, and of its frames those they lie in.

    ``wanted`` (key) goes to each file whose keys reach around it; ``files`` is the manifest. Keys that are null or not
    there have no row, keys of several documents one each.
    """
    folder = qualified(files.sparkSession, folder)
    spans = bounds(files, folder, kind)
    asked = wanted.select(F.col(key).alias("k")).filter("k IS NOT NULL").distinct().join(spans, F.col("k").between(F.col("low"), F.col("high"))).groupBy("file").agg(F.collect_list("k").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    reader, chosen = Reader(f), set(keys)
                    for i, k in enumerate(reader.keys.to_pylist()):
                        if k in chosen:
                            yield pa.RecordBatch.from_arrays([reader.keys.slice(i, 1), pa.array([reader.ids(i).astype(np.int64)], pa.list_(pa.int64()))], [key, "ids"])

    return asked.select("file", "keys").mapInArrow(run, f"`{key}` {kind}, ids array<long>")


def bounds(manifest: DataFrame, folder: str, kind: str) -> DataFrame:
    """(file, low, high): the least and largest key of each file, from its index alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as f:
                    keys = Reader(f).keys.drop_null()
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), keys.slice(0, 1), keys.slice(len(keys) - 1, 1)], ["file", "low", "high"])

    return manifest.select("file").mapInArrow(run, f"file string, low {kind}, high {kind}")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents into the shared folder and reads them back: (key, start, n_tokens, ids_crc32)."""
    scratch = Scratch(docs.sparkSession, "token-files")
    manifest = scratch.keep(write(docs, scratch.path("files"), path, end_id, key=key, text=text), "manifest")
    return read(manifest, scratch.path("files"), docs.schema[key].dataType.simpleString(), key=key)
