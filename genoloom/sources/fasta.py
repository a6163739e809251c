"""FASTA in block-gzip files with an index of blocks, read by ranges of bases: no contig is ever one row.

A file is a row of gzip members, each a block of the block-gzip kind (its size stands in an extra field), so any gzip
reader reads the whole text. A block has ``size`` bases of one contig, the last of a contig fewer, as lines of ``width``,
below the contig's name if it is the first. The index is a table of blocks: where each lies in which file.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from genoloom.sources.files import qualified

#: Bases of a block: a multiple of the line width, small enough that a block's text fits the format's 64 KB.
SIZE, WIDTH = 60_000, 80
#: The format's header (gzip, deflate, extra field of 6 bytes named BC with the size less 1) and its end.
HEAD, TAIL = struct.Struct("<4BI2BH2BHH"), struct.Struct("<II")
MAGIC = (31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2)
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
INDEX = "name string, block long, bases long, file string, place long, length long"
#: Blocks that one partition of the data source reads.
BLOCKS_AT_ONCE = 64


def system_of(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (pafs.LocalFileSystem(), os.path.abspath(folder))


def packed(text: bytes) -> bytes:
    """The text as one block."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    size = HEAD.size + len(body) + TAIL.size
    if size > 1 << 16:
        raise ValueError("the text is too long for a block")
    return HEAD.pack(*MAGIC, size - 1) + body + TAIL.pack(zlib.crc32(text), len(text))


def bases_of(block: bytes) -> str:
    """The bases of a block, whose checksum must hold."""
    text = zlib.decompress(block[HEAD.size : -TAIL.size], -15)
    if TAIL.unpack(block[-TAIL.size :]) != (zlib.crc32(text), len(text)):
        raise ValueError("a block is not what its checksum says")
    lines = text.decode().split("\n")
    return "".join(lines[1:] if lines[0].startswith(">") else lines)


def write_blocks(chunks: DataFrame, folder: str, size: int = SIZE, width: int = WIDTH, append: bool = False) -> None:
    """Writes ``chunks`` (name, chunk, seq) as files in ``folder``/blocks and their index in ``folder``/index.

    Chunks are of ``size`` bases, a contig's last of fewer, numbered from 0; ``size`` is a multiple of ``width``. Blocks go
    by ranges of (name, chunk), so a contig spreads over files that follow one another by name, and a task holds one
    block. With ``append`` files, whose names come after those there are, and index rows are added. Null sequences are empty; names are not null.
    """
    if size % width:
        raise ValueError("a block must be of whole lines")
    folder = qualified(chunks.sparkSession, folder)
    run_id, parts = f"{time.time_ns():020d}", int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = system_of(folder)
        out, place, rows, name, temporary = None, 0, [], "", ""
        for batch in batches:
            for contig, number, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(f"{root}/blocks", recursive=True)
                    name = f"{run_id}-{TaskContext.get().partitionId():06d}.fa.gz"
                    temporary = f"{root}/blocks/_{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary, compression=None)
                lines = [f">{contig}"] * (number == 0) + [seq[i : i + width] for i in range(0, len(seq), width)]
                block = packed("".join(f"{x}\n" for x in lines).encode())
                out.write(block)
                rows.append((contig, number, len(seq), name, place, len(block)))
                place += len(block)
        if out is not None:
            out.write(END_BLOCK)
            out.close()
            system.move(temporary, f"{root}/blocks/{name}")
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    rows = chunks.select("name", F.col("chunk").cast("long").alias("chunk"), F.coalesce("seq", F.lit("")).alias("seq"))
    ranged = rows.repartitionByRange(parts, "name", "chunk").sortWithinPartitions("name", "chunk")
    ranged.mapInArrow(run, INDEX).write.mode("append" if append else "errorifexists").parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length) of each contig, from the index alone."""
    return index(spark, folder).groupBy("name").agg(F.sum("bases").alias("length"))


def read_ranges(spark: SparkSession, folder: str, ranges: DataFrame, size: int = SIZE) -> DataFrame:
    """``ranges`` (id, name, s, e), 0-based and without e, with the bases there as ``seq``.

    A range asks for the blocks it lies over, each block that is asked for is read and unpacked once for all ranges, and
    the pieces are put together in order. What lies beyond a contig is missing; an empty range, or one of an unknown
    contig, has an empty seq. Ids are unique.
    """
    folder = qualified(spark, folder)
    clean = ranges.select("id", "name", F.greatest(F.col("s"), F.lit(0)).alias("s"), "e")
    asked = clean.filter("e > s").withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))))
    met = asked.join(index(spark, folder), ["name", "block"])
    begin, stop = F.greatest(F.col("s") - F.col("block") * size, F.lit(0)), F.least(F.col("e") - F.col("block") * size, F.lit(size))
    wanted = met.select("file", "place", "length", "id", "block", begin.alias("begin"), stop.alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = system_of(folder)
        held, bases, file = None, "", None
        for batch in batches:
            ids, blocks, pieces = [], [], []
            for name, place, length, id, block, begin, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != name:
                    file = system.open_input_file(f"{root}/blocks/{name}")
                if held != (name, place):
                    file.seek(place)
                    held, bases = (name, place), bases_of(file.read(length))
                ids.append(id)
                blocks.append(block)
                pieces.append(bases[begin:stop])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(3).type), pa.array(blocks, pa.int64()), pa.array(pieces, pa.string())], ["id", "block", "piece"])

    kind = ranges.schema["id"].dataType.simpleString()
    by_block = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "place").sortWithinPartitions("file", "place")
    pieces = by_block.mapInArrow(run, f"id {kind}, block long, piece string")
    found = pieces.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    return ranges.join(found, "id", "left").select(*ranges.columns, F.coalesce("seq", F.lit("")).alias("seq"))


class Blocks(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FastaSource(DataSource):
    """``spark.read.format("fasta_blocks").option("contig", ...).option("from", ...).option("to", ...).load(folder)``.

    Rows (name, start, seq): a row a block of the contig's part from base ``from`` (0-based) to ``to`` (excluded); without
    ``contig`` all contigs, without bounds whole ones. Only those blocks are read, by their places in the files.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_blocks"

    def schema(self) -> str:
        return "name string, start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("size", SIZE))
        self.contig, self.low, self.high = options.get("contig"), int(options.get("from", 0)), int(options.get("to", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        """Of the index only rows of the blocks asked for come to the driver."""
        system, root = system_of(self.folder)
        keep = (ds.field("block") >= self.low // self.size) & (ds.field("block") <= (self.high - 1) // self.size)
        if self.contig is not None:
            keep = keep & (ds.field("name") == self.contig)
        rows = ds.dataset(f"{root}/index", filesystem=system, format="parquet").to_table(filter=keep).sort_by([("file", "ascending"), ("place", "ascending")])
        found = list(zip(*(rows[x].to_pylist() for x in ("name", "block", "file", "place", "length")), strict=True))
        return [Blocks(found[i : i + BLOCKS_AT_ONCE]) for i in range(0, len(found), BLOCKS_AT_ONCE)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        system, root = system_of(self.folder)
        for name, block, file, place, length in partition.rows:
            with system.open_input_file(f"{root}/blocks/{file}") as f:
                f.seek(place)
                bases = bases_of(f.read(length))
            first = block * self.size
            piece = bases[max(0, self.low - first) : max(0, self.high - first)]
            if piece:
                yield name, max(first, self.low), piece
