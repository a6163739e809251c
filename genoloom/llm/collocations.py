"""Phrase collocations: exact counts of phrases within pieces of text, their loosest cuts, and the phrases in no longer one."""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.bpe import Numbered
from genoloom.llm.scratch import Scratch
from genoloom.llm.words import BASE, mix

LEAST, LONGEST, TOP, UNKNOWN = 100, 5, 2000, "und"
#: Bytes of a block of pieces, distinct pieces that a task counts before it passes them on, memory of a bucket's counts.
BLOCK_BYTES, MOST_PIECES, COUNT_MEMORY = 16 << 20, 200_000, "256MB"
#: Bytes of pieces for each bucket of phrases: their number follows the text alone, as each block sends a message to each.
BUCKET_BYTES = 32 << 20
#: Bytes of pieces whose words are split at once.
SPLIT_BYTES = 1 << 20
#: Lower-cases A-Z and makes every separator a line end.
CLEAN = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What a block sends to a bucket: its phrases there and how often each stands in it.
MESSAGES = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("block", pa.int64()), ("grams", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
MESSAGES_DDL = "bucket long, lang string, block long, grams array<string>, n array<long>"
#: What comes of a bucket: sums (gram, n) of block ALL, and for each block that asked the pairs among its own that are frequent.
ANSWERS_DDL = "lang string, gram string, block long, n long, pairs array<string>"
#: The block of a row that is a count over all blocks.
ALL = -1


def split_pieces(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, piece, n) of the pieces that have a word, partly summed up. Pieces are lower case, without blanks at their ends."""

    def flush(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, counted in held.items():
            counted.pop(b"", None)
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(counted)), pa.array(list(counted), pa.binary()).cast(pa.string()), pa.array(list(counted.values()), pa.int64())], ["lang", "piece", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = (body.as_py() or "").encode().translate(CLEAN)
                held.setdefault(name, Counter()).update([x.strip(b" \t") for x in body.split(b"\n")])
                if sum(map(len, held.values())) > MOST_PIECES:
                    yield from flush(held)
        yield from flush(held)

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("piece")).mapInArrow(run, "lang string, piece string, n long")


def distinct_pieces(docs: DataFrame, block_bytes: int = BLOCK_BYTES, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, piece, n, block): each different piece once, with its multiplicity, dealt into blocks of about ``block_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lengths = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) + size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block + lengths // block_bytes, pa.int64())], ["lang", "piece", "n", "block"])
            size = int(lengths[-1]) if len(lengths) else size

    return split_pieces(docs, lang, text).groupBy("lang", "piece").agg(F.sum("n").alias("n")).mapInArrow(run, "lang string, piece string, n long, block long")


class Block:
    """The words of some pieces of a language as numbers, one after another."""

    def __init__(self, pieces: pa.Array | pa.ChunkedArray, n: np.ndarray):
        names, numbers, sizes = Numbered(), [], []
        lengths = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False)) if len(pieces) else np.zeros(0, np.int64)
        a = 0
        while a < len(pieces):
            b = max(a + 1, int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + SPLIT_BYTES)))
            rows = [x.split() for x in pieces.slice(a, b - a).cast(pa.binary()).to_pylist()]
            sizes.append(np.fromiter(map(len, rows), np.int64, len(rows)))
            numbers.append(names.numbers(chain.from_iterable(rows), int(sizes[-1].sum())))
            a = b
        self.numbers_of = names
        self.names = pa.array(list(names), pa.binary()).cast(pa.string())
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        self.word = np.concatenate([np.zeros(0, np.int64), *numbers])
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.weight = np.repeat(n, size)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(self.word))

    def pairs(self) -> np.ndarray:
        """The pair that begins at each word, -1 at a piece's last."""
        out = np.full(len(self.word), -1, np.int64)
        out[:-1] = np.where(self.left[:-1] > 1, self.word[:-1] * len(self.names) + self.word[1:], -1)
        return out

    def summed(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each different code a place where it stands and its weight over all places, and the number of each place's code."""
        _, first, number = np.unique(codes, return_index=True, return_inverse=True)
        return at[first], np.bincount(number, self.weight[at]).astype(np.int64), number

    def spelt(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words that begin at the places."""
        return pc.binary_join_element_wise(*(self.names.take(pa.array(self.word[at + i])) for i in range(size)), " ")


def messages(lang: str, block: int, own: Block, first: np.ndarray, n: np.ndarray, size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The phrases of ``size`` words that begin at ``first``, one message a bucket: dealt by a hash of their words."""
    hashes = np.full(len(first), xxhash.xxh64_intdigest(lang), np.uint64)
    for i in range(size):
        hashes = mix(hashes * np.uint64(BASE) + own.hashes[own.word[first + i]])
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    bucket, first, n = bucket[by], first[by], n[by]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    # some messages at a time, so that not all phrases of a block are spelt at once
    for i in range(0, len(cuts), 16):
        a, b = cuts[i], cuts[i + 16] if i + 16 < len(cuts) else len(first)
        own_cuts = cuts[i : i + 16]
        ends = pa.array(np.append(own_cuts, b) - a, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (own.spelt(first[a:b], size) if size else pa.array([""] * (b - a)), pa.array(n[a:b], pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[own_cuts]), pa.array([lang] * len(own_cuts), pa.string()), pa.array(np.full(len(own_cuts), block)), *lists], schema=MESSAGES)


def by_language(table: pa.Table) -> Iterator[tuple[str, Block]]:
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        yield lang, Block(own["piece"].combine_chunks(), own["n"].to_numpy())


def short_grams(pieces: DataFrame, buckets: int) -> DataFrame:
    """MESSAGES of each block's words and pairs; the empty phrase has the number of words."""

    def emit(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in by_language(pa.Table.from_batches(held)):
            first, n, _ = own.summed(own.word, np.arange(len(own.word)))
            yield from messages(lang, block, own, np.zeros(1, np.int64), np.array([own.weight.sum()]), 0, buckets)
            yield from messages(lang, block, own, first, n, 1, buckets)
            pairs = own.pairs()
            at = np.flatnonzero(pairs >= 0)
            first, n, _ = own.summed(pairs[at], at)
            yield from messages(lang, block, own, first, n, 2, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[0].column(3)[0].as_py() != block[a]:
                    yield from emit(held[0].column(3)[0].as_py(), held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held[0].column(3)[0].as_py(), held)

    return pieces.select("lang", "piece", "n", "block").mapInArrow(run, MESSAGES_DDL)


def long_grams(pieces: DataFrame, frequent: DataFrame, longest: int, buckets: int) -> DataFrame:
    """MESSAGES of each block's phrases of three words and more all of whose pairs are ``frequent`` (lang, block, pairs)."""

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for lang, block in by_language(own) if len(known) else ():
            number = block.numbers_of
            pairs = [tuple(map(bytes, x.encode().split(b" "))) for x in chain.from_iterable(known.filter(pc.equal(known["lang"], lang))["pairs"].to_pylist())]
            code = np.array([number[a] * len(block.names) + number[b] for a, b in pairs], np.int64)
            pair = block.pairs()
            good = np.isin(pair, code)
            at = np.flatnonzero(good)
            group = pair[at]
            for size in range(3, longest + 1):
                inner = at + size - 2 < len(good)
                inner[inner] = good[at[inner] + size - 2]
                at, group = at[inner], group[inner]
                if not len(at):
                    break
                last = block.word[at + size - 1]
                _, group = np.unique(group, return_inverse=True)
                first, n, group = block.summed(group * len(block.names) + last, at)
                out += messages(lang, ALL, block, first, n, size, buckets)
        return pa.Table.from_batches(out, MESSAGES)

    left, right = pieces.select("lang", "piece", "n", "block"), frequent.select("lang", "pairs", "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, MESSAGES_DDL)


def counted(sent: DataFrame, buckets: int, least: int, answer: bool) -> DataFrame:
    """Sums of what was ``sent`` (MESSAGES) over all blocks, for the empty phrase and phrases of ``least`` or more, by ANSWERS_DDL.

    A message's bucket is the hash of its phrases. Duckdb sums each bucket up, on disk where it outgrows COUNT_MEMORY.
    With ``answer`` a message is also a request for what comes of its phrases: a block's requests of a bucket are answered
    by one row with those of its pairs that are frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # scratch of this task alone, beside Spark's own spills; nothing else reads it
        own = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        with tempfile.TemporaryDirectory(dir=own if os.path.isdir(own) else None) as folder:
            db = duckdb.connect(f"{folder}/bucket.db", config={"memory_limit": COUNT_MEMORY, "threads": 1, "temp_directory": f"{folder}/spill", "preserve_insertion_order": False})
            db.register("rows", pa.RecordBatchReader.from_batches(MESSAGES, (pa.RecordBatch.from_arrays(b.columns, schema=MESSAGES) for b in batches)))
            db.execute("CREATE TABLE r AS SELECT lang, block, unnest(grams) AS gram, unnest(n) AS n FROM rows")
            db.unregister("rows")
            db.execute(f"CREATE TABLE f AS SELECT lang, gram, sum(n)::BIGINT AS n FROM r GROUP BY lang, gram HAVING sum(n) >= {least} OR gram = ''")
            yield from db.sql(f"SELECT lang, gram, {ALL}::BIGINT AS block, n, NULL::VARCHAR[] AS pairs FROM f").to_arrow_reader(1 << 16)
            if answer:
                yield from db.sql("SELECT lang, NULL::VARCHAR AS gram, block, 0::BIGINT AS n, list(gram) AS pairs FROM r SEMI JOIN f USING (lang, gram) WHERE contains(gram, ' ') GROUP BY lang, block").to_arrow_reader(64)
            db.close()

    return sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, ANSWERS_DDL)


def frequencies(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): how often each phrase of up to ``longest`` words stands in the pieces, if ``least`` times or more.

    The empty phrase has the number of words of its language. A phrase is as frequent as the rarest pair in it at most,
    so phrases of three words and more are only counted where all their pairs are frequent; nothing else is left out.
    """
    pieces = scratch.keep(distinct_pieces(docs, block_bytes, lang, text), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = max(1, -(-size // (BUCKET_BYTES // BLOCK_BYTES * block_bytes)))
    short = scratch.keep(counted(short_grams(pieces, buckets), buckets, least, True), "short")
    long = scratch.keep(counted(long_grams(pieces, short.filter(f"block <> {ALL}"), longest, buckets), buckets, least, False), "long")
    scratch.drop("pieces")
    return short.filter(f"block = {ALL}").union(long).select("lang", "gram", "n")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_bytes: int = BLOCK_BYTES, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations, all counts exact.

    Identical pieces are counted once with their multiplicity. A candidate asks for the counts of both parts of each of
    its cuts: the requests are shuffled to where the parts are counted. A candidate goes if one that is a word longer and
    holds it is as frequent; that is enough, as a phrase within another is at least as frequent, and all between them are
    candidates. Ties of score, then of a, go by the bytes of the phrase.

    Null text is empty, a null language is ``und``; texts without a word, and empty tables, give no row. Repeated rows count
    each. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    found = scratch.keep(frequencies(docs, scratch, least, longest, block_bytes, lang, text), "counts")
    scratch.drop("short", "long")
    words = found.filter("gram <> ''").withColumn("words", F.split("gram", " "))
    candidates = words.filter(F.size("words") > 1).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "words")
    cut, size = F.col("cut"), F.size("words")
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.array_join(part, " ").alias("part")) for i, part in ((0, F.slice("words", F.lit(1), cut)), (1, F.slice("words", cut + 1, size - cut))))))
    requests = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1))).select("lang", "phrase", "a", "cut", sides.alias("x")).select("lang", "phrase", "a", "cut", "x.side", "x.part")
    answers = requests.join(found.withColumnsRenamed({"gram": "part", "n": "f"}), ["lang", "part"])
    parts = answers.groupBy("lang", "phrase", "a", "cut").agg(*(F.max(F.when(F.col("side") == i, F.col("f"))).alias(x) for i, x in enumerate("lr")))
    totals = found.filter("gram = ''").select("lang", "n")
    a, n, left, right = (F.col(x).cast("decimal(18,0)") for x in "anlr")
    scored = parts.join(totals, "lang").withColumn("up", F.lit(1000).cast("decimal(4,0)") * a * n).withColumn("down", left * right).withColumn("score", F.expr("up div down"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r")
    inner = F.explode(F.array(*(F.array_join(F.slice("words", F.lit(i), size - 1), " ") for i in (1, 2))))
    longer = candidates.filter(size > 2).select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a").drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM p),
t AS (SELECT lang, sum(len(x))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, unnest(list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], ' '))) AS gram, k FROM w, range(1, 6) r(k) WHERE len(x) >= k),
f AS (SELECT lang, gram, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, gram AS phrase, k AS size, f AS a, string_split(gram, ' ') AS x FROM f WHERE k > 1),
s AS (SELECT lang, phrase, a, cut, array_to_string(x[1:cut], ' ') AS one, array_to_string(x[cut + 1:], ' ') AS two FROM c, range(1, 5) r(cut) WHERE cut < size),
q AS (
  SELECT s.*, u.f AS l, v.f AS r, t.n, ((1000::HUGEINT * a * t.n) // (u.f::HUGEINT * v.f))::BIGINT AS score
  FROM s JOIN f u ON u.lang = s.lang AND u.gram = s.one JOIN f v ON v.lang = s.lang AND v.gram = s.two JOIN t ON t.lang = s.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM q),
m AS (SELECT lang, phrase, a, l, r, n, score FROM b WHERE nth = 1 AND NOT EXISTS (
  SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > len(string_split(b.phrase, ' ')) AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m
QUALIFY rank <= 2000
"""
