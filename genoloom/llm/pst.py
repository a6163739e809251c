"""Language-model scoring with a probabilistic suffix tree, beside a unigram base."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.bpe import Numbered
from genoloom.llm.bytetrie import Symbols
from genoloom.llm.scratch import Scratch

#: Symbols of a context at most, occurrences it needs, bits it must add, and observations its suffix counts as.
ORDER, SUPPORT, DIVERGENCE, PRIOR = 6, 8, 0.01, 8.0
#: Symbols of a word that see the word before, and how many bytes of it.
HEAD, TAIL = 3, 3
#: Bytes of a block of texts, and blocks for which there is a bucket of units.
BLOCK_BYTES, BUCKET_BLOCKS = 16 << 20, 2
SPACE, END_BYTE, END_WORD = 32, b"\xff", b" "
#: Between the units of a request: white space that is in none.
SEPARATOR = b"\n"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().translate(LOWER).split(), END_WORD]


class Units:
    """What some texts are scored by: their different words, and for each token the head it has after the token before.

    A head is the first HEAD symbols of a word, or END, with the last TAIL bytes of the word before and a space.
    """

    def __init__(self, texts: list[str]):
        known = Numbered()
        known.numbers([b""], 1)
        rows = [np.zeros(0, np.int32)]
        for text in texts:
            own = tokens(text)
            rows.append(known.numbers(own, len(own)).astype(np.int32))
        self.count = np.fromiter(map(len, rows[1:]), np.int64, len(texts))
        self.word = np.concatenate(rows)
        del rows
        self.words = known.fresh
        tails: dict[bytes, int] = {}
        heads: dict[bytes, int] = {}
        tail = np.array([tails.setdefault(w[-TAIL:], len(tails)) for w in self.words])
        head = np.array([heads.setdefault(END_BYTE if w == END_WORD else (w + b" ")[:HEAD], len(heads)) for w in self.words])
        before = np.concatenate([[0], self.word])[:-1]
        before[np.cumsum(self.count) - self.count] = 0
        pairs = tail[before] * len(heads)
        pairs += head[self.word]
        number, pair = pd.factorize(pairs)
        self.head = number.astype(np.int32)
        del before, pairs, number
        names, ends = list(tails), list(heads)
        self.heads = [names[x // len(heads)] + b" " + ends[x % len(heads)] for x in pair.tolist()]

    def all(self) -> list[bytes]:
        """Words that occur, then heads: no word but the end holds a space, and each head does."""
        return self.words[1:] + self.heads


def unit_codes(units: list[bytes], head: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ``order`` before it, the symbol in the lowest byte, and the unit it is of.

    A head's own symbols follow its space. A word's are those after the first HEAD, up to the space that closes it.
    """
    strings = [u if h else b"" if u == END_WORD else u + b" " for u, h in zip(units, head.tolist(), strict=True)]
    skip = np.array([u.index(b" ") + 1 if h else HEAD for u, h in zip(units, head.tolist(), strict=True)], np.int64)
    count = np.fromiter(map(len, strings), np.int64, len(strings))
    own = np.repeat(np.arange(len(count)), count)
    chosen = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) >= skip[own]
    codes = Symbols(np.frombuffer(b"".join(strings), np.uint8), count, order, SPACE).codes().view(np.int64)
    return codes[chosen], own[chosen]


def suffix(column: str, symbols: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def by_bucket(units: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the units in order of their buckets, in each as they come, and where each bucket begins, and the end."""
    bucket = np.fromiter(map(crc32, units), np.int64, len(units)) % buckets
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


class Bucket:
    """The different units that some blocks ask for, with their counts ``c``, and for each request the numbers of its units."""

    def __init__(self, requests: pa.Table):
        known, counts = Numbered(), []
        self.numbers = []
        for units, n in zip(requests["units"].to_pylist(), requests["n"].to_pylist(), strict=True):
            counts.append(np.frombuffer(unpacked(n), np.int64))
            self.numbers.append(known.numbers(unpacked(units).split(SEPARATOR), len(counts[-1])))
        self.units = known.fresh
        self.c = np.zeros(len(self.units), np.int64)
        for number, n in zip(self.numbers, counts, strict=True):
            self.c[number] += n
        self.head = np.array([b" " in x and x != END_WORD for x in self.units], bool)

    def codes(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        return unit_codes(self.units, self.head, order)


def bucket_codes(requests: DataFrame, order: int) -> DataFrame:
    """(bucket, code, n): the different codes of each bucket's units; a row without a code has the bucket's number of words that were learned from."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        codes, own = bucket.codes(order)
        code, number = np.unique(codes, return_inverse=True)
        n = np.bincount(number, bucket.c[own], len(code)).astype(np.int64)
        learned = np.count_nonzero(bucket.c[~bucket.head])
        code = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(code, pa.int64())])
        return pa.table({"bucket": pa.array(np.full(len(code), key[0].as_py())), "code": code, "n": pa.array(np.concatenate([[learned], n]).astype(np.int64))})

    return requests.groupBy("bucket").applyInArrow(run, "bucket long, code long, n long")


def answers(requests: DataFrame, codes: DataFrame, logs: DataFrame, order: int) -> DataFrame:
    """(block, bucket, c, log): the counts and summed logs of each request's units, in its order. A bucket asks once for each of its different codes."""

    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        code, log = sent["code"].to_numpy(), sent["log"].to_numpy()
        by = np.argsort(code)
        code, log = code[by], log[by]
        found, own = bucket.codes(order)
        total = np.bincount(own, log[np.searchsorted(code, found)], len(bucket.units))
        c, total = ([packed(x[number].tobytes()) for number in bucket.numbers] for x in (bucket.c, total))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "c": pa.array(c, pa.binary()), "log": pa.array(total, pa.binary())})

    sent = codes.join(logs, "code").select("bucket", "code", "log")
    return requests.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(run, "block long, bucket long, c binary, log binary")


def likelihoods(grams: DataFrame, scratch: Scratch, order: int = ORDER, support: int = SUPPORT, divergence: float = DIVERGENCE, prior: float = PRIOR) -> DataFrame:
    """(code, log): log10 probability of each symbol after the longest retained suffix of the ``order`` symbols before it.

    ``grams``: (code, n) with a row for each code, the symbol in the lowest byte; n is 0 for what is not learned from.
    The empty context gives a symbol seen n of N times (n + 1/2) / (N + 128). A longer one mixes its counts with what
    its suffix says, as ``prior`` more observations. A context is retained if it has ``support`` occurrences and its
    counts diverge from its suffix's distribution by ``divergence`` bits or more, and so are its suffixes. Counts are
    summed up from depth to depth, and every depth is joined with the next lower one, so the tree is as large as the
    corpus makes it and stays in tables. A key has 256 rows at most in the sums, windows and joins of a depth.
    """
    counts = {order: grams}
    for k in range(order - 1, -1, -1):
        counts[k] = scratch.keep(counts[k + 1].groupBy(suffix("code", k + 1).alias("code")).agg(F.sum("n").alias("n")), f"counts-{k}")
    whole = counts[0].agg(F.sum("n")).first()[0] or 0
    root = counts[0].select("code", ((F.col("n") + 0.5) / F.lit(whole + 128.0)).alias("chance"))
    levels, context = {0: root}, Window.partitionBy("context")
    for k in range(1, order + 1):
        x = counts[k].withColumn("context", F.shiftrightunsigned("code", 8)).withColumn("total", F.sum("n").over(context)).filter(F.col("total") >= support)
        x = x.withColumn("shorter", suffix("code", k)).join(levels[k - 1].select(F.col("code").alias("shorter"), F.col("chance").alias("before")), "shorter")
        share = F.col("n") / F.col("total")
        apart = F.sum(F.when(F.col("n") > 0, share * F.log2(share / F.col("before"))).otherwise(0.0)).over(context)
        chance = (F.col("n") + prior * F.col("before")) / (F.col("total") + prior)
        levels[k] = scratch.keep(x.select("code", "context", chance.alias("chance"), (apart >= divergence).alias("own")), f"level-{k}")
    kept = {}
    for k in range(order, 0, -1):
        here = levels[k].filter("own").select("context")
        kept[k] = scratch.keep((here if k == order else here.union(kept[k + 1].select(suffix("context", k).alias("context")))).distinct(), f"kept-{k}")
    found = root
    for k in range(1, order + 1):
        own = levels[k].join(kept[k], "context", "left_semi").select("code", "chance")
        x = counts[k].select("code", suffix("code", k).alias("shorter")).join(found.toDF("shorter", "before"), "shorter").join(own, "code", "left")
        found = scratch.keep(x.select("code", F.coalesce("chance", "before").alias("chance")), f"found-{k}")
        scratch.drop(f"found-{k - 1}", *([f"counts-{k}"] if k < order else []))
    return found.select("code", F.log10("chance").alias("log"))


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, support: int = SUPPORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out``: a condition on rows that are scored but not learned from. Null or empty text is its end token alone.
    Rows with equal or null keys are scored each for itself. An empty table gives an empty result; other columns go.

    The tree's symbols are bytes. The context of one of a word's first HEAD symbols reaches back over the space before it
    into the last TAIL bytes of the word before, that of a later one to the start of its word, and either over ``order``
    symbols at most. So a text is scored by its words and their heads: texts are dealt by a hash of the whole row into
    blocks of about ``block_bytes``, each block counts its own and sends them as one packed request to each bucket of a hash
    of units. Buckets put equal units together, the tree is made of all of them, and a request is answered in its order,
    so no unit is sent a second time. A unit, however frequent, is in a request of each block at most, and neither the
    vocabulary nor the tree is ever gathered in one place.
    """
    scratch = Scratch(docs.sparkSession, "pst")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(max(1, -(-size // block_bytes)))))
    buckets = max(1, -(-size // (BUCKET_BLOCKS * block_bytes)))

    def in_order(table: pa.Table) -> pa.Table:
        """By text, so that a block's units have the same numbers each time that it is put together."""
        texts = table["text"].to_pylist()
        return table.take(pa.array(sorted(range(len(texts)), key=texts.__getitem__), pa.int64()))

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        table = in_order(table)
        units = Units(table["text"].to_pylist())
        names = units.all()
        learned = np.repeat(~np.asarray(table["held_out"].to_numpy(zero_copy_only=False), bool), units.count)
        n = np.concatenate([np.bincount(units.word[learned], minlength=len(units.words))[1:], np.bincount(units.head[learned], minlength=len(units.heads))]).astype(np.int64)
        order, start = by_bucket(names, buckets)
        rows = [(b, order[start[b] : start[b + 1]]) for b in range(buckets) if start[b] < start[b + 1]]
        return pa.table({
            "block": pa.array(np.full(len(rows), key[0].as_py())), "bucket": pa.array([b for b, _ in rows], pa.int64()),
            "units": pa.array([packed(SEPARATOR.join([names[i] for i in at.tolist()])) for _, at in rows], pa.binary()), "n": pa.array([packed(n[at].tobytes()) for _, at in rows], pa.binary()),
            "learned": pa.array([int(n[at[at < len(units.words) - 1]].sum()) for _, at in rows], pa.int64()),
        })

    requests = scratch.keep(dealt.groupBy("block").applyInArrow(asked, "block long, bucket long, units binary, n binary, learned long"), "requests")
    scratch.clean()
    codes = scratch.keep(bucket_codes(requests, order), "codes")
    scratch.clean()
    n = requests.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    v = codes.filter("code IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    codes = codes.filter("code IS NOT NULL")
    grams = scratch.keep(codes.groupBy("code").agg(F.sum("n").alias("n")), "grams")
    logs = likelihoods(grams, scratch, order, support)
    scratch.drop("grams", *(f"{x}-{k}" for k in range(order + 1) for x in ("counts", "level", "kept")))
    scratch.clean()
    replies = scratch.keep(answers(requests, codes, logs, order), "replies")
    scratch.drop("requests", "codes", f"found-{order}")
    scratch.clean()

    def run(texts: pa.Table, sent: pa.Table) -> pa.Table:
        texts = in_order(texts)
        units = Units(texts["text"].to_pylist())
        names, words = units.all(), len(units.words) - 1
        order, start = by_bucket(names, buckets)
        c, log = np.zeros(len(names), np.int64), np.zeros(len(names))
        for b, own, sums in zip(*(sent[x].to_pylist() for x in ("bucket", "c", "log")), strict=True):
            at = order[start[b] : start[b + 1]]
            c[at], log[at] = np.frombuffer(unpacked(own), np.int64), np.frombuffer(unpacked(sums), np.float64)
        base, word, first = np.log10((c[:words] + 1) / (n + v + 1)), units.word - 1, np.cumsum(units.count) - units.count
        sums = [np.add.reduceat(x, first) if len(first) else x for x in (c[word] > 0, base[word], log[word] + log[words + units.head])]
        return pa.table({"key": texts["key"], "held_out": texts["held_out"], "n_tokens": pa.array(units.count), "n_known": pa.array(sums[0].astype(np.int64)), "train_tokens": pa.array(np.full(len(first), n)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    schema = f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("key", key)
