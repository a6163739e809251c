"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact confirmation, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.components import components, spanning
from genoloom.llm.scratch import Scratch
from genoloom.llm.worker import task

BANDS, BAND_ROWS, SKETCH_WORDS = 40, 6, 8
PERCENT, SLACK = 80, 18
#: Hubs of a large group, and of each kind in a bucket of one.
GROUP_HUBS, BUCKET_HUBS = 16, 4
#: Texts, and bytes of texts, that are compared together; hubs among them, and hubs at a time.
GROUP_ROWS, GROUP_BYTES, HUB_ROWS, AT_ONCE = 256, 1 << 20, 256, 64
U, U4 = np.uint64, np.uint32
SIGNATURE = "n_shingles long, words binary, keys array<long>, sketch array<long>"


def shingles(w: W.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their numbers; a text of fewer words is one shingle as a whole."""
    row = np.arange(len(w.rows))
    grams = W.windows(w.hash, width)
    inside = w.row[: len(grams)] == w.row[width - 1 : width - 1 + len(grams)]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    whole = [W.windows(w.hash[w.first[i] : w.first[i] + w.count[i]], int(w.count[i])) for i in short]
    own, value = np.concatenate([w.row[: len(grams)][inside], short]), np.concatenate([grams[inside], *whole])
    by = np.lexsort((value, own))
    own, value = own[by], value[by]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])[: len(own)]
    return value[new], np.bincount(own[new], minlength=len(row))


def signatures(text: pa.Array, width: int) -> dict[str, np.ndarray]:
    """Set size, SHA-256 of the words, band keys, and the odd sketch of each text."""
    samples = BANDS * BAND_ROWS
    seeds = W.mix(np.arange(1, 2 * samples + 1, dtype=U))
    factor, shift = (seeds[:samples] >> U(32)).astype(U4) | U4(1), seeds[samples:].astype(U4)
    out: dict[str, list] = {k: [] for k in ("n_shingles", "words", "keys", "sketch")}
    for chunk in W.chunks(text):
        own = W.split(chunk, lower=True)
        value, count = shingles(own, width)
        full = np.flatnonzero(count)
        at = (np.cumsum(count) - count)[full]
        folded = (value ^ (value >> U(32))).astype(U4)
        least = np.zeros((len(full), samples), U4)
        for i in range(samples if len(full) else 0):
            x = folded * factor[i] + shift[i]
            x ^= x >> U4(15)
            x *= U4(0x2C1B3C6D)
            least[:, i] = np.minimum.reduceat(x, at)
        parts = W.mix(least.astype(U) + seeds[:samples])
        keys = np.zeros((len(chunk), BANDS), U)
        keys[full] = W.mix(parts.reshape(len(full), BANDS, BAND_ROWS).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U))
        bits = parts % U(64 * SKETCH_WORDS)
        odd = np.zeros((len(full), 64 * SKETCH_WORDS), np.uint8)
        np.add.at(odd, (np.repeat(np.arange(len(full)), samples), bits.reshape(-1).astype(np.int64)), 1)
        sketch = np.zeros((len(chunk), SKETCH_WORDS), U)
        sketch[full] = np.packbits(odd & 1, axis=1, bitorder="little").view(U)
        out["words"].append(np.array([hashlib.sha256(b" ".join(x)).digest() for x in own.rows], object))
        out["n_shingles"].append(count)
        out["keys"].append(keys)
        out["sketch"].append(sketch)
    empty = {"keys": np.zeros((0, BANDS), U), "sketch": np.zeros((0, SKETCH_WORDS), U)}
    return {k: np.concatenate(v) if v else empty.get(k, np.zeros(0, np.int64)) for k, v in out.items()}


def lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(W.signed(values).reshape(-1)))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = signatures(batch.column(2), width)
            columns = [batch.column(0), batch.column(1), pa.array(got["n_shingles"]), pa.array(got["words"], pa.binary()), lists(got["keys"]), lists(got["sketch"])]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "source", "n_shingles", "words", "keys", "sketch"])

    return docs.select("doc", "source", "text").mapInArrow(task("minhash", run), f"doc {docs.schema['doc'].dataType.simpleString()}, source long, {SIGNATURE}")


class Sets:
    """Shingle sets of some texts, exact on words: words, and then shingles, get numbers of their own.

    A text of fewer words than a shingle has an empty set here.
    """

    def __init__(self, texts: Iterable[str], width: int):
        known: dict[bytes, int] = {}
        numbers = [np.fromiter((known.setdefault(w, len(known)) for w in text.encode().lower().split()), np.int64) for text in texts]
        size = [len(x) for x in numbers]
        word, row = np.concatenate([np.zeros(0, np.int64), *numbers]), np.repeat(np.arange(len(size)), size)
        code, most = word, len(known)
        for k in range(1, width):
            if most * len(known) >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                most = int(code.max(initial=0)) + 1
            code, most = code[: max(0, len(word) - k)] * len(known) + word[k:], most * len(known)
        row, last = row[: len(code)], row[width - 1 :]
        code, row = code[row == last], row[row == last]
        by = np.lexsort((code, row))
        row, code = row[by], code[by]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])[: len(row)]
        self.code, self.count = code[new], np.bincount(row[new], minlength=len(size))
        self.first = np.cumsum(self.count) - self.count

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the given texts one after another, and the place in ``texts`` that each belongs to."""
        n = self.count[texts]
        own = np.repeat(np.arange(len(texts)), n)
        return self.code[np.arange(len(own)) - np.repeat(np.cumsum(n) - n - self.first[texts], n)], own

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of each of ``left`` with each of ``right``."""
        both = np.zeros((len(left), len(right)), np.int64)
        code, own = self.of(right)
        names, number = np.unique(code, return_inverse=True)
        if not len(names):
            return both
        table = np.zeros((len(names), len(right)), np.uint8)
        table[number, own] = 1
        code, own = self.of(left)
        at = np.minimum(np.searchsorted(names, code), len(names) - 1)
        hit = names[at] == code
        at, own = at[hit], own[hit]
        if len(own):
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            both[own[begin]] = np.add.reduceat(table[at], begin, axis=0, dtype=np.int32)
        return both


def not_ruled_out(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of odd sketches and set sizes do not rule out the limit.

    With k samples folded into n bits, x differing bits estimate a similarity of 1 + n / (4 k) ln(1 - 2 x / n). SLACK
    hundredths leave 2.6e-7 of pairs at 0.8 out; the sets decide on the others.
    """
    n, k = 64 * SKETCH_WORDS, BANDS * BAND_ROWS
    most = int(n / 2 * (1 - np.exp(4 * k / n * (percent - SLACK - 100) / 100)))
    apart = np.zeros((len(left), len(right)), np.int64)
    for i in range(SKETCH_WORDS):
        apart += np.bitwise_count(left[:, None, i] ^ right[None, :, i])
    low, high = np.minimum(n_left[:, None], n_right[None]), np.maximum(n_left[:, None], n_right[None])
    return (apart <= most) & (100 * low >= percent * high)


def compared(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join all that is linked within each group of ``rows`` (bin, grp, hub, node, n_shingles, sketch, text).

    In a group each hub is held against all others: odd sketches first, then the whole sets of those that they leave.
    Groups of a bin share a task and number their words together.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, where, number = np.unique(table["node"].to_numpy(), return_index=True, return_inverse=True)
        size = table["n_shingles"].to_numpy()[where]
        sketches = np.asarray(table["sketch"].combine_chunks().flatten()).view(U).reshape(-1, SKETCH_WORDS)[where]
        sets = Sets((x.as_py() for x in table["text"].take(pa.array(where))), width)
        grp, hub = table["grp"].to_numpy(), table["hub"].to_numpy()
        by = np.argsort(grp, kind="stable")
        found: list[tuple[int, int]] = []
        for rows in np.split(by, np.flatnonzero(np.diff(grp[by])) + 1):
            every = np.unique(number[rows])
            all_hubs, links = np.unique(number[rows[hub[rows]]]), []
            for k in range(0, len(all_hubs), AT_ONCE):
                hubs = all_hubs[k : k + AT_ONCE]
                good = not_ruled_out(sketches[every], sketches[hubs], size[every], size[hubs], percent) & (every[:, None] != hubs[None])
                others, good = every[good.any(1)], good[good.any(1)]
                if len(others):
                    both = sets.common(others, hubs)
                    x, y = np.nonzero(good & (both > 0) & (100 * both >= percent * (sets.count[others][:, None] + sets.count[hubs][None] - both)))
                    links.append((node[hubs[y]], node[others[x]]))
            if links:
                found += spanning(*(np.concatenate(x) for x in zip(*links, strict=True)))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bin").applyInArrow(run, "a long, b long")


class Comparison:
    """Compares groups of candidate texts. ``texts``: (node, n_shingles, sketch, text, bytes), a row for each class."""

    def __init__(self, texts: DataFrame, scratch: Scratch, width: int, percent: int):
        self.texts, self.scratch, self.width, self.percent = texts, scratch, width, percent

    def links(self, rows: DataFrame, name: str) -> DataFrame:
        """Links within groups (grp, hub, node), each small; groups are dealt to bins of about GROUP_BYTES."""
        full = self.scratch.keep(rows.join(self.texts.select("node", "n_shingles", "sketch", "text", "bytes"), "node"), f"full-{name}")
        bins = max(1, (full.agg(F.sum("bytes")).first()[0] or 0) // GROUP_BYTES)
        found = self.scratch.keep(compared(full.withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins))), self.width, self.percent), f"links-{name}")
        self.scratch.drop(f"full-{name}")
        return found

    def hub_links(self, rows: DataFrame, name: str) -> DataFrame:
        """Links of groups (key, hub, node, bytes) of any size, dealt to blocks that have a part of the hubs and a part of all rows.

        Every hub meets every row of its key once. A block has about HUB_ROWS hubs and GROUP_ROWS others. The rows are
        written first, as sizes, hubs and others are each read from them.
        """
        rows = self.scratch.keep(rows, f"rows-{name}")
        sizes = rows.groupBy("key").agg(F.ceil(F.count_if("hub") / HUB_ROWS).alias("hub_parts"), F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("bytes") / GROUP_BYTES)).alias("parts"))
        full = rows.join(sizes.filter("hub_parts > 0"), "key")

        def all_of(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

        hubs = full.filter("hub").select("key", F.pmod(F.xxhash64("node", F.lit(5)), F.col("hub_parts")).alias("i"), all_of("parts").alias("j"), "node", "hub")
        others = full.select("key", all_of("hub_parts").alias("i"), F.pmod(F.xxhash64("node", F.lit(6)), F.col("parts")).alias("j"), "node", F.lit(False).alias("hub"))
        found = self.links(hubs.union(others).select(F.xxhash64("key", "i", "j").alias("grp"), "hub", "node"), name)
        self.scratch.drop(f"rows-{name}")
        return found


def sample(n: int, seed: int) -> Column:
    """Up to ``n`` (node, bytes) of a group, each with the least hash of a kind: put together before the shuffle."""
    return F.array_distinct(F.array(*(F.min_by(F.struct("node", "bytes"), F.xxhash64("node", F.lit(seed + i))) for i in range(n))))


def parted(inside: DataFrame) -> DataFrame:
    """Of rows (key, node, component, ...) those whose key has several components, with ``out``: outside the key's largest one."""
    counts = inside.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"))
    return inside.join(counts.filter("kinds > 1").select("key", F.col("main.component").alias("main")), "key").withColumn("out", F.col("component") != F.col("main")).drop("main")


def link_classes(leaders: DataFrame, rows: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """(node, component) of linked classes. ``leaders``: (node, doc, source, n_shingles, keys, sketch), one row for each class.

    Texts that share a band key may be linked; what such sharing connects is a group. Sets of any size count: texts of
    other words or another order may have equal sets of one shingle.
    A group of up to AT_ONCE texts is compared whole, each text read once.
    In a larger group two rounds come first, which only connect: GROUP_HUBS texts of the group are compared with all of
    it, then in each bucket that still holds several components BUCKET_HUBS texts of the largest one and as many others
    are compared with all that lie outside the largest. At last, in each bucket, every text outside the largest component is held
    against all of the bucket, so every candidate pair between components has been looked at and no link is lost.
    """
    keys = leaders.select("node", F.explode("keys").alias("key"))
    shared = scratch.keep(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key", "low"), "shared")
    members = scratch.keep(keys.join(shared, "key"), "members")
    groups = components(members.select(F.col("node").alias("a"), F.col("low").alias("b")), scratch, "groups").toDF("node", "grp")
    groups = groups.union(groups.select("grp", "grp").distinct())
    wanted = leaders.select("node", "doc", "source", "n_shingles", "sketch").join(groups, "node")
    texts = scratch.keep(rows.join(wanted, ["doc", "source"]).select("node", "grp", "n_shingles", "sketch", "text", F.octet_length("text").alias("bytes")), "texts")
    compare = Comparison(texts, scratch, width, percent)
    sized = texts.groupBy("grp").agg(F.count("*").alias("n"), F.sum("bytes").alias("whole"))
    placed = texts.select("node", "grp", "bytes").join(sized.select("grp", ((F.col("n") > AT_ONCE) | (F.col("whole") > GROUP_BYTES)).alias("large")), "grp")
    placed = scratch.keep(placed, "placed")
    found = compare.links(placed.filter("not large").select("grp", F.lit(True).alias("hub"), "node"), "small")
    own = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    large = scratch.keep(placed.filter("large").drop("large").join(own, "node"), "large")
    scratch.drop("shared", "members")
    if large.isEmpty():
        return components(found, scratch, "final")

    def buckets(labels: DataFrame) -> DataFrame:
        known = large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return parted(known.select("node", "bytes", "component", F.explode("keys").alias("key")))

    every = large.select(F.col("grp").alias("key"), F.lit(False).alias("hub"), "node", "bytes")
    some = every.groupBy("key").agg(sample(GROUP_HUBS, 0).alias("nodes")).select("key", F.lit(True).alias("hub"), F.inline("nodes"))
    links = compare.hub_links(some.union(every), "whole")
    mixed = scratch.keep(buckets(components(links, scratch, "labels-0")), "mixed")
    some = mixed.groupBy("key", "out").agg(sample(BUCKET_HUBS, GROUP_HUBS).alias("nodes")).select("key", F.lit(True).alias("hub"), F.inline("nodes"))
    links = links.union(compare.hub_links(some.union(mixed.filter("out").select("key", F.lit(False), "node", "bytes")), "buckets"))
    rest = buckets(components(links, scratch, "labels-1")).select("key", F.col("out").alias("hub"), "node", "bytes")
    return components(found.union(links).union(compare.hub_links(rest, "rest")), scratch, "final")


def fingerprinted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, source, text): a row is known by its key and a hash of its text."""
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def classified(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc, source, n_shingles, component) of every row; component is the smallest key that it is linked with, its own if none."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = fingerprinted(docs, key, text)
    known = scratch.keep(sketch(rows, width), "sketches")
    group = ["words", "n_shingles"]
    full = known.filter("n_shingles > 0 and doc is not null")
    first = F.min_by(F.struct("doc", "source", "keys", "sketch"), F.struct("doc", "source")).alias("first")
    leaders = scratch.keep(full.groupBy(*group).agg(first).select(*group, "first.*", F.monotonically_increasing_id().alias("node")), "leaders")
    labels = link_classes(leaders, rows.filter("doc is not null"), scratch, width, percent)
    named = leaders.select(*group, "doc", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.keep(named, "named")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    classes = scratch.keep(named.join(least, "component").select(*group, "least"), "classes")
    placed = known.select("doc", "source", *group).join(classes, group, "left")
    return placed.select("doc", "source", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")).alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``, linked at a Jaccard similarity of ``percent`` hundredths.

    Sets are of distinct ``width``-word shingles of the lower-cased text. Null text and text without words have an
    empty set and link with nothing. Rows of the same words in the same order, by SHA-256, are one class, which one of its
    rows stands for in the search; every other link is confirmed on the sets of words themselves. Keys may be of any type
    that has an order.
    A row is kept if its key is the smallest of its component (all its rows with that key); a null key is linked with
    nothing and kept. A pair at 0.8 is missed with probability 5.2e-6 by the BANDS bands of BAND_ROWS samples and 2.6e-7 by the sketches. An empty table
    gives an empty result; other columns are dropped.
    """
    out = classified(docs, width, percent, key, text).select(F.col("doc").alias(key), "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Those rows of ``docs``, all columns, that ``near_duplicates`` keeps. Texts of a repeated key are judged each for itself."""
    removed = classified(docs, width, percent, key, text).filter("doc <> component").select("doc", "source").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("doc"), F.xxhash64(text).alias("source"))
    return whole.join(removed, ["doc", "source"], "left_anti").select("row.*")
