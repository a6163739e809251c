"""Removal of long repeats that an earlier document has, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.scratch import Scratch
from genoloom.llm.worker import task

WINDOW = 50
#: Rounds: runs are named before the first round of pairs and once more half-way.
PAIR_ROUNDS, RUN_ROUNDS = 8, (0, 4)
U = np.uint64
FAR = 1 << 40
SEGMENT = ["doc", "variant", "place", "owner", "owner_variant", "owner_place", "n"]
CUT = "doc long, source long, n_removed long, kept_text string, variant long, place long, n long, digest string"


class Level:
    """Symbols of one level: names, rows, and the words [low, high] that alone decide that the symbol is there."""

    def __init__(self, name: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.row, self.low, self.high = name, row, low, high

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], self.row[1:] != self.row[:-1]])[: len(self.row)]
        return new, np.append(new[1:], True)[: len(self.row)]

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """low of the symbol before and high of the symbol after; beyond the text nothing is decided."""
        new, last = self.edges()
        before = np.where(new, -FAR, np.concatenate([[0], self.low[:-1]]))[: len(self.low)]
        after = np.where(last, FAR, np.append(self.high[1:], 0))[: len(self.high)]
        return before, after

    def runs(self) -> Level:
        """Names each run by its symbol and length. That a run ends is known from its neighbours."""
        new, _ = self.edges()
        start = np.flatnonzero(new | np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        end = np.append(start[1:], len(self.name))
        before, after = self.around()
        length = (end - start).astype(U)
        name = np.where(length > 1, W.mix(self.name[start] ^ W.mix(length)), self.name[start])
        return Level(name, self.row[start], before[start], after[end - 1])

    def pairs(self, k: int) -> Level:
        """Names each pair of a left symbol and a right one after it; a bit of the name and the round tells the sides.

        A pair is decided by its own two symbols, a left symbol that stays by the one after it, a right one by the one
        before it.
        """
        left = (W.mix(self.name + U(k + 1)) & U(1)).astype(bool)
        _, last = self.edges()
        joins = left & ~last & np.append(~left[1:], False)[: len(left)]
        second = np.concatenate([[False], joins[:-1]])
        before, after = self.around()
        low, high = np.where(left, self.low, np.minimum(self.low, before)), np.where(left, np.maximum(self.high, after), self.high)
        at = np.flatnonzero(joins)
        name = self.name.copy()
        name[at] = W.mix(self.name[at] * U(W.BASE) + W.mix(self.name[at + 1] + U(k)))
        low[at], high[at] = self.low[at], self.high[at + 1]
        keep = ~second
        return Level(name[keep], self.row[keep], low[keep], high[keep])


def anchors(w: W.Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window inside a text its first word and a name of its two anchors.

    The anchors are of the highest-level symbols that the window's words alone decide, of these the one decided first
    from the left and the one decided first from the right. Equal windows therefore have equal anchors, wherever they
    are. Words are symbols of level 0 and need no context, so each window has one, whatever the runs and edges around it.
    """
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U)
    start = np.flatnonzero(w.row[: n - size + 1] == w.row[size - 1 :])
    level = Level(w.hash, w.row, np.arange(n), np.arange(n))
    levels = [level]
    for k in range(PAIR_ROUNDS):
        if k in RUN_ROUNDS:
            level = level.runs()
        level = level.pairs(k)
        levels.append(level)
    anchor, open_ = np.zeros(len(start), U), np.arange(len(start))
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k]
        # of the symbols decided from a window's start on, the one with the least end; if that is inside, it is the anchor
        good = np.flatnonzero((x.low >= 0) & (x.high < FAR) & (x.high - x.low < size))
        if not len(good):
            continue
        by = good[np.argsort(x.low[good], kind="stable")][::-1]
        least = np.minimum.accumulate(x.high[by])
        best = np.maximum.accumulate(np.where(x.high[by] == least, np.arange(len(by)), 0))
        at = np.searchsorted(-x.low[by], -start[open_], "right") - 1
        pick = by[best[np.maximum(at, 0)]]
        hit = (at >= 0) & (x.high[pick] < start[open_] + size)
        other = good[np.argsort(x.high[good], kind="stable")]
        most = np.maximum.accumulate(x.low[other])
        best = np.maximum.accumulate(np.where(x.low[other] == most, np.arange(len(other)), 0))
        last = other[best[np.searchsorted(x.high[other], start[open_[hit]] + size - 1, "right") - 1]]
        anchor[open_[hit]] = W.mix(W.mix(x.name[pick[hit]] + U(k)) * U(W.BASE) + x.name[last])
        open_ = open_[~hit]
        if not len(open_):
            break
    return start, anchor


def fingerprints(w: W.Words, start: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window that begins at ``start``, as two columns."""
    return W.windows(w.hash, size)[start], W.windows(w.other, size)[start]


def exact_fingerprints(w: W.Words, start: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The same from SHA-256 of the window's words: slow, for input on which the others are found to collide."""
    words = list(chain.from_iterable(w.rows))
    bits = b"".join(hashlib.sha256(b" ".join(words[i : i + size])).digest()[:16] for i in start.tolist())
    both = np.frombuffer(bits, U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def batches_of(docs: pa.RecordBatch) -> Iterator[tuple[W.Chunk, W.Words]]:
    for chunk in W.chunks(docs.column("text")):
        yield chunk, W.split(chunk)


def sha(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc, source, n_words, the digest of all words, and the distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, w in batches_of(batch):
                start, anchor = anchors(w, size)
                row = w.row[start]
                by = np.lexsort((anchor, row))
                row, anchor = row[by], anchor[by]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])[: len(row)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(chunk)))])
                digest = pa.array([sha(b" ".join(x)) for x in w.rows], pa.string())
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(W.signed(anchor[new])))
                keys = [batch.column(x).slice(chunk.first, len(chunk)) for x in ("doc", "source")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(w.count), digest, found], ["doc", "source", "n_words", "digest", "anchors"])

    return docs.mapInArrow(task("recompression", run), "doc long, source long, n_words long, digest string, anchors array<long>")


def shared_windows(docs: DataFrame, size: int, prints: Callable) -> DataFrame:
    """(a, b, doc, variant, place) of each window whose anchors are among the row's ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("anchors")
            for chunk, w in batches_of(batch):
                start, anchor = anchors(w, size)
                if not len(start):
                    continue
                own = wanted.slice(chunk.first, len(chunk))
                value = np.asarray(own.flatten()).view(U)
                key = W.mix(value ^ W.mix(np.repeat(np.arange(len(chunk)), np.asarray(own.value_lengths())).astype(U)))
                at = start[np.isin(W.mix(anchor ^ W.mix(w.row[start].astype(U))), key)]
                a, b = prints(w, at, size)
                row = w.row[at]
                doc, variant = (batch.column(x).take(pa.array(chunk.first + row)) for x in ("doc", "variant"))
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(a)), pa.array(W.signed(b)), doc, variant, pa.array((at - w.first[row]).astype(np.int32))], ["a", "b", "doc", "variant", "place"])

    return docs.mapInArrow(task("recompression", run), "a long, b long, doc long, variant long, place int")


def segments(matches: DataFrame) -> DataFrame:
    """(doc, variant, place, owner, owner_variant, owner_place, n): runs of ``n`` windows that follow one another in both documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column("links")
            own = np.repeat(np.arange(len(batch)), np.asarray(links.value_lengths()))
            code = np.asarray(links.flatten())
            by = np.lexsort((code, own))
            own, place, other = own[by], code[by] >> 32, code[by] & 0xFFFFFFFF
            new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(place) != 1) | (np.diff(other) != 1)])[: len(own)])
            key = [batch.column(x).take(pa.array(own[new])) for x in ("doc", "variant", "owner", "owner_variant")]
            yield pa.RecordBatch.from_arrays([key[0], key[1], pa.array(place[new]), key[2], key[3], pa.array(other[new]), pa.array(np.diff(new, append=len(own)))], SEGMENT)

    return matches.mapInArrow(task("recompression", run), ", ".join(f"{x} long" for x in SEGMENT))


def cut(docs: DataFrame, size: int) -> DataFrame:
    """What is left of each row, and digests of word ranges.

    ``spans`` are the runs of windows (place, n) that the row loses, ``owned`` those that others lose to it. A row that
    loses something gives (doc, source, n_removed, kept_text); each run, of either kind, gives (doc, variant, place, n,
    digest): the SHA-256 of the words that its windows cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, variant, source, text, spans, owned in zip(*(batch.column(x).to_pylist() for x in ("doc", "variant", "source", "text", "spans", "owned")), strict=True):
                words = text.encode().split()
                out += [(doc, source, None, None, variant, x["place"], x["n"], sha(b" ".join(words[x["place"] : x["place"] + x["n"] + size - 1]))) for x in [*spans, *owned]]
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["place"] for x in spans], 1)
                    np.add.at(edge, [x["place"] + x["n"] + size - 1 for x in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    out.append((doc, source, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode(), None, None, None, None))
            names, kinds = zip(*(x.split() for x in CUT.split(", ")), strict=True)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc", "variant", "source", "text", "spans", "owned").mapInArrow(task("recompression", run), CUT)


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What of each document an earlier one has, as two tables.

    The first has for every row of ``docs``: doc (the key), source (a hash of the text), n_words, digest (SHA-256 of all
    words joined by a space) and copy (its words are all those of a smaller key's document, and ``size`` or more). The
    second has for each other row that loses something: doc, source, n_removed, kept_text.

    1. Each document is recompressed; the names of runs and pairs are hashes of what they stand for, so they are global
       without a shuffle. Documents of equal words (by SHA-256) are represented by the smallest key.
    2. A window can be in two documents only if its anchors are; anchors found in one document go.
    3. Windows with other anchors only are held against one another by 128 bits of their words, and runs of matching
       windows are then verified on the words of both documents. If a single run differed, all windows would be
       held against one another by SHA-256 of their words instead.
    All rows with one key count as one owner, so they take nothing from one another, but each text of a key that has
    several is cut at its own places (``variant`` is the source there, else 0). Of rows with a null key nothing is
    removed and they own nothing.
    """
    scratch = Scratch(docs.sparkSession, "recompression")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("source", F.xxhash64("text"))
    known = scratch.keep(describe(rows, size), "known")
    firsts = known.filter(F.col("n_words") >= size).groupBy("digest").agg(F.min("doc").alias("doc")).select("doc").filter("doc is not null").distinct()
    firsts = scratch.keep(firsts.withColumn("first", F.lit(True)), "firsts")
    flagged = known.select("doc", "source", "n_words", "digest").join(firsts, "doc", "left")
    flagged = flagged.withColumn("copy", (F.col("n_words") >= size) & F.col("doc").isNotNull() & F.col("first").isNull())
    flagged = scratch.keep(flagged.drop("first"), "flagged")
    several = known.filter("doc is not null").groupBy("doc").agg(F.min("source").alias("low"), F.max("source").alias("high")).filter("low <> high")
    several = scratch.keep(several.select("doc", F.lit(True).alias("several")), "several")
    named = known.select("doc", F.explode("anchors").alias("anchor")).join(firsts.select("doc"), "doc", "left_semi")
    common = scratch.keep(named.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select("anchor"), "common")
    wanted = scratch.keep(named.join(common, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    scratch.drop("known", "firsts", "common")
    variant = F.when(F.col("several"), F.col("source")).otherwise(F.lit(0).cast("long"))
    texts = scratch.keep(rows.join(wanted.join(several, "doc", "left"), "doc").withColumn("variant", variant).drop("several"), "texts")
    scratch.drop("several", "wanted")
    changed, agreed = remove_shared(texts, scratch, size, fingerprints)
    if not agreed:
        changed, _ = remove_shared(texts, scratch, size, exact_fingerprints)
    scratch.drop("texts")
    return flagged, changed


def remove_shared(texts: DataFrame, scratch: Scratch, size: int, prints: Callable) -> tuple[DataFrame, bool]:
    """(doc, source, n_removed, kept_text) of rows that lose windows to an earlier document, and whether all runs agree in their words."""
    windows = scratch.keep(shared_windows(texts, size, prints), "windows")
    owners = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "variant", "place")).alias("o"), F.max("doc").alias("last")).filter("o.doc < last")
    owners = scratch.keep(owners.select("a", "b", F.col("o.doc").alias("owner"), F.col("o.variant").alias("owner_variant"), F.col("o.place").alias("owner_place")), "owners")
    link = F.shiftleft(F.col("place").cast("long"), 32) + F.col("owner_place")
    matches = windows.join(owners, ["a", "b"]).filter("owner < doc").groupBy("doc", "variant", "owner", "owner_variant").agg(F.collect_set(link).alias("links"))
    runs = scratch.keep(segments(matches), "runs")
    scratch.drop("windows", "owners")
    span = F.struct("place", "n")
    lost = runs.groupBy("doc", "variant").agg(F.collect_set(span).alias("spans"))
    owned = runs.select(F.col("owner").alias("doc"), F.col("owner_variant").alias("variant"), F.col("owner_place").alias("place"), "n").groupBy("doc", "variant").agg(F.collect_set(span).alias("owned"))
    asked = lost.join(owned, ["doc", "variant"], "full").select("doc", "variant", *(F.coalesce(x, F.array().cast("array<struct<place:bigint,n:bigint>>")).alias(x) for x in ("spans", "owned")))
    found = scratch.keep(cut(texts.select("doc", "variant", "source", "text").join(asked, ["doc", "variant"]), size), f"changed-{prints.__name__}")
    digests = found.filter("digest is not null").select("doc", "variant", "place", "n", "digest").distinct()
    theirs = digests.toDF("owner", "owner_variant", "owner_place", "n", "theirs")
    bad = runs.join(digests, ["doc", "variant", "place", "n"]).join(theirs, ["owner", "owner_variant", "owner_place", "n"]).filter("digest <> theirs")
    agreed = bad.isEmpty()
    scratch.drop("runs")
    return found.filter("kept_text is not null").select("doc", "source", "n_removed", "kept_text"), agreed


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row. Null or empty text has no words. Keys are whole numbers.

    A row with a null key owns nothing and loses nothing. Rows that repeat a key are each cut at their own places.
    """
    all_docs, changed = find_repeats(docs, key, text, size)
    own = changed.select(F.col("doc").alias("d"), F.col("source").alias("s"), "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")).dropDuplicates(["d", "s"])
    return all_docs.join(own, (F.col("doc") == F.col("d")) & (F.col("source") == F.col("s")), "left").select(
        F.col("doc").alias(key), "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(sha(b""))).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with repeats cut out: a text that loses words is its other words joined by a space; others stay as they are.

    Columns of ``docs`` may have any names; rows may repeat. Keys are whole numbers; a null key owns and loses nothing, a
    null text stays null, an empty table stays empty.
    """
    all_docs, changed = find_repeats(docs, key, text, size)
    copies = all_docs.filter("copy").select("doc", "source", F.lit("").alias("kept_text"))
    new = changed.select("doc", "source", "kept_text").unionByName(copies).dropDuplicates(["doc", "source"])
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("source"))
    joined = whole.join(new, ["doc", "source"], "left")
    return joined.select(*((F.coalesce("kept_text", F.col("row")[c]) if c == text else F.col("row")[c]).alias(c) for c in docs.columns))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS words FROM s),
o AS (SELECT words, min(doc_id) AS owner FROM h GROUP BY words),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN o USING (words) WHERE owner < doc_id),
c AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
