"""Suffix-array repetition rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genoloom.llm import words as W
from genoloom.llm.worker import task

MIN_WORDS = 20
BASE_WINDOW, BASE_PERCENT = 8, 30
MIN_REPEAT, MOST_PERCENT, LONGEST = 12, 20, 200
SYMBOLS = "#*$%&|<>"
FILLED = re.compile("[^\x20\x09-\x0d]")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_words long, longest_repeat long"


def suffix_order(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes by prefix doubling, and the ranks by the first 1, 2, 4, ... symbols.

    Only suffixes that still tie with another are sorted again. ``key`` numbers symbols so that those of different texts
    differ; a suffix that ends ranks before one that goes on.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begin
    levels, step = [rank.copy()], 1
    alone = fresh & np.append(fresh[1:], True)
    active = order[~alone]
    while len(active):
        after = active + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        code = rank[active] * (n + 1) + second
        by = np.argsort(code, kind="stable")
        active, code = active[by], code[by]
        group, at = rank[active], np.arange(len(active))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        fresh = np.concatenate([[True], code[1:] != code[:-1]])
        rank[active] = group + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        levels.append(rank.copy())
        active = active[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return rank, levels


def common_prefixes(rank: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the common prefix length of each suffix with the one before it in that order."""
    n = len(rank)
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    tied = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    x, y, long = array[tied - 1].copy(), array[tied].copy(), np.zeros(len(tied), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = (x < n) & (y < n) & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        long += same.astype(np.int64) << j
        x, y = x + (same.astype(np.int64) << j), y + (same.astype(np.int64) << j)
    lcp[tied] = long
    return array, lcp


def repeats(key: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that is found elsewhere in its text too.

    That is the depth of the deepest interval of common prefixes that holds the suffix.
    """
    if not len(key):
        return np.zeros(0, np.int64)
    array, lcp = common_prefixes(*suffix_order(key))
    deepest = np.empty(len(key), np.int64)
    deepest[array] = np.maximum(lcp, np.append(lcp[1:], 0))
    return deepest


def covered(deepest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in the union of the repeated spans of at least ``least`` words."""
    at = np.flatnonzero(deepest >= least)
    edge = np.zeros(len(deepest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + deepest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def line_copies(text: str) -> int:
    lines = [x for x in text.split("\n") if FILLED.search(x)]
    return len(lines) - len(set(lines))


def judge(text: pa.Array, min_repeat: int = MIN_REPEAT, most_percent: int = MOST_PERCENT, longest: int = LONGEST) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for a batch of texts."""
    out: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_repeat_words", "repeat_words", "longest_repeat")}
    for chunk in W.chunks(text):
        w, rows = W.split(chunk), len(chunk)
        deepest = repeats(w.row * (1 + int(w.number.max(initial=0))) + w.number)
        most = np.zeros(rows, np.int64)
        np.maximum.at(most, w.row, deepest)
        lead = np.concatenate([[0], np.cumsum(((chunk.data & 0xC0) != 0x80) & ~W.SPACE[chunk.data])])
        out["n_words"].append(w.count)
        out["word_chars"].append(lead[chunk.offsets[1:]] - lead[chunk.offsets[:-1]])
        out["n_repeat_words"].append(np.bincount(w.row, covered(deepest, BASE_WINDOW), rows).astype(np.int64))
        out["repeat_words"].append(np.bincount(w.row, covered(deepest, min_repeat), rows).astype(np.int64))
        out["longest_repeat"].append(np.where(most >= min_repeat, most, 0))
    got = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    texts = [x or "" for x in text.to_pylist()]
    got["n_symbols"] = np.array([sum(map(x.count, SYMBOLS)) for x in texts], np.int64)
    got["n_dup_lines"] = np.array([line_copies(x) for x in texts], np.int64)
    got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > BASE_PERCENT * got["n_words"])
    got["kept"] = ~got["base_failed"] & (100 * got["repeat_words"] <= most_percent * got["n_words"]) & (got["longest_repeat"] <= longest)
    return got


def rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, most_percent: int = MOST_PERCENT, longest: int = LONGEST, text: str = "text") -> DataFrame:
    """Each row of ``docs`` with the counts and the verdict of COLUMNS, which replace columns of the same names.

    A text fails the base rules with fewer than MIN_WORDS words or with over BASE_PERCENT of its words in repeated
    8-word windows. It fails the suffix-array rules when repeated substrings of ``min_repeat`` words or more cover over
    ``most_percent`` of its words or the longest of them has over ``longest`` words. Null text counts as empty: zero
    words, not kept. No shuffle: a text is judged where it is read, so no source or group can be hot.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    docs = W.without(docs, names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(batch.column(text), min_repeat, most_percent, longest)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[n]) for n in names)], [*batch.schema.names, *names])

    return docs.mapInArrow(task("quality", run), schema)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spans AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w
  FROM d, (VALUES (8), (12), (201)) s(size) WHERE len(w) >= size),
hashed AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words FROM spans),
twice AS (SELECT doc_id, size, unnest(list(i)) AS i FROM hashed GROUP BY doc_id, size, words HAVING count(*) > 1),
cover AS (
  SELECT doc_id, size, count(DISTINCT j) AS n FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS j FROM twice) GROUP BY doc_id, size),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS repeat_words, c.n IS NOT NULL AS too_long
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cover a ON a.doc_id = d.doc_id AND a.size = 8
    LEFT JOIN cover b ON b.doc_id = d.doc_id AND b.size = 12 LEFT JOIN cover c ON c.doc_id = d.doc_id AND c.size = 201)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * repeat_words > 20 * n_words OR too_long) AS kept, repeat_words
FROM counts
"""
