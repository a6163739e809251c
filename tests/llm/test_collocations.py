import random
import re
from collections import Counter

import pytest

from genoloom.llm import collocations


def brute(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        frequent = {g: a for g, a in own.items() if a >= least and len(g) > 1}
        found = []
        for g, a in frequent.items():
            if any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in frequent.items()):
                continue
            score, cut = min((1000 * a * totals[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), own[g[:cut]], own[g[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    stock = ["a", "The", "the", "b\tc", "d  e", "É", "é", "x\x1cy", "nbsp here", "zz", "w0", "w1", "w2"]
    fixed = ["in the end of it", "New York", "a a a a a a"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(stock, k=rng.randrange(7))) for _ in range(rng.randrange(6))]
        rows.append((rng.choice(["de", "en", None, "und", ""]), rng.choice([". ", ",", "\n", "\r\n", " ! ", "\v", " "]).join(parts)))
    return rows + [(None, None), ("en", ""), ("fr", " \t\n.,"), ("en", "long tail " * 3000), (None, "once")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, block_bytes):
    rows = corpus(block_bytes, 400)
    df = spark.createDataFrame([(i, x, lang, "c", 1) for i, (lang, x) in enumerate(rows)], "doc_id long, text string, lang string, piece string, N int")
    got = sorted(map(tuple, collocations.mine(df, least=8, block_bytes=block_bytes).collect()))
    want = brute(rows, 8)
    assert got == want and len({r[0] for r in got}) >= 3


def test_top_and_empty_tables(spark):
    rows = corpus(9, 300)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, collocations.mine(df, least=5, top=3).collect()))
    assert got == brute(rows, 5, top=3) and {r[1] for r in got} == {1, 2, 3}
    assert collocations.mine(df.filter("false")).count() == 0
    assert collocations.mine(df.filter("text = ''")).count() == 0


def test_scores_beyond_64_bits(spark):
    found = spark.sql("SELECT CAST(1000 AS DECIMAL(4,0)) * CAST(900000000000 AS DECIMAL(18,0)) * CAST(800000000001 AS DECIMAL(18,0)) AS up, CAST(900000000000 AS DECIMAL(18,0)) * CAST(900000000007 AS DECIMAL(18,0)) AS down")
    assert found.selectExpr("up div down AS score").first()[0] == 1000 * 900000000000 * 800000000001 // (900000000000 * 900000000007)


def test_blocks_and_multiplicities(spark):
    df = spark.createDataFrame([("en", "one two. One two\tthree, one two")] * 50, "lang string, text string")
    pieces = collocations.distinct_pieces(df, block_bytes=8)
    assert sorted((r.piece, r.n) for r in pieces.collect()) == [("one two", 100), ("one two\tthree", 50)]
