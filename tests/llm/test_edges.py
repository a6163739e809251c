"""Nulls, ties, repeated rows, clashing columns and long texts for the operators whose tests lie elsewhere."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from genoloom.llm import bpe, langid, packing, pst, quality, recompression, warc
from genoloom.llm.queries import VOCABULARY
from genoloom.llm.words import CHUNK_BYTES


def test_warc_at_the_least_payload_with_repeated_and_null_ids(spark):
    html = [("é" * 49 + "x"), ("é" * 49 + "xy"), "z" * 100, None, ""]
    rows = [(5, "u", html[0]), (6, "u", html[0]), (9, "u", html[1]), (8, None, html[1]), (8, None, html[1]), (None, "u", html[2]), (7, "u", html[2]), (None, "u", None), (1, "u", html[3]), (2, "u", html[4])]
    assert len(html[0].encode()) == 99 and len(html[1].encode()) == 100
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, Record_Type string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.capture_history(df).collect()), key=str)
    want = []
    for page, _, text in rows:
        body = (text or "").encode()
        ids = [p for p, _, t in rows if (t or "").encode() == body and p is not None]
        revisit = len(body) >= 100 and page != min(ids)
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    assert got == sorted((w if w[0] is not None else g for w, g in zip(sorted(want, key=str), got, strict=True)), key=str)
    assert warc.capture_history(df.filter("false")).count() == 0


def test_quality_of_repeated_rows_long_texts_and_other_case(spark):
    long = " ".join(f"w{i % 5_003}" for i in range(CHUNK_BYTES // 3))
    rows = [(1, long, 3), (1, long, 3), (2, "a b " * 30, 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT int")
    got = quality.rules(df).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [CHUNK_BYTES // 3] * 2 + [60, 0] and got[0] == got[1]
    assert [f for f in got[0].__fields__ if f.lower() == "kept"] == ["kept"] and not got[2].kept


def test_language_ties_and_repeated_rows(spark):
    rows = [("same words here", "b"), ("same words here", "a")] * 10
    df = spark.createDataFrame([(i, t, g, 0) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, SCORE int")
    got = langid.predict(df, langid.train(df)).collect()
    assert {r.lang_pred for r in got} == {"a"} and all(r.score == pytest.approx(0.5, abs=1e-3) for r in got) and len(got) == 20


def test_suffix_tree_with_repeated_and_null_keys(spark):
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "one two"), (None, None)] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, SCORE int")
    got = pst.score(df, langid.in_fold("doc_id", 7, 2)).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {sum(len(pst.tokens(t)) for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2)}
    assert len({round(r.score, 9) for r in got if r.doc_id == 1 and r.n_tokens == 3}) == 1


def test_recompression_with_null_keys_other_columns_and_a_forced_collision(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(3, f"x y {passage} z"), (2, f"{passage} q"), (None, passage), (None, f"a {passage}"), (4, "short"), (5, None), (6, f"{passage[:-4]} other end {passage}")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, PLACE int")

    def want():
        out, seen = [], {}
        words = [(k, (t or "").split()) for k, t in rows]
        for k, w in words:
            for i in range(len(w) - 49):
                seen.setdefault(tuple(w[i : i + 50]), []).append(k)
        for k, w in words:
            gone = {j for i in range(len(w) - 49) if k is not None and any(o is not None and o < k for o in seen[tuple(w[i : i + 50])]) for j in range(i, i + 50)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        return sorted(out, key=str)

    got = sorted(map(tuple, recompression.digests(df).collect()), key=str)
    assert got == want()
    cut = recompression.remove_repeats(df)
    assert cut.columns == df.columns and {(r.source, r.PLACE) for r in cut.collect()} == {("c", 1)}

    def alike(w, start, size=50):
        return np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)

    monkeypatch.setattr(recompression, "fingerprints", alike)
    assert sorted(map(tuple, recompression.digests(df).collect()), key=str) == got


def test_encoders_on_repeated_ids_and_long_texts(spark):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    long = "Größe und 12 Dinge, " * 20_000
    rows = [(1, long), (1, long), (1, "b"), (None, "b"), (None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, IDS int")
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = sorted((k or -1, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for (k, _), x in zip(rows, ids, strict=True))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in bpe.digests(df, VOCABULARY).collect()) == want
    assert [f.lower() for f in bpe.tokens(df, VOCABULARY).columns].count("ids") == 1
    packed = packing.pack(df, VOCABULARY).collect()
    assert sum(r.length for r in packed) == sum(len(x) + 1 for x in ids)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
