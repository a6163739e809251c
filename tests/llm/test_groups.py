import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genoloom.llm import embeddings, langid, minhash, packing, pst, quality, recompression
from genoloom.llm.queries import VOCABULARY
from genoloom.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, Kept string"


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components_of(keys, texts, width, percent=80):
    sets, least = [sets_of(t, width) for t in texts], list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and keys[i] is not None and keys[j] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)), key=lambda x: (keys[x], x))
                least[b] = a
    return [keys[root(i)] if keys[i] is not None else None for i in range(len(texts))]


def variants(seed, n, words, swaps):
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for place in rng.sample(range(words), swaps[k % len(swaps)]):
            own[place] = f"v{seed}y{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_groups_that_go_through_the_hub_rounds(spark, width):
    """Over AT_ONCE texts share band keys with one another; some are linked by others only, some not at all."""
    texts = variants(1, 300, 150, [0, 2, 4, 7, 9, 12]) + variants(2, 90, 400, [10, 20, 30]) + variants(3, 5, 60, [1])
    order = random.Random(4).sample(range(len(texts)), len(texts))
    keys = [3 * i for i in range(len(texts))]
    df = spark.createDataFrame([(keys[i], texts[i]) for i in order], "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, width=width).collect()}
    want = components_of(keys, texts, width)
    assert {k: got[k].component_id for k in keys} == dict(zip(keys, want, strict=True))
    assert max(Counter(want).values()) > minhash.AT_ONCE and len(set(want)) > 3
    assert all(got[k].n_shingles == len(sets_of(t, width)) for k, t in zip(keys, texts, strict=True))


def test_equal_sets_in_another_order_and_odd_rows(spark):
    line = "one two three four five six seven eight nine ten"
    texts = [f"{line} {line}", f"{line} {line} {line}", line.upper(), line, None, "", "  ", "lone", "LONE", "a b", "other words here and there and so on for a while yet"]
    keys = [*range(9, -1, -1), None]
    rows = [*zip(keys, texts, strict=True), (keys[0], texts[0]), (None, texts[-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(df, width=2).collect()), key=str)
    want = components_of([r[0] for r in rows], [r[1] for r in rows], 2)
    assert got == sorted(((k, c, len(sets_of(t, 2)), k is None or k == c) for (k, t), c in zip(rows, want, strict=True)), key=str)
    named = spark.createDataFrame([("b", line), ("a", line), ("c", "x y z")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(named, width=2).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert minhash.near_duplicates(df.filter("false")).count() == 0


def test_equal_sets_of_few_shingles_are_linked(spark):
    texts = ["a a", "a a a", "A a a a", "b a b", "a b a", "a b a b", "x y z x", "y z x y", "z x y z x", "a", "b", "a b", "aa", None]
    keys = list(range(len(texts)))
    df = spark.createDataFrame([*zip(keys, texts, strict=True)], "doc_id long, text string")
    for width in (2, 5):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width=width).collect()}
        assert got == dict(zip(keys, components_of(keys, texts, width), strict=True))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width=2).collect()} == dict(enumerate([0, 0, 0, 3, 3, 3, 6, 6, 6, 9, 10, 11, 12, 13]))


def test_traversal_takes_all_within_the_slack_in_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        u, v = (np.sort(np.round(rng.random(rng.integers(1, 12)), rng.integers(1, 4))) for _ in range(2))
        slack = float(rng.random() * 2)
        p, q = embeddings.traversed(u.tolist(), v.tolist(), slack)
        sums = [u[i] + v[j] for i, j in zip(p, q, strict=True)]
        assert sums == sorted(sums) and len(set(zip(p, q, strict=True))) == len(p)
        assert set(zip(p, q, strict=True)) == {(i, j) for i in range(len(u)) for j in range(len(v)) if u[i] + v[j] <= u[0] + v[0] + slack}


def test_planted_neighbours_over_many_cells(spark):
    """5,200 vectors of a large and some small labels, each tenth with a neighbour at about the limit."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4_700, 24))
    near = x[:500] + 0.075 * np.linalg.norm(x[:500], axis=1, keepdims=True) / np.sqrt(24) * 1.0 * rng.standard_normal((500, 24)) * 5
    label = [0 if i % 4 else 1 + i % 5 for i in range(4_700)]
    rows = [(i, x[i].astype(np.float32).tolist(), label[i]) for i in range(4_700)] + [(5_000 + i, near[i].astype(np.float32).tolist(), label[i]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = Counter()
    for k in set(label):
        ids = np.array([r[0] for r in rows if r[2] == k])
        m = np.array([r[1] for r in rows if r[2] == k], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        a, b = np.nonzero(m @ m.T >= 0.93)
        want.update(ids[a[a != b]].tolist())
    assert sum(want.values()) > 300
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * sum(want.values())


def test_vectors_at_the_limit_repeated_and_none(spark):
    a, b = [1.0, 0.0], [0.93, float(np.sqrt(1 - 0.93**2))]
    rows = [(1, a, 1), (1, a, 1), (2, b, 1), (3, [0.92, float(np.sqrt(1 - 0.92**2))], 2), (4, a, 2), (None, a, 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    by = {r.vec_id: r for r in got if r.vec_id}
    exact = np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93
    assert len(got) == 6 and by[3].n_links == by[4].n_links == 0 and by[2].n_links == 2 * exact and by[1].n_links == 1 + exact
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def odd_docs(spark):
    prose = " ".join(f"word{i % 97} and more{i % 31}" for i in range(60))
    rows = [(1, "the cat sat on the mat and " + prose, "en"), (2, None, "en"), (None, "the dog sat on the log and " + prose, None), (3, "", None), (3, "x", "en"), (3, "x", "en"), (4, "the bird sang in the tree " * 30, "en")]
    return spark.createDataFrame([(k, t, g, "s", 7, 7, 0.5, "own") for k, t, g in rows], DOCS)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_a_users_columns(spark, stage):
    docs = odd_docs(spark)
    got = stage[1](spark, docs, "")
    assert got.columns == docs.columns
    assert {(r.n_words, r.score, r.Kept, r.source) for r in got.collect()} <= {(7, 0.5, "own", "s")}
    assert stage[1](spark, docs.filter("false"), "").count() == 0


def test_stages_against_their_operators(spark):
    docs = odd_docs(spark)
    judged = quality.rules(docs.select("doc_id", "text")).filter("kept").count()
    assert corpus_pipeline.quality_rules(spark, docs, "").count() == judged > 0
    assert quality.rules(docs).columns[-len(quality.COLUMNS.split(", ")) :] == [x.split()[0] for x in quality.COLUMNS.split(", ")]
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.filter("doc_id is null").count() == 1 and near.count() == docs.count()
    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    assert cut.count() == docs.count() and cut.filter("doc_id = 2").first().text is None
    packed = corpus_pipeline.pack(spark, docs, "")
    assert packed.select("doc_id").distinct().count() == 5 and packed.agg(F.sum("length")).first()[0] == packed.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert packing.pack(docs.filter("false"), VOCABULARY).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    """Each stage by hand on what the one before has kept gives what run gives."""
    rng = random.Random(5)
    stock = {"en": ["the", "cat", "house", "river", "walks", "under", "green", "stone"], "de": ["der", "hund", "haus", "fluss", "geht", "unter", "stein", "grün"]}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(stock[lang]) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(90)), lang))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(100 + i, f"{rows[i][1]} {passage}", rows[i][2]) for i in range(20, 24)]
    rows += [(200, rows[0][1], "en"), (201, rows[1][1] + " tail", "en"), (202, "@@ ## 1 2 3", None), (203, None, "en"), (204, "short text", "en")]
    docs = spark.createDataFrame([(k, t, g, "s", len(t or "")) for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = langid.train(docs.filter(~langid.in_fold("doc_id", 4, 2)))
    one = langid.predict(docs.select("doc_id", "text"), model).filter(f"lang_pred <> 'und' AND bits_per_byte <= {langid.MOST_BITS}").select("doc_id", "text")
    two = quality.rules(one).filter("kept").select("doc_id", "text").collect()
    keys, texts = [r.doc_id for r in two], [r.text for r in two]
    kept = [(k, t) for k, t, c in zip(keys, texts, components_of(keys, texts, 5), strict=True) if k == c]
    assert {200, 201, 202, 203, 204}.isdisjoint(k for k, _ in kept) and len(kept) > 40
    cut = {r.doc_id: r.text for r in recompression.remove_repeats(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    want = packing.pack(spark.createDataFrame(list(cut.items()), "doc_id long, text string"), VOCABULARY).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in want)
    assert sum(passage in t for t in cut.values()) <= 1


def test_pst_blocks_send_one_request_a_bucket(spark, monkeypatch):
    sizes, keep = {}, Scratch.keep

    def counted(self, df, name, *rest):
        kept = keep(self, df, name, *rest)
        sizes[name] = kept.count()
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    texts = [" ".join(f"w{i * j}" for j in range(60)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pst.score(df, df["doc_id"] < 5, order=2, block_bytes=4000).count() == 40
    blocks = -(-sum(len(t) + 64 for t in texts) // 4000)
    # a request a block and bucket, not one a unit, and as many answers
    assert sizes["requests"] == sizes["replies"] <= blocks * -(-blocks // pst.BUCKET_BLOCKS) < 40
