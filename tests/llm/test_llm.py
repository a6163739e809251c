import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from genoloom.llm import bpe, bytetrie, chat, components, embeddings, langid, minhash, packing, pst, quality, recompression, scratch, warc, words
from genoloom.llm.queries import VOCABULARY

ODD = [None, "", " \n\t", "one", "a b", "é ñ ü", "x " * 3000, "\x1c\x85 ½ 👍🏽 <|endoftext|>b", "A a A a", "A a A a"]
DOC = "doc_id long, text string, lang string, score double, kept string"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, 0.0, "x") for i, t in enumerate(texts)], DOC)


def prose(seed, n, stock=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


def test_words():
    column = pa.array(ODD)
    for chunk in words.chunks(column, 5):
        w = words.split(chunk, lower=True)
        for i in range(len(chunk)):
            text = (ODD[chunk.first + i] or "").encode()
            assert w.rows[i] == text.lower().split() and w.count[i] == len(w.rows[i]) == (w.row == i).sum()


def thue_morse(n):
    """Two texts of 2 ** n letters that every polynomial hash modulo 2 ** 64 takes for one another."""
    a = "a"
    for _ in range(n):
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def test_hashes_of_patterns():
    a, b = thue_morse(11)
    for texts, size in (([a, b], 1), ([" ".join(a), " ".join(b)], 2048), ([" ".join(a[:32]), " ".join(b[:32])], 32)):
        found = [words.split(chunk) for chunk in words.chunks(pa.array(texts), 1)]
        for values in ([w.hash for w in found], [w.other for w in found]):
            assert len({int(words.windows(x, size)[0]) for x in values}) == 2
    x = np.random.default_rng(1).integers(0, 4, 300).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 50):
        by_hash, by_value = {}, {}
        for i, h in enumerate(words.windows(x, size).tolist()):
            own = tuple(x[i : i + size].tolist())
            assert by_hash.setdefault(h, own) == own and by_value.setdefault(own, h) == h


def naive_repeats(tokens):
    out = []
    for i in range(len(tokens)):
        best = 0
        for j in range(len(tokens)):
            n = 0
            while i != j and i + n < len(tokens) and j + n < len(tokens) and tokens[i + n] == tokens[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_against_brute_force(seed):
    rng = random.Random(seed)
    text = [rng.randrange(3) for _ in range(rng.randrange(1, 60))] + [7, 8, 9] * rng.randrange(4)
    assert quality.repeats(np.array(text)).tolist() == naive_repeats(text)


def test_quality_odd_rows(spark):
    got = quality.rules(docs(spark, ODD)).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [len((x or "").encode().split()) for x in ODD]
    assert not any(r.kept for r in got) and got[6].longest_repeat == 2999
    assert quality.rules(docs(spark, [])).count() == 0


def test_language_id(spark):
    texts = ["the cat and the dog are here"] * 20 + ["der hund und die katze sind hier"] * 20 + [None, "12 34", ""]
    df = docs(spark, texts, ["en"] * 20 + ["de"] * 20 + [None, "en", "en"])
    got = langid.predict(df, langid.train(df)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en"] * 20 + ["de"] * 20 + ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got)
    empty = langid.train(df.filter("false"))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_ppm_code_lengths_against_brute_force(spark):
    texts, order = ["abracadabra banana", "a band and a cab"], 2
    df = docs(spark, texts, ["x", "x"])
    model = langid.train(df, order, 0.0)
    counts = Counter()
    for t in texts:
        padded = " " * order + t
        counts.update((padded[i - k : i], padded[i]) for i in range(order, len(padded)) for k in range(order + 1))
    def bits(context, symbol):
        own = {s: n for (c, s), n in counts.items() if c == context}
        total = sum(own.values()) + len(own)
        if symbol in own:
            return -np.log2(own[symbol] / total)
        below = bits(context[1:], symbol) if context else 8.0
        return below - (np.log2(len(own) / total) if own else 0)
    for t in ["bandana", "zebra", "a"]:
        padded = " " * order + t
        want = sum(bits(padded[i - order : i], padded[i]) for i in range(order, len(padded)))
        assert model.bits(pa.array([t]))[0][0, 0] == pytest.approx(want, rel=1e-5)


def test_pst_base_and_distribution(spark):
    texts = [" ".join(prose(i, 30, 20)) for i in range(40)] + ODD
    df = docs(spark, texts)
    held = langid.in_fold("doc_id", 7, 2)
    got = {r.doc_id: r for r in pst.score(df, held).collect()}
    learned = [pst.tokens(texts[i]) for i, r in got.items() if not r.held_out]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        own = pst.tokens(texts[i])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)) and r.score < 0
    assert pst.score(docs(spark, []), held).count() == 0


def brute_tree(texts, order, support):
    """log10 probability of a text by a suffix tree kept in dictionaries."""

    def symbols(text):
        before = b""
        for w in pst.tokens(text):
            spelt = b"\xff" if w == pst.END_WORD else w + b" "
            for i, s in enumerate(spelt):
                seen = before[-pst.TAIL :] + b" " + spelt[:i] if i < pst.HEAD else spelt[:i]
                yield (*[32] * order, *seen)[-order:], s
            before = w

    total, following = Counter(), Counter()
    for t in texts:
        for c, s in symbols(t):
            for k in range(order + 1):
                total[c[order - k :]] += 1
                following[c[order - k :], s] += 1

    def chance(context, symbol):
        if not context:
            return (following[(), symbol] + 0.5) / (total[()] + 128)
        before = chance(context[1:], symbol)
        return (following[context, symbol] + pst.PRIOR * before) / (total[context] + pst.PRIOR)

    kept, seen = {()}, {s for _, s in following}
    for c in [c for c, n in total.items() if c and n >= support]:
        share = {s: following[c, s] / total[c] for s in seen if following[c, s]}
        if sum(x * np.log2(x / chance(c[1:], s)) for s, x in share.items()) >= pst.DIVERGENCE:
            kept |= {c[i:] for i in range(len(c))}
    return lambda t: sum(np.log10(chance(next(c[order - k :] for k in range(order, -1, -1) if c[order - k :] in kept), s)) for c, s in symbols(t))


@pytest.mark.parametrize("order, support", [(3, 8), (6, 2)])
def test_pst_against_brute_force(spark, order, support):
    texts = [" ".join(prose(i, 40, 60)) + " banana Bandana " + "é" * (i % 3) for i in range(50)] + ["unheard quixotry é ", "\xff", *ODD]
    df = docs(spark, texts).repartition(3)
    held = df["doc_id"].between(45, 53)
    log = brute_tree([t for i, t in enumerate(texts) if not 45 <= i <= 53], order, support)
    for r in pst.score(df, held, order=order, support=support, block_bytes=2000).collect():
        assert r.score == pytest.approx(log(texts[r.doc_id]), rel=1e-9)


def brute_removed(texts, size):
    rows = [(t or "").encode().split() for t in texts]
    owner = {}
    for i, r in enumerate(rows):
        for a in range(len(r) - size + 1):
            owner.setdefault(tuple(r[a : a + size]), i)
    out = []
    for i, r in enumerate(rows):
        gone = {p for a in range(len(r) - size + 1) if owner[tuple(r[a : a + size])] < i for p in range(a, a + size)}
        out.append((len(gone), recompression.sha(b" ".join(w for p, w in enumerate(r) if p not in gone))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_recompression_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [prose(100 + i, 70) for i in range(3)] + [["z"] * 120, ["p", "q"] * 60]
    texts = []
    for i in range(30):
        parts = [prose(1000 * seed + i, rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 40)
            parts += [s[a : a + rng.randrange(40, 121)], prose(rng.random(), rng.randrange(9))]
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[3], texts[4] + " more", *ODD]
    got = recompression.digests(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == brute_removed(texts, 50)
    out = recompression.remove_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == list(range(len(texts))) and out[0].lang is None


def test_bpe_against_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = [*ODD, "Don't I'LL ΣΑΣ İ ẞ x² !'s 12 3½", "aaaaaaaaaaaa aaa"]
    got = bpe.tokens(docs(spark, texts), VOCABULARY).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs(spark, []), VOCABULARY).count() == 0
    rng = random.Random(9)
    ranges = [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x500), (0x900, 0x980), (0x1100, 0x1200), (0x1E00, 0x2100), (0xAC00, 0xAC40), (0xF900, 0xFB50), (0x1F300, 0x1F700), (9, 32)]
    fuzz = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    for own in (bpe.encoder(VOCABULARY)[0], packing.library_encoder(VOCABULARY)):
        for text, ids in zip(fuzz, own.rows(fuzz), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    got = bpe.digests(docs(spark, texts + fuzz[:300]), VOCABULARY).orderBy("doc_id").collect()
    for text, r in zip(texts + fuzz[:300], got, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(want), bpe.sha(" ".join(map(str, want))), bpe.sha(library.decode(want, skip_special_tokens=False)))


def test_packing(spark):
    texts = [*ODD, *(" ".join(prose(i, 40 * i)) for i in range(30))]
    library = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs(spark, texts), VOCABULARY, capacity=512, with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
    assert [x for _, x in sorted((r.doc_id, r.ids_crc32) for r in rows)] == [x for _, x in sorted((r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)]
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.length for r in rows) > 0.9 * 512 * (len(sequences) - 1)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_against_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 65) for _ in range(200)]
    window, offset = packing.best_fit(lengths, 64)
    left, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [x for x in left if x >= lengths[i]]
        want[i] = min(fit) if fit else 64
        left.remove(min(fit)) if fit else None
        left.append(want[i] - lengths[i])
    assert offset == [64 - want[i] for i in range(len(lengths))] and len(set(window)) == len(left)


def test_warc(spark):
    big = "x" * 150 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(3, "http://b.org/x?q=1", big), (1, None, big), (2, "https://www.a.com/", "é" * 80), (4, "http://b.org:8080/", None), (5, "bad\r\nurl", ""), (6, "http://[bad", big), (7, "http://a.com/", "é" * 80)]
    got = warc.capture_history(spark.createDataFrame(pages, "page_id long, url string, html string"), records=2).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("revisit", 1), 7: ("revisit", 2)}
    keys = [(r.url_key, r.capture_time, r.page_id) for r in got]
    assert keys == sorted(keys) and len(got) == 7
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(9))) for _ in range(k)]
    got = list(warc.LoserTree([iter([(x, x) for x in r]) for r in runs]))
    assert got == sorted(got) and len(got) == sum(map(len, runs))


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, "end"), (None, 70, "ann", "é"), (None, 2, "cy", "b")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.participant, r.chunk) for r in got) == [(0, "ann", 0), (0, "cy", 0)] + [(1, p, 0) for p in ("ann", "bob", "unknown")]
    one = next(r for r in got if r.conv_id == 1 and r.participant == "bob" and r.chunk == 0)
    assert one.rendered == "<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2 + "<|im_start|>user name=unknown\nend<|im_end|>\n"
    assert [one.rendered[a:b] for a, b in zip(one.mask_starts, one.mask_ends, strict=True)] == ["<|im_end|>\n"] * 2


def classes(n, links):
    own = list(range(n))
    for _ in range(n):
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
    return own


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 20)] + [(30, 25), (25, 40), (7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), scratch.Scratch(spark, "t")).collect()
    want = classes(41, links)
    assert {r.node: r.component for r in got} == {i: want[i] for x in links for i in x if i != want[i]}
    rng = random.Random(4)
    links = [(rng.randrange(500), rng.randrange(500)) for _ in range(240)] + [(600 + (7 * i) % 90, 600 + (7 * i + 7) % 90) for i in range(80)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), scratch.Scratch(spark, "t")).collect()
    want = classes(700, links)
    assert sorted((r.node, r.component) for r in got) == [(i, w) for i, w in enumerate(want) if i != w]
    assert components.components(spark.createDataFrame([], "a long, b long"), scratch.Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_against_brute_force(spark, width):
    rng = random.Random(width)
    texts = list(ODD)
    for g in range(4):
        base = prose(g, 120)
        for _ in range(25 if g == 0 else 6):
            copy = list(base)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy).upper())
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = classes(len(texts), links)
    got = minhash.near_duplicates(docs(spark, texts), width).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want, strict=True))]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + 0.05 * rng.standard_normal(16)], i % 3 % 2) for i in range(200)]
    rows += [(200, rows[5][1], rows[5][2]), (201, rows[5][1], None), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [1.0, 2.0], 1), (206, [None] * 16, 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("vec_id").collect()
    x = {i: np.float32(v).astype(float) for i, v, label in rows if i <= 200}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    label = {r[0]: r[2] for r in rows}
    links = [(i, j) for i in unit for j in unit if j < i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93]
    n, want = Counter(x for link in links for x in link), classes(207, links)
    found = sum(r.n_links for r in got) / max(1, sum(n.values()))
    assert found >= 0.99 and all(r.n_links <= n[r.vec_id] for r in got) and [r.n_links for r in got[201:]] == [0] * 6
    assert [r.component_id for r in got] == want


def test_trie_sums():
    assert bytetrie.sum_by_row(np.arange(5.0), np.array([2, 0, 3])).tolist() == [1, 0, 9]


def test_rotation_of_a_hot_dialogue(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("cast(null as long) AS conv_id", "64 * id AS turn", "concat('p', id % 4) AS role", "'x' AS text")
    rows = rows.union(spark.sql("SELECT 5L, 1L, 'ann', 'y'")).union(spark.sql("SELECT 5L, null, 'bob', 'z'"))
    got = chat.rotate(rows)
    hot = got.filter("conv_id is null").selectExpr("count(*)", "count(distinct participant, chunk)", "min(chunk)", "max(chunk)", "bool_and(64 * chunk = first_message AND (n_messages = 64 OR chunk = 312))", "min(n_chunks)", "max(n_chunks)", "sum(size(mask_starts))").first()
    assert tuple(hot) == (4 * 313, 4 * 313, 0, 312, True, 313, 313, n)
    assert sorted((r.participant, r.chunk, r.n_chunks, r.n_messages) for r in got.filter("conv_id = 5").collect()) == [(p, 0, 1, 2) for p in ("ann", "bob")]


def test_pipeline_near_dedup_keeps_null_ids(spark):
    text = " ".join(prose(1, 60))
    rows = [(1, text), (2, text), (None, text), (None, "other words"), (3, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, text), (0, text), (0, "other words"), (3, "")])


def test_recompression_of_repeated_ids(spark):
    shared, other = prose(1, 70), prose(2, 60)
    long, short = [*prose(3, 200), *shared], [*shared[:55], "own"]
    texts = [(1, shared), (2, long), (2, short), (2, ["a", "b"]), (3, [*shared, "end"]), (3, [*shared, "end"]), (4, other), (5, other), (5, [*other, "x"]), (6, shared), (6, ["few"])]
    kept = [shared, prose(3, 200), ["own"], ["a", "b"], ["end"], ["end"], other, [], ["x"], [], ["few"]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = recompression.digests(rows).collect()
    want = [(i, len(t), len(t) - len(k), recompression.sha(" ".join(k).encode())) for (i, t), k in zip(texts, kept, strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, recompression.remove_repeats(rows).collect())) == sorted((i, " ".join(k)) for (i, _), k in zip(texts, kept, strict=True))
