"""Sweeps over ranges, greedy choices, trees and sequences against brute force."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from genoloom.functions import distance as D
from genoloom.functions import text as X
from genoloom.operators import compare as P
from genoloom.operators import intervals as I
from genoloom.operators import somatic as S
from genoloom.operators import tree as T
from genoloom.operators import weights as W
from genoloom.sources import fasta, files, packages, tables, vcf


def spans(seed, n, top, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(top)
        out.append((rng.choice("ab") if rng.random() < 0.95 else None, s, s + rng.randrange(longest), i, rng.choice("xyz"), rng.choice([-2.0, 0.0, 1.0, 3.0, 0.5])))
    return out


SCHEMA = "k string, s long, e long, id long, t string, w double"


@pytest.fixture(params=[1, 7])
def ranges(request, spark):
    """One range, or several, so that keys reach over their borders."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_more_rows_lie_in_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(files, "RANGE_ROWS", 20)
    rows = [r for r in spans(11, 400, 900, 12) if r[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    ranged = files.by_range(df, ["k", "s"])
    assert ranged.select("part").distinct().count() > 4 and max(r["count"] for r in ranged.groupBy("part").count().collect()) < 60
    over = points(rows)
    assert {(r.k, r.s, r.e) for r in I.merge(df, ["k"]).collect()} == runs(over)
    assert {(r.k, p): r.depth for r in I.depth(df, ["k"]).collect() for p in range(r.s, r.e + 1)} == {at: len(x) for at, x in over.items()}


def points(rows, keep=lambda r: True):
    out = {}
    for r in filter(keep, rows):
        for p in range(r[1], r[2] + 1):
            out.setdefault((r[0], p), []).append(r)
    return out


def runs(places):
    """(k, s, e) of runs of consecutive places."""
    out = []
    for k, p in sorted(places, key=lambda x: (x[0] or "", x[1])):
        if out and out[-1][0] == k and out[-1][2] == p - 1:
            out[-1][2] = p
        else:
            out.append([k, p, p])
    return {tuple(x) for x in out}


def test_sweeps_over_ranges(spark, ranges):
    rows = spans(1, 300, 900, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    over = points(rows)
    assert {tuple(r) for r in I.merge(df, ["k"]).collect()} == runs(over)
    got = I.depth(df, ["k"]).collect()
    assert {(r.k, p): r.depth for r in got for p in range(r.s, r.e + 1)} == {x: len(v) for x, v in over.items()}
    assert sum(r.e - r.s + 1 for r in got) == len(over)
    a, b = df.filter("t = 'x'"), df.filter("t = 'y'")
    pa, pb = points(rows, lambda r: r[4] == "x"), points(rows, lambda r: r[4] == "y")
    for op, want in ((I.intersect, pa.keys() & pb.keys()), (I.difference, pa.keys() - pb.keys()), (I.union, pa.keys() | pb.keys())):
        assert {tuple(r) for r in op(a, b, ["k"]).collect()} == runs(want)
    for r in W.weighted_segments(df, ["k"], "w").collect():
        own = over[r.k, r.s]
        product = 1.0
        for x in own:
            product *= x[5]
        assert (r.n, r.total) == (len(own), sum(x[5] for x in own)) and r.product == pytest.approx(product, rel=1e-12)
        assert r.density == pytest.approx(sum(x[5] * (x[2] - x[1] + 1) for x in own) / (r.e - r.s + 1))


def test_an_island_over_several_ranges(spark, ranges):
    rows = [("a", 0, 5_000, 0, "x", 1.0)] + [("a", i, i, i, "x", 1.0) for i in range(0, 9_000, 7)] + [("a", 2_000, 8_500, 1, "x", 1.0)]
    got = {tuple(r) for r in I.merge(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()}
    assert got == runs(points(rows))


def test_overlaps_meet_near_their_own_length(spark):
    rows = [r for r in spans(2, 400, 100_000, 300) if r[0]] + [("a", 5, 90_000, 900, "x", 1.0), ("b", 0, 60_000, 901, "y", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.a_id, r.b_id) for r in I.overlaps(df, df, ["k"]).collect())
    assert got == sorted((a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    touching = {tuple(r) for r in I.touching(df.filter("t = 'x'"), df.filter("t = 'y'"), ["k"]).collect()}
    assert touching == {a[:3] for a in rows for b in rows if a[4] == "x" and b[4] == "y" and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]}


def test_partners_of_rows_with_null_ids(spark):
    a = spark.createDataFrame([("c", 1, 10, None), ("c", 50, 60, None), (None, 1, 10, 3)], "k string, s long, e long, id long")
    b = spark.createDataFrame([("c", 1, 10, None)], "k string, s long, e long, id long")
    for r in (0.5, None):
        assert [x.s for x in P.matched(a, b, ["k"], r, "left_semi").collect()] == [1]
        assert sorted((x.s, x.k) for x in P.matched(a, b, ["k"], r, "left_anti").collect()) == [(1, None), (50, "c")]


def test_log_scale_where_it_has_no_value(spark):
    parts = spark.createDataFrame([("c", 0, 4, 0.0), ("c", 5, 9, 2.0)], "k string, s long, e long, total double")
    assert [r.weight for r in W.scaled(parts, "log", 1.0, 10.0).collect()] == [1.0, 1.0]
    assert [r.weight for r in W.scaled(parts.filter("s > 0"), "log", 1.0, 10.0).collect()] == [1.0]


def test_majority_against_brute_force(spark, ranges):
    rows = [r for r in spans(3, 200, 300, 30) if r[0]]
    rows = [(*r[:3], r[3] % 40, *r[4:]) for r in rows]
    over = points(rows)
    for r in W.majority(spark.createDataFrame(rows, SCHEMA), ["k"], "t", "id", 1, 99).collect():
        own = {t: len({x[3] for x in over[r.k, r.s] if x[4] == t}) for t in {x[4] for x in over[r.k, r.s]}}
        assert r.weight == sum(own.values()) and r.major == max((n, t) for t, n in own.items())[1]


def test_greedy_choices_equal_a_sequential_pass(spark):
    rows = [r for r in spans(4, 250, 600, 25) if r[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    often = {(k, t): sum(r[0] == k and r[4] == t for r in rows) for k in "ab" for t in "xyz"}
    md5 = {r.id: r.h for r in df.select("id", F.md5(F.col("id").cast("string")).alias("h")).collect()}

    def one_by_one(order, most=1 << 30):
        taken = []
        for r in sorted(rows, key=order):
            if not any(x[0] == r[0] and x[1] <= r[2] and r[1] <= x[2] for x in taken):
                taken.append(r)
        return {r[3] for k in "ab" for r in [x for x in taken if x[0] == k][:most]}

    assert {r.id for r in S.without_conflicts(df, ["k"]).collect()} == one_by_one(lambda r: (often[r[0], r[4]], md5[r[3]], r[3]))
    assert {r.id for r in S.first_disjoint(df, ["k"], F.col("s"), 5).collect()} == one_by_one(lambda r: (r[1], r[3]), 5)
    alone = df.limit(1)
    assert S.without_conflicts(alone, ["k"]).count() == 1 and S.without_conflicts(df.limit(0), ["k"]).count() == 0


def test_greedy_choices_over_piles_form_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("a", s, s + rng.choice([3, 40, 40, 700, 9000]), i, rng.choice("xyz")) for i, s in enumerate(rng.randrange(3000) for _ in range(700))]
    rows += [("b", 5, 9, 1000 + i, "x") for i in range(300)] + [(None, 5, 9, 2000, "x"), (None, 6, 9, 2001, "x")]
    df, met, plain = spark.createDataFrame(rows, "k string, s long, e long, id long, t string"), [], I.overlaps

    def counted(left, right, keys):
        met.append(plain(left, right, keys).count())
        return plain(left, right, keys)

    monkeypatch.setattr(S.I, "overlaps", counted)
    taken = []
    for r in sorted(rows, key=lambda r: (r[3] * 7919 % 1009, r[3])):
        if r[0] is None or not any(x[0] == r[0] and x[1] <= r[2] and r[1] <= x[2] for x in taken):
            taken.append(r)
    got = S.first_disjoint(df, ["k"], F.col("id") * 7919 % 1009, 1 << 20).collect()
    assert {r.id for r in got} == {r[3] for r in taken}
    assert sum(met) < 20 * len(rows)


def test_inherited_genotypes_in_a_pile_form_few_pairs(spark):
    rng = random.Random(9)
    outer = [(rng.choice("ab"), s, s + rng.choice([0, 3, 60, 60, 60, 900]), i, f"{i}|{i % 2}") for i, s in enumerate(rng.randrange(2000) for _ in range(1500))]
    inner = [(rng.choice("abc"), s, s + rng.choice([0, 50, 400]), i) for i, s in enumerate(rng.randrange(2200) for _ in range(200))]
    out = spark.createDataFrame(outer, "k string, s long, e long, id long, gt string")
    got = dict(map(tuple, S.inherited_genotypes(spark.createDataFrame(inner, "k string, s long, e long, id long"), out, ["k"]).collect()))
    for k, s, e, i in inner:
        assert got[i] == max(((r[3], r[4]) for r in outer if r[0] == k and r[1] <= e and s <= r[2]), default=(0, "0|0"))[1]
    pile = spark.range(2000).selectExpr("'a' AS k", "id % 50 AS s", "id % 50 + 300 AS e", "id")
    assert S.unhidden(pile, ["k"], "id").count() < 120


def test_events_split_over_genes(spark):
    events = spark.createDataFrame([("a", 0, 100, 1), ("a", 90, 120, 2), ("a", 500, 510, 3)], "k string, s long, e long, id long")
    genes = spark.createDataFrame([("a", 10, 20, "g"), ("a", 95, 99, "h"), ("a", 118, 130, "i"), ("b", 0, 9, "j")], "k string, s long, e long, symbol string")
    got = sorted(map(tuple, S.split_over_genes(events, genes, ["k"]).collect()))
    # h is touched by both events and is the first gene of the second
    assert got == [("a", 10, 20, 1, "g"), ("a", 95, 99, 2, "h"), ("a", 118, 130, 2, "i"), ("a", 500, 510, 3, None)]


def test_nearest_length_over_ranges(spark, ranges):
    rng = random.Random(5)
    wanted, given = [(i, rng.randrange(1, 900)) for i in range(200)], sorted({rng.randrange(1, 900) for _ in range(25)})
    got = dict(map(tuple, S.nearest_length(spark.createDataFrame(wanted, "id long, n long"), spark.createDataFrame([(x,) for x in given], "n long"), "id", "n").collect()))
    for i, n in wanted:
        best = min(given, key=lambda x: (abs(x - n), -x))
        assert got[i] == (best if 2 * best >= n else None)


def test_trees(spark):
    rng = random.Random(6)
    parent = {i: rng.randrange(i) for i in range(1, 120)}
    edges = spark.createDataFrame(list((p, c) for c, p in parent.items()), "parent long, child long")
    want = []
    for n in range(120):
        at, d = n, 0
        while True:
            want.append((at, n, d))
            if at == 0:
                break
            at, d = parent[at], d + 1
    assert sorted(map(tuple, T.closure(edges).collect())) == sorted(want)
    assert {r.node: r.freq for r in T.frequency(edges).collect()} == {a: sum(x[0] == a for x in want) for a in range(120)}
    with pytest.raises(ValueError, match="cycle"):
        T.closure(edges.union(spark.createDataFrame([(5, 0)], edges.schema)))


def test_a_wide_star_and_a_long_chain(spark):
    star = spark.range(1, 1_100_000).selectExpr("0L AS parent", "id AS child")
    assert T.closure(star).count() == 2 * 1_100_000 - 1
    assert T.frequency(star).filter("node = 0").first().freq == 1_100_000
    chain = spark.range(5_000).selectExpr("id AS parent", "id + 1 AS child")
    assert T.frequency(chain).agg(F.max("freq")).first()[0] == 5_001


def test_call_files_are_in_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["2", "10", "X"]), rng.randrange(9_000), "i", rng.choice(["AC", "", None]) if i % 9 == 0 else "AC", "<DEL>", None, "PASS", "SVTYPE=DEL", i, "DEL") for i in range(4_000)]
    df = spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, end long, svtype string").repartition(16)
    contigs = spark.createDataFrame([(0, "2", 9_000), (1, "X", 9_000), (2, "10", 9_000)], "place int, name string, size long")
    vcf.write_calls(df, str(tmp_path / "calls"), contigs=contigs, reference="own")
    lines = [x for part in ("0-header", "1-calls") for f in sorted((tmp_path / "calls" / part).glob("part-*")) for x in f.read_text().splitlines()]
    head, body = [x for x in lines if x.startswith("#")], [x.split("\t") for x in lines if not x.startswith("#")]
    assert lines[: len(head)] == head and head[-1].startswith("#CHROM") and [x for x in head if x.startswith("##contig")] == [f"##contig=<ID={c},length=9000>" for c in ("2", "X", "10")]
    number = [int(x[2].removeprefix("gv_")) for x in body]
    assert number == sorted(number) and len(body) == sum(bool(r[3]) for r in rows) and max(number) <= len(rows)
    assert [(x[0].rjust(100, "0"), int(x[1])) for x in body] == sorted((r[0].rjust(100, "0"), r[1]) for r in rows if r[3])


def test_block_files(spark, tmp_path):
    rng = random.Random(8)
    seqs = {f"c/{i}": "".join(rng.choices("ACGTN", k=n)) for i, n in enumerate([0, 1, 39, 40, 41, 80, 2_000, 12_345])}
    chunks = [(k, i, s[40 * i : 40 * i + 40]) for k, s in seqs.items() for i in range(max(1, -(-len(s) // 40)))]
    df = spark.createDataFrame(chunks, "name string, chunk long, seq string")
    folder = f"file://{tmp_path}/fa"
    fasta.write_blocks(df.filter("name <> 'c/1'"), folder, 40, 20)
    fasta.write_blocks(df.filter("name = 'c/1'"), folder, 40, 20, append=True)
    text = "".join(gzip.open(f, "rt").read() for f in sorted((tmp_path / "fa" / "blocks").glob("*.gz")))
    assert {x.split("\n")[0]: "".join(x.split("\n")[1:]) for x in text.split(">")[1:]} == seqs and max(map(len, text.splitlines())) == 20
    assert {r.name: r.length for r in fasta.lengths(spark, folder).collect()} == {k: len(s) for k, s in seqs.items()}
    asked = [(i, rng.choice([*seqs, "none"]), rng.randrange(-5, 13_000), rng.randrange(13_000)) for i in range(200)]
    got = {r.id: r.seq for r in fasta.read_ranges(spark, folder, spark.createDataFrame(asked, "id long, name string, s long, e long"), 40).collect()}
    assert got == {i: seqs.get(k, "")[max(0, s) : max(0, e)] for i, k, s, e in asked}
    spark.dataSource.register(fasta.FastaSource)
    read = spark.read.format("fasta_blocks").option("size", "40")
    rows = read.option("contig", "c/7").option("from", "95").option("to", "5000").load(folder).collect()
    assert "".join(r.seq for r in sorted(rows, key=lambda r: r.start)) == seqs["c/7"][95:5_000] and min(r.start for r in rows) == 95
    assert sum(len(r.seq) for r in spark.read.format("fasta_blocks").option("size", "40").load(folder).collect()) == sum(map(len, seqs.values()))
    block = fasta.packed(b">x\nACGT\n")
    assert fasta.bases_of(block) == "ACGT"
    with pytest.raises(ValueError, match="checksum"):
        fasta.bases_of(block[:-8] + bytes([block[-8] ^ 1]) + block[-7:])


def test_a_long_contig_in_linear_time(spark):
    seq = spark.range(1).select(F.lit("c").alias("name"), F.repeat(F.lit("ACGTTGCA"), F.lit(500_000)).alias("seq"))
    pieces = tables.windows(seq, 64)
    assert pieces.agg(F.count("*"), F.sum(F.length("seq"))).first()[:] == (62_500, 4_000_000)
    many = spark.range(1).select(F.repeat(F.lit("xxan"), F.lit(16_000)).alias("x"))
    found = many.select(X.positions(F.col("x"), "an").alias("p")).first().p
    assert found == list(range(2, 64_000, 4))


def brute_distance(a, b, delete, insert, substitute, match):
    row = [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * delete]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + delete, new[-1] + insert, row[j - 1] + (match if x == y else substitute)))
        row = new
    return row[-1]


def test_weighted_distance(spark):
    rng = random.Random(9)
    words = ["", "a", "kitten", "sitting", "ünï", "👍👍x", *("".join(rng.choices("abc", k=rng.randrange(25))) for _ in range(60))]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(300)] + [(None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame([(*p, 7) for p in pairs], "x string, y string, other int")
    for costs in ((1, 1, 1, 0), (2, 3, 4, 0.5), (1, 5, 100, 0)):
        got = D.weighted_distance(df, "x", "y", "d", *costs)
        for r in got.collect():
            assert r.d == (None if r.x is None or r.y is None else pytest.approx(brute_distance(r.x, r.y, *costs)))
    unit = D.weighted_distance(df, "x", "y", "d")
    assert unit.filter("d <> levenshtein(x, y)").count() == 0 and unit.columns == ["x", "y", "other", "d"]


def test_packages(spark, tmp_path):
    whole = tmp_path / "p.json"
    whole.write_text('{"a": {"x": [1, {"y": "z \\" q"}]}, "b": 3, "c,d": null, "é": "text"}')
    rows = {r.key: r.value for r in packages.unpack(spark, f"file://{whole}").collect()}
    assert rows["a"] == '{"x":[1,{"y":"z \\" q"}]}' and rows["b"] == "3"
    assert packages.unpack(spark, f"file://{tmp_path}/p.json").filter("key = 'none'").count() == 0
    (tmp_path / "bad.json").write_text("[1, 2")
    assert packages.unpack(spark, f"file://{tmp_path}/bad.json").count() == 0
    units = tmp_path / "u.json"
    units.write_text('{"1": [[5, 9, 0.5, {"c": ["q", "p", "q"]}], ["x", 9, 1, {}], [7, 8, 1.0, {}]], "2": []}')
    got = sorted(map(tuple, packages.read_units(spark, f"file://{units}").collect()), key=str)
    assert got == [("1", 0, 5, 9, 0.5, "c", ["p", "q"]), ("1", 2, 7, 8, 1.0, None, None)]
    short = spark.createDataFrame([("1", 0, 9.0)], "chrom string, place long, weight double")
    assert {r.weight for r in packages.read_units(spark, f"file://{units}", short).collect()} == {0.5, 1.0}


def test_running_total(spark, ranges):
    df = spark.createDataFrame([(i, i * i % 17) for i in range(300)], "id long, v long")
    got = {r.id: r.before for r in files.running_total(df, ["id"], "v", "before").collect()}
    assert got == {i: sum(x * x % 17 for x in range(i)) for i in range(300)}


def test_conflicts_meet_beginnings_once(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), s, s + rng.choice([0, 3, 60, 900]), i) for i, s in enumerate(rng.choice([rng.randrange(3000), 7]) for _ in range(300))]
    got = S.conflicts(spark.createDataFrame(rows, "k string, s long, e long, id long"), ["k"])
    want = sorted((x[3], y[3]) for x in rows for y in rows if x[3] < y[3] and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert sorted(map(tuple, got.collect())) == want
    # one join of calls with beginnings, not a second one of the coarser levels
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_events_split_over_genes_form_pairs_once(spark, monkeypatch):
    met, overlaps = [], I.overlaps
    monkeypatch.setattr(I, "overlaps", lambda *a: met.append(1) or overlaps(*a))
    events = spark.createDataFrame([("a", 0, 100, 1), ("a", 500, 510, 2), (None, 500, 510, 3)], "k string, s long, e long, id long")
    genes = spark.createDataFrame([("a", 10, 20, "g"), ("a", 400, 499, "h"), (None, 500, 510, "i")], "k string, s long, e long, symbol string")
    got = set(map(tuple, S.split_over_genes(events, genes, ["k"]).collect()))
    assert got == {("a", 10, 20, 1, "g"), ("a", 500, 510, 2, None), (None, 500, 510, 3, None)} and len(met) == 1


def test_segments_are_swept_with_their_ids(spark, ranges, monkeypatch):
    """Cuts of a null end and of null ids, ids that lie over one another, and over whole ranges; no segment is joined with what made it."""
    monkeypatch.delattr(I, "overlaps")
    rows = [r for r in spans(13, 200, 400, 30) if r[0]]
    rows += [("a", 5, 390, 900, "q", 0.0), ("a", 7, 20, 901, None, 0.0), ("b", 40, None, 902, "x", 0.0), (None, 1, 9, 903, "x", 0.0), ("c", 3, 3, 904, "x", 0.0)]
    got = {(r.k, r.s, r.e): r.ids for r in I.segments(spark.createDataFrame(rows, SCHEMA), ["k"], "t").collect()}
    want = {}
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        cuts = sorted({r[1] for r in own} | {r[2] + 1 for r in own if r[2] is not None})
        for s, e in zip(cuts, [x - 1 for x in cuts[1:]]):
            ids = sorted({r[4] for r in own if r[2] is not None and r[1] <= e and r[2] >= s and r[4]})
            if ids:
                want[k, s, e] = ids
    assert got == want


def test_majority_is_swept_with_its_classes(spark, ranges, monkeypatch):
    """Ids with several intervals in a class and in several classes, rows without an end, an id or a class; no segment is joined with classes."""
    monkeypatch.delattr(I, "overlaps")
    rows = [r for r in spans(14, 120, 300, 30) if r[0]]
    rows = [(*r[:3], r[3] % 50, *r[4:]) for r in rows]
    rows += [("a", 5, 290, 900, "x", 0.0), ("a", 7, 20, 901, None, 0.0), ("a", 8, 30, None, "y", 0.0), ("b", 40, None, 902, "x", 0.0), (None, 1, 9, 903, "x", 0.0), ("c", 3, 5, 904, "z", 0.0), ("c", 3, 5, 904, "z", 0.0)]
    for data, low, high in ((rows, 2, 9), (rows[-7:], 1, 99)):
        got = {(r.k, r.s, r.e): (r.weight, r.major) for r in W.majority(spark.createDataFrame(data, SCHEMA), ["k"], "t", "id", low, high).collect()}
        want = {}
        for k in "abc":
            own = [r for r in data if r[0] == k]
            cuts = sorted({r[1] for r in own} | {r[2] + 1 for r in own if r[2] is not None})
            for s, e in zip(cuts, [x - 1 for x in cuts[1:]]):
                over = {(r[4], r[3]) for r in own if None not in r[1:5] and r[1] <= e and r[2] >= s}
                if low <= len(over) <= high:
                    want[k, s, e] = (len(over), max((sum(t == x for x, _ in over), t) for t, _ in over)[1])
        assert got == want


def test_conflicts_of_a_pile_go_through_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 10)
    rng = random.Random(15)
    rows = [("a", 70 + rng.randrange(3), 100, i) for i in range(90)] + [("a", s, s + rng.choice([2, 300]), 90 + s) for s in range(0, 400, 9)] + [(None, 70, 100, 900), ("b", None, 100, 901), ("b", 70, None, 902)]
    got = S.conflicts(spark.createDataFrame(rows, "k string, s long, e long, id long"), ["k"]).withColumn("task", F.spark_partition_id()).collect()
    whole = [r for r in rows if None not in r]
    want = sorted((x[3], y[3]) for x in whole for y in whole if x[3] < y[3] and x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r.a, r.b) for r in got) == want
    pile = [r.task for r in got if r.b < 90]
    assert len(set(pile)) > 2 and max(pile.count(x) for x in set(pile)) < 0.6 * len(pile)
