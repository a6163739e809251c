from pyspark.sql import functions as F

from genoloom.functions import text as X
from genoloom.operators import compare as P
from genoloom.operators import intervals as I
from genoloom.operators import somatic as S
from genoloom.operators import tree as T
from genoloom.operators import weights as W
from genoloom.sources import files, tables, vcf


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_malformed_calls(spark, tmp_path):
    body = ["##x", "#CHROM\tPOS", "1\t5\ta\tA\t<DEL>\t.\t.\tCIEND=7;SVTYPE=DEL;END=9", "1\tx\tb\tA\t<DEL>\t.\t.\tSVTYPE=DEL;END=9", "1\t5\tc\tA\t<DEL>\t.\t.\tEND=9", "1\t5", "", "2\t9\td\tA\t<DUP>\t.\t.\tMERGE_TYPE=DUP;SVLEN=-3\tGT\t0/1"]
    calls = vcf.read_calls(spark, written(tmp_path, "a.vcf", "\n".join(body)))
    assert sorted((r.id, r.svtype, r.end, r.samples) for r in calls.collect()) == [("a", "DEL", 9, []), ("d", "DUP", 12, ["0/1"])]
    assert vcf.read_calls(spark, written(tmp_path, "b.vcf", "")).count() == 0
    assert [r.ids for r in vcf.call_intervals(calls, 5, 5).collect()] == [["a"]]


def test_samples_named_in_info(spark, tmp_path):
    rows = [f"1\t{p}\t{i}\tA\t<DEL>\t.\t.\tSVTYPE=DEL;END=20;SAMPLE={s}" for p, i, s in ((5, "x", "s1"), (5, "x", "s1"), (5, "y", "s2"))]
    got = vcf.call_intervals(vcf.read_calls(spark, written(tmp_path, "c.vcf", "\n".join(rows)))).collect()
    assert [(r.s, r.e, r.ids) for r in got] == [(5, 20, ["s1", "s2"])]


def test_copy_numbers(spark, tmp_path):
    rows = [f"1\t{i}\tv{i}\tA\t<CN0>,<CN2>\t.\t.\tSVTYPE=CNV;END=99;AF=0.1,0.2\tGT\t{g}" for i, g in enumerate(("0|1", "2|2", "1|2", "0|0", ".|2"), 1)]
    got = vcf.sample_calls(vcf.read_calls(spark, written(tmp_path, "d.vcf", "\n".join(rows))), 0).collect()
    assert sorted((r.pos, r.svtype, r.cn, r.af) for r in got) == [(1, "DEL", 1, 0.1), (2, "DUP", 4, 0.2), (3, "CNV", 2, 0.2), (5, "DUP", 3, 0.2)]


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).withColumn("x", F.xxhash64("id"))
    got = files.numbered(rows, ["x"]).orderBy("x").collect()
    assert [r.number for r in got] == list(range(1, 5001))


def test_fasta_and_fastq(spark, tmp_path):
    path = written(tmp_path, "a.fa", ">one first\nACGT\nAC\n>two\n\n>three\nN")
    assert sorted(map(tuple, tables.read_fasta(spark, path).collect())) == [("one", "ACGTAC"), ("three", "N"), ("two", "")]
    assert sorted(map(tuple, tables.windows(tables.read_fasta(spark, path), 4).collect())) == [("one", 0, "ACGT"), ("one", 1, "AC"), ("three", 0, "N"), ("two", 0, "")]
    path = written(tmp_path, "a.fq", "".join(f"@r{i}\nAC\n+\n@@\n" for i in range(50)) + "@last\nA\n")
    got = tables.read_fastq(spark, path)
    assert sorted((r.record, r.id, r.qual) for r in got.collect()) == [(i, f"@r{i}", "@@") for i in range(50)]
    assert tables.sampled(got, 1.0).count() == 50 and tables.sampled(got, 0.0).count() == 0


def test_bed_and_masks(spark, tmp_path):
    got = tables.read_bed(spark, written(tmp_path, "a.bed", "1\t2\t3\nbad\n2\t5\tx\n3\t7\t9"), "m")
    assert sorted(map(tuple, got.collect())) == [("1", 2, 3, "m_1"), ("3", 7, 9, "m_4")]
    assert sorted(map(tuple, tables.read_mask(spark, written(tmp_path, "m.json", '{"1":[[1,2],[5,6]],"2":[]}')).collect())) == [("1", 1, 2), ("1", 5, 6)]


def test_lines_over_blocks_and_files(spark, tmp_path):
    texts = ["".join(f"{name}\t{i}\t{i + 1}\n" for i in range(n)) for name, n in (("a", 3000), ("b", 1), ("c", 700))]
    for i, text in enumerate(texts):
        written(tmp_path, f"part-{i}.bed", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = {(r.chrom, r.s): r.id for r in tables.read_bed(spark, str(tmp_path), "b", together=True).collect()}
    own = {(r.chrom, r.s): r.id for r in tables.read_bed(spark, str(tmp_path), "b").collect()}
    plan = files.lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = [tuple(x.split("\t")[:2]) for text in texts for x in text.splitlines()]
    assert got == {(k, int(s)): f"b_{n + 1}" for n, (k, s) in enumerate(rows)}
    assert own == {(k, int(s)): f"b_{int(s) + 1}" for k, s in rows}
    assert "row_number" not in plan


def test_matched_rows_with_one_id(spark):
    a = spark.createDataFrame([("c", 1, 10, 1), ("c", 100, 110, 1)], "k string, s long, e long, id long")
    b = spark.createDataFrame([("c", 1, 10, 7)], "k string, s long, e long, id long")
    assert [r.s for r in P.matched(a, b, ["k"], 0.5, "left_semi").collect()] == [1]
    assert [r.s for r in P.matched(a, b, ["k"], None, "left_anti").collect()] == [100]


def test_overlaps_of_any_length(spark):
    spans = [(0, 3), (511, 512), (500, 40_000), (1000, 260_000_000), (2, 2_000_000_000), (259_999_999, 260_000_001), (33_000, 33_001)]
    df = spark.createDataFrame([("c", s, e) for s, e in spans], "k string, s long, e long")
    got = sorted((r.a_s, r.a_e, r.b_s, r.b_e) for r in I.overlaps(df, df, ["k"]).collect())
    assert got == sorted((*a, *b) for a in spans for b in spans if a[0] <= b[1] and b[0] <= a[1])


def test_merge_over_ranges(spark):
    spans = [(0, 65536 - 1), (65536, 65536 + 5), (65536 + 7, 3 * 65536), (5 * 65536, 5 * 65536), (2 * 65536, 2 * 65536 + 9)]
    df = spark.createDataFrame([("c", s, e) for s, e in spans], "k string, s long, e long")
    assert sorted((r.s, r.e) for r in I.merge(df, ["k"]).collect()) == [(0, 65536 + 5), (65536 + 7, 3 * 65536), (5 * 65536, 5 * 65536)]


def test_a_deep_tree(spark):
    edges = spark.range(150).selectExpr("id AS parent", "id + 1 AS child")
    assert T.closure(edges).agg(F.max("depth")).first()[0] == 150


def test_small_functions(spark):
    row = spark.createDataFrame([("banana", 1999, 3)], "x string, n long, d long").select(
        X.positions(F.col("x"), "an").alias("p"), X.split_at(F.col("x"), F.array(F.lit(2))).alias("c"), X.pretty_size(F.col("n")).alias("n"), X.expected_window(F.col("d"), F.lit(100), F.lit(30)).alias("w"),
        W.log_ratio(F.col("n"), F.lit(0), F.col("n"), F.col("d")).alias("none"), S.mostly_unknown(F.lit("NNNNA"), 3).alias("masked"))
    assert tuple(row.first()) == ([1, 3], ["ba", "nana"], "1KB", 2000, None, True)


def test_nearest_length_ties(spark):
    wanted = spark.createDataFrame([(1, 10), (2, 4), (3, 100), (4, 7)], "id long, n long")
    given = spark.createDataFrame([(8,), (12,), (6,)], "n long")
    assert sorted(map(tuple, S.nearest_length(wanted, given, "id", "n").collect())) == [(1, 12), (2, 6), (3, None), (4, 8)]
    assert [r.nearest for r in S.nearest_length(wanted, given.filter("false"), "id", "n").collect()] == [None] * 4


def call_file(tmp_path, name, samples, rows):
    head = ["##fileformat=VCFv4.2", "##PEDIGREE=<Derived=S_1,Original=S_0>", "##PEDIGREE=<Derived=S_2,Original=S_1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)]
    return written(tmp_path, name, "\n".join(head + [f"{c}\t{p}\t{i}\tN\t<{t}>\t.\tPASS\tSVTYPE={t};END={e}\tGT\t" + "\t".join(g) for c, p, e, i, t, g in rows]) + "\n")


def test_merged_and_split_files(spark, tmp_path):
    normal = call_file(tmp_path, "n.vcf", ["S_0"], [("2", 5, 9, "a", "DEL", ["0|1"]), ("10", 5, 9, "b", "DEL", ["1|1"]), ("2", 5, 9, "c", "DEL", ["0|1"])])
    somatic = call_file(tmp_path, "s.vcf", ["S_0", "S_1", "S_2"], [("2", 5, 9, "x", "DEL", ["0|1", "1|1", "0|0"]), ("2", 5, 9, "y", "DUP", ["0|1", "1|1", "0|0"]), ("X", 1, 2, "z", "DEL", ["0|0", "1|0", "0|1"]), ("X", 1, 2, "w", "DEL", ["0|0", "1|0", "0|1"])])

    def body(folder):
        lines = [x for part in ("0-header", "1-calls") for f in sorted((tmp_path / folder / part).glob("part-*")) for x in f.read_text().splitlines()]
        assert [x[:5] for x in lines if x[0] == "#"] == ["##fil", "##PED", "##PED", "#CHRO"]
        return [(x.split("\t")[2], x.split("\t")[9:]) for x in lines if x[0] != "#"]

    vcf.merge_files(spark, normal, somatic, f"file://{tmp_path}/m")
    assert body("m") == [("a", ["0|1"] * 3), ("y", ["0|1", "1|1", "0|0"]), ("w", ["0|0", "1|0", "0|1"]), ("b", ["1|1"] * 3)]
    vcf.split_files(spark, normal, somatic, f"file://{tmp_path}/d")
    assert [i for i, _ in body("d")] == ["y", "w"]
    other = call_file(tmp_path, "o.vcf", ["T_0"], [])
    try:
        vcf.merge_files(spark, other, somatic, f"file://{tmp_path}/e")
    except ValueError as e:
        assert "pedigree" in str(e)
    else:
        raise AssertionError("a stranger's file was merged")


def test_sequences_of_calls(spark, tmp_path):
    seq = "ACGTTGCAAC" * 5
    chunks = spark.createDataFrame([("X", i, seq[8 * i : 8 * i + 8]) for i in range(7)], "name string, chunk int, seq string")
    rows = [("X", 6, "d", "DEL", 19, "SVTYPE=DEL;END=19;SVLEN=13", ["1|0"]), ("X", 6, "e", "DEL", 19, "SVTYPE=DEL;END=19;SVLEN=13", ["0|0"]), ("X", 3, "i", "INV", 8, "SVTYPE=INV;END=8", []), ("Y", 1, "u", "DUP", 5, "SVTYPE=DUP;END=5", []), ("X", 45, "o", "DEL", 60, "SVTYPE=DEL;END=60", [])]
    calls = spark.createDataFrame([(c, p, i, "N", ".", None, None, info, e, t, s) for c, p, i, t, e, info, s in rows], "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, end long, svtype string, samples array<string>")
    got = {r.id: r for r in vcf.with_sequences(calls, chunks, 8).collect()}
    assert set(got) == {"d", "i", "u", "o"} and {r.gt for r in got.values()} == {"1"}
    assert (got["d"].ref, got["d"].alt, got["d"].info) == (seq[6:19], "<DEL>", "SVTYPE=DEL;END=19;SVLEN=14")
    assert (got["i"].ref, got["i"].alt, got["i"].info) == ("TTGCA", "TGCAA", "SVTYPE=INV;END=8;SVLEN=6")
    assert got["u"].ref == "" and got["u"].info == "SVTYPE=DUP;END=5;SVLEN=5;DUP_POS=1;DUP_TYPE=TANDEM;ICN=4"
    assert got["o"].ref == seq[45:]
    alone = {r.id: r.gt for r in vcf.with_sequences(calls.filter("chrom = 'X'"), chunks, 8).collect()}
    assert alone == {"d": "1|0", "i": "0|1", "o": "0|1"}


def test_call_intervals_take_lines_apart_once(spark, tmp_path):
    rows = ["c\t5\tv1\tA\t.\t.\t.\tSVTYPE=DEL;END=9;SAMPLE=", "c\t5\tv2\tA\t.\t.\t.\tEND=7;SVTYPE=DUP;END=9", "c\t5\tv3\tA\t.\t.\t.\tSVTYPE=DUP;END=9"]
    (tmp_path / "a.vcf").write_text("\n".join(rows) + "\n")
    got = vcf.call_intervals(vcf.read_calls(spark, str(tmp_path / "a.vcf")))
    assert sorted(map(tuple, got.collect())) == [("c", 5, 9, "DEL", [""]), ("c", 5, 9, "DUP", ["v2", "v3"])]
    assert "text" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()
