"""Queries that write files from the driver's tables and read them back, with SQL over the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.catalogue import query
from genoloom.plans import views as V
from genoloom.sources import tables as T
from genoloom.sources import vcf
from genoloom.sources.files import ranges, shared_folder

#: Calls made of orders, as SQL: a CNV in each third row, of samples whose alleles are parities.
CALLS = """SELECT 'chr' || (o_custkey % 25) AS chrom, CAST(floor(o_totalprice / 10) AS BIGINT) AS pos, 'v' || o_orderkey AS id, 'ACGT' AS ref,
CASE WHEN o_orderkey % 3 = 0 THEN '<CN0>,<CN2>' ELSE '<DEL>' END AS alt, '.' AS qual, 'PASS' AS filter,
CASE WHEN o_orderkey % 3 = 0 THEN 'CNV' WHEN o_orderkey % 3 = 1 THEN 'DEL' ELSE 'DUP' END AS svtype,
CAST(floor(o_totalprice / 10) AS BIGINT) + o_orderkey % 400 AS e, o_orderkey % 2 AS a, (o_custkey % 3) * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS b, o_orderkey AS n FROM orders"""


def call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CALLS.replace("FROM orders", "FROM {orders}"), orders=V.table(spark, sf_dir, "orders"))
    info = F.concat(F.lit("CIEND=1,2;SVTYPE="), "svtype", F.when(F.col("n") % 5 == 0, F.concat(F.lit(";SVLEN=-"), (F.col("e") - F.col("pos")).cast("string"))).otherwise(F.concat(F.lit(";END="), F.col("e").cast("string"))), F.lit(";AF=0.25,0.5"))
    return rows.withColumn("info", info).withColumn("end", F.col("e")).withColumn("samples", F.array(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")), F.concat_ws("/", F.col("b").cast("string"), F.lit("."))))


def vcf_file(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "vcf")
    vcf.write_calls(call_rows(spark, sf_dir), path, ["one", "two"], V.tree(spark, sf_dir).select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child")))
    return path


@query(f"SELECT chrom, pos, 'A' AS ref, svtype, e AS end_pos FROM ({CALLS})")
def vcf_round_trip(spark, sf_dir):
    return vcf.read_calls(spark, f"{vcf_file(spark, sf_dir)}/*").select("chrom", "pos", "ref", "svtype", F.col("end").alias("end_pos"))


@query(f"SELECT 'gv_' || row_number() OVER (ORDER BY lpad(chrom, 100, '0'), pos, e, svtype, n % 5 = 0) AS id, chrom, pos, svtype FROM ({CALLS})")
def vcf_numbered_ids(spark, sf_dir):
    return vcf.read_calls(spark, f"{vcf_file(spark, sf_dir)}/*").select("id", "chrom", "pos", "svtype")


@query(f"SELECT chrom, pos AS s, e, svtype, count(*) AS rows_of FROM ({CALLS}) WHERE e - pos + 1 BETWEEN 50 AND 300 AND chrom IN ('chr1', 'chr2', 'chr3') GROUP BY ALL")
def vcf_intervals(spark, sf_dir):
    calls = vcf.read_calls(spark, f"{vcf_file(spark, sf_dir)}/*", ["chr1", "chr2", "chr3"])
    return vcf.call_intervals(calls, 50, 300).select("chrom", "s", "e", "svtype", F.size("ids").cast("long").alias("rows_of"))


@query(f"""
WITH c AS (SELECT *, CASE WHEN a = 0 THEN 1 WHEN svtype = 'CNV' THEN 0 ELSE 0 END AS x, CASE b WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS y
  FROM ({CALLS}) WHERE a + b > 0) SELECT DISTINCT chrom, pos, e AS end_pos, CASE WHEN svtype = 'CNV' AND x + y < 2 THEN 'DEL' WHEN svtype = 'CNV' AND
  x + y > 2 AND x <> 0 AND y <> 0 THEN 'DUP' ELSE svtype END AS svtype FROM c
""")
def vcf_sample_calls(spark, sf_dir):
    calls = vcf.read_calls(spark, f"{vcf_file(spark, sf_dir)}/*")
    return vcf.sample_calls(calls, 0).select("chrom", "pos", F.col("end").alias("end_pos"), "svtype")


@query("SELECT * FROM (VALUES (0, 'one'), (1, 'two')) t(place, sample)")
def vcf_header_samples(spark, sf_dir):
    return vcf.header_samples(spark, f"{vcf_file(spark, sf_dir)}/0-header")


@query(f"SELECT parent::VARCHAR AS parent, child::VARCHAR AS child FROM ({V.TREE})")
def vcf_pedigree(spark, sf_dir):
    return vcf.pedigree(spark, f"{vcf_file(spark, sf_dir)}/0-header")


@query(f"SELECT clone, count(*) AS n FROM (SELECT 0 AS clone, a = 1 OR b = 1 AS has FROM ({CALLS}) UNION ALL SELECT 1, b = 1 FROM ({CALLS})) WHERE has GROUP BY clone")
def vcf_by_clone(spark, sf_dir):
    path = shared_folder(spark, "clones")
    vcf.write_clone_calls(call_rows(spark, sf_dir), path)
    return spark.read.text(path).groupBy("clone").agg(F.count("*").alias("n"))


@query(f"SELECT chrom, pos, 'x_' || row_number() OVER (ORDER BY n) AS id FROM ({CALLS})")
def vcf_replace_ids(spark, sf_dir):
    return vcf.renumber(call_rows(spark, sf_dir), ["n"], "x_").select("chrom", "pos", "id")


@query(f"SELECT k, s, e, 'b_' || row_number() OVER (ORDER BY k, s, e, id) AS id FROM ({V.CALLS})")
def bed_read(spark, sf_dir):
    path = shared_folder(spark, "bed")
    calls, order = V.calls(spark, sf_dir), ["k", "s", "e", "id"]
    rows = calls.repartitionByRange(ranges(calls), *order).sortWithinPartitions(*order)
    rows.select(F.concat_ws("\t", *(F.col(x).cast("string") for x in "kse"))).write.option("compression", "gzip").text(path)
    return T.read_bed(spark, path, "b", together=True).select(F.col("chrom").cast("long").alias("k"), "s", "e", "id")


@query(f"SELECT k, s, e, -0.5 * (e - s) AS weight FROM ({V.CALLS})")
def bedgraph_write(spark, sf_dir):
    path = shared_folder(spark, "bedgraph")
    T.write_bedgraph(V.calls(spark, sf_dir).select(F.col("k").alias("chrom"), "s", "e", (F.col("e") - F.col("s")).alias("weight")), path, -0.5)
    return spark.read.schema("k long, s long, e long, weight double").option("sep", "\t").csv(path)


@query(f"SELECT k::VARCHAR AS chrom, s, e FROM ({V.CALLS})")
def mask_json(spark, sf_dir):
    path = shared_folder(spark, "mask")
    rows = T.mask_json(V.calls(spark, sf_dir).select(F.col("k").cast("string").alias("chrom"), "s", "e"))
    rows.select(F.concat(F.lit('{"'), "chrom", F.lit('":'), "pairs", F.lit("}"))).repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return T.read_mask(spark, path)


@query("SELECT s_nationkey % 3 AS layer, 'T' || s_nationkey AS svtype, s_suppkey::DOUBLE AS size, round(s_acctbal, 2) AS rate, 0.5 AS het FROM supplier")
def rate_map_json(spark, sf_dir):
    path = shared_folder(spark, "rates")
    s = V.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.round("s_acctbal", 2)))).alias("m"))
    body = F.to_json(F.create_map((F.col("s_nationkey") % 3).cast("string"), F.create_map(F.concat(F.lit("T"), "s_nationkey"), F.struct(F.col("m").alias("l:n"), F.lit(0.5).alias("h")))))
    s.select(body).repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return T.read_rates(spark, path)


@query("SELECT 'chr' || n_nationkey AS chrom, n_regionkey AS ploidy, unnest([0, 3]) AS copies, unnest([0.25, 0.75])::DOUBLE AS chance FROM nation")
def aneuploidy_json(spark, sf_dir):
    path = shared_folder(spark, "aneuploidy")
    n = V.table(spark, sf_dir, "nation")
    entry = F.struct(F.create_map(F.lit("0"), F.lit(0.25), F.lit("3"), F.lit(0.75)).alias("dist"), F.col("n_regionkey").alias("n"))
    n.select(F.to_json(F.create_map(F.concat(F.lit("chr"), "n_nationkey"), entry))).repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    return T.read_aneuploidy(spark, path)


def tree_file(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "tree")
    edges = V.tree(spark, sf_dir).groupBy(F.col("parent").cast("string").alias("p")).agg(F.array_sort(F.collect_list(F.col("child").cast("string"))).alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("tree"))
    key = F.col("n_nationkey").cast("string")
    maps = [F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name) for name, value in (("alive", F.col("n_nationkey") % 4 > 0), ("depth", F.floor(F.log2(F.col("n_nationkey") + 1)).cast("int")), ("freq", F.col("n_regionkey")))]
    edges.crossJoin(F.broadcast(V.table(spark, sf_dir, "nation").agg(*maps))).select(F.to_json(F.struct("tree", "alive", "depth", "freq"))).write.text(path)
    return path


@query(f"SELECT parent::VARCHAR AS parent, child::VARCHAR AS child FROM ({V.TREE})")
def clone_tree_json(spark, sf_dir):
    return T.read_clone_tree(spark, tree_file(spark, sf_dir))[0]


@query("SELECT count(*) FILTER (WHERE n_nationkey % 4 > 0) AS living, max(floor(log2(n_nationkey + 1)))::INTEGER AS max_depth FROM nation")
def clone_living_depth(spark, sf_dir):
    return T.read_clone_tree(spark, tree_file(spark, sf_dir))[1].agg(F.count_if("alive").alias("living"), F.max("depth").alias("max_depth"))


@query("SELECT DISTINCT p_name AS symbol FROM part WHERE p_size > 40")
def gene_list_file(spark, sf_dir):
    path = shared_folder(spark, "genes")
    V.table(spark, sf_dir, "part").filter("p_size > 40").select("p_name").distinct().union(spark.sql("SELECT ''")).write.text(path)
    return T.read_gene_list(spark, path)


def gene_table(spark: SparkSession, sf_dir: str):
    path = shared_folder(spark, "transcripts")
    p = V.table(spark, sf_dir, "part")
    s, e = F.col("p_partkey") * 3, F.col("p_partkey") * 3 + F.col("p_size")
    columns = [F.lit("0"), F.lit("t"), F.col("p_brand"), F.lit("+"), s, e, s, e, F.lit("2"), F.concat_ws(",", s, s + 2, F.lit("")), F.concat_ws(",", s + 1, s + 3, F.lit("")), F.lit("0"), (F.col("p_partkey") % 50).cast("string")]
    p.select(F.concat_ws("\t", *(c.cast("string") for c in columns))).write.text(path)
    return T.read_genes(spark, path)


@query("""
WITH p AS (SELECT (p_partkey % 50)::VARCHAR AS symbol, p_brand AS chrom, p_partkey * 3 AS s, p_partkey * 3 + p_size AS e, p_partkey AS r
  FROM part), m AS (SELECT *, max(e) OVER (PARTITION BY symbol, chrom ORDER BY s, e, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM p), g AS (SELECT *, sum(CASE WHEN s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, chrom ORDER BY s, e, r) AS i
  FROM m) SELECT symbol, chrom, min(s) AS s, max(e) AS e FROM g GROUP BY symbol, chrom, i
""")
def gene_merge(spark, sf_dir):
    return gene_table(spark, sf_dir)[0].select("symbol", "chrom", "s", "e")


@query("SELECT DISTINCT (p_partkey % 50)::VARCHAR AS symbol, p_brand AS chrom, p_partkey * 3 + x AS s, p_partkey * 3 + x + 1 AS e FROM part, (VALUES (0), (2)) t(x)")
def exon_list(spark, sf_dir):
    return gene_table(spark, sf_dir)[1]


#: Sequences of part names, as SQL: letters to bases, long enough for several lines.
SEQUENCES = """
SELECT 'c' || p_partkey AS name, repeat(translate(upper(replace(p_name, ' ', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC'), 1 +
  (p_partkey % 20)::INTEGER) AS seq FROM part
"""


def fasta_file(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "fasta")
    T.write_fasta(spark.sql(SEQUENCES.replace("FROM part", "FROM {part}").replace("::INTEGER", ""), part=V.table(spark, sf_dir, "part")), path)
    return path


@query(f"SELECT name, seq FROM ({SEQUENCES})")
def fasta_round_trip(spark, sf_dir):
    return T.read_fasta(spark, fasta_file(spark, sf_dir))


@query(f"SELECT name, length(seq)::BIGINT AS size, substr(seq, 11, 20) AS part FROM ({SEQUENCES})")
def fasta_substring(spark, sf_dir):
    return T.read_fasta(spark, fasta_file(spark, sf_dir)).select("name", F.length("seq").cast("long").alias("size"), F.substring("seq", 11, 20).alias("part"))


@query(f"""
SELECT name, i::INTEGER AS chunk, substr(seq, 64 * i + 1, 64) AS seq FROM
  (SELECT name, seq, unnest(range(0, greatest(1, (length(seq) + 63) // 64))) AS i
  FROM ({SEQUENCES}))
""")
def fasta_windows(spark, sf_dir):
    return T.windows(T.read_fasta(spark, fasta_file(spark, sf_dir)), 64)


def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "fastq")
    rows = V.table(spark, sf_dir, "supplier").coalesce(1).sortWithinPartitions("s_suppkey")
    for mate in (1, 2):
        rows.select(F.concat(F.lit("@r"), "s_suppkey", F.lit(f"/{mate}\n"), F.lit("ACGT\n+\n@"), F.lpad(F.col("s_suppkey").cast("string"), 3, "I"))).write.text(f"{path}/mate={mate}")
    return T.read_fastq(spark, f"{path}/*")


@query("""
SELECT '@r' || s_suppkey || '/' || m AS id, 'ACGT' AS seq, '+' AS plus, '@' || left(lpad(s_suppkey::VARCHAR, greatest(3, 0), 'I'), 3) AS qual
  FROM supplier, (VALUES (1), (2)) t(m)
""")
def fastq_read(spark, sf_dir):
    return fastq_files(spark, sf_dir).select("id", "seq", "plus", "qual")


@query("SELECT n AS record, 2::BIGINT AS mates FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier) WHERE left(md5('7:' || n), 5) < '66666'")
def fastq_sample_pairs(spark, sf_dir):
    """Records of a seeded sample with the number of their mates in it."""
    return T.sampled(fastq_files(spark, sf_dir), 0.4).groupBy("record").agg(F.count("*").alias("mates"))


@query(f"SELECT id, t, k, s, e FROM ({V.CALLS})")
def calls_json(spark, sf_dir):
    path = shared_folder(spark, "calls-json")
    V.calls(spark, sf_dir).select("id", "t", "k", "s", "e").write.json(path)
    return spark.read.schema("id long, t string, k long, s long, e long").json(path)


@query(f"SELECT k, t, list_sort(list(DISTINCT id)) AS ids FROM ({V.CALLS}) GROUP BY k, t")
def class_ids_json(spark, sf_dir):
    """Class id sets as sorted arrays in JSON, and back."""
    path = shared_folder(spark, "ids-json")
    V.calls(spark, sf_dir).groupBy("k", "t").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.to_json(F.struct("k", "t", "ids"))).write.text(path)
    return spark.read.text(path).select(F.from_json("value", "k long, t string, ids array<long>").alias("x")).select("x.*")
