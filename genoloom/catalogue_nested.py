"""Queries of sequences by ranges, ordered call files, nested JSON maps and further functions, with SQL over the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.catalogue import SIMILAR, query
from genoloom.catalogue_effects import HITS, hits, lists
from genoloom.catalogue_files import CALLS as FILE_CALLS
from genoloom.catalogue_files import call_rows, vcf_file
from genoloom.functions import distance as D
from genoloom.functions import text as X
from genoloom.operators import calls as C
from genoloom.operators import effects as E
from genoloom.operators import intervals as I
from genoloom.plans import views as V
from genoloom.sources import fasta, files, vcf
from genoloom.sources import packages as P
from genoloom.sources import tables as T

#: Chunks of 64 bases of 25 contigs, made of part names, and the contigs they make up.
BASES = "left(repeat(translate(upper(replace(p_name, ' ', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC'), 20), 64)"
CHUNKS = f"SELECT 'c' || (p_partkey % 25) AS name, p_partkey // 25 AS chunk, {BASES} AS seq FROM part"
CONTIGS = f"SELECT name, string_agg(seq, '' ORDER BY chunk) AS seq FROM ({CHUNKS}) GROUP BY name"
#: Calls on these contigs: with a genotype column or without, some beyond the end.
ON_CONTIGS = """
SELECT 'c' || (o_custkey % 26) AS chrom, floor(o_totalprice / 10)::BIGINT % 6000 AS pos, 'v' || (o_orderkey // 3) AS id, ['DEL', 'DUP', 'INV',
  'INS'][1 + o_orderkey % 4] AS svtype, o_orderkey % 300 AS size, o_orderkey % 2 = 0 AS own
  FROM orders
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    name = F.translate(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    n = F.col("p_partkey")
    return p.select(F.concat(F.lit("c"), (n % 25).cast("string")).alias("name"), F.floor(n / 25).alias("chunk"), F.left(F.repeat(name, F.lit(20)), F.lit(64)).alias("seq"))


def on_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    n, pos = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 10) % 6000
    end, kind, own = pos + n % 300, F.element_at(F.array(*map(F.lit, ["DEL", "DUP", "INV", "INS"])), (1 + n % 4).cast("int")), n % 2 == 0
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";END="), end.cast("string"), F.when(own, F.concat(F.lit(";SVLEN="), (n % 300).cast("string"))).otherwise(""))
    dot = F.lit(".")
    return o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 26).cast("string")).alias("chrom"), pos.alias("pos"), F.concat(F.lit("v"), F.floor(n / 3).cast("string")).alias("id"), F.lit("N").alias("ref"), dot.alias("alt"), dot.alias("qual"), dot.alias("filter"), info.alias("info"), end.alias("end"), kind.alias("svtype"), F.when(own, F.array(F.lit("1|0"))).otherwise(F.array().cast("array<string>")).alias("samples"))


@query(f"""WITH q AS ({CONTIGS}), c AS (SELECT *, pos + size AS e FROM ({ON_CONTIGS})),
i AS (SELECT *, 'SVTYPE=' || svtype || ';END=' || e || CASE WHEN own THEN ';SVLEN=' || size ELSE '' END AS info FROM c),
o AS (SELECT chrom, pos, e, svtype, arg_min(own, (id, 'N', '.', '.', '.', info)) AS own, min(id) AS id, arg_min(size, (id, 'N', '.', '.', '.', info)) AS size FROM i GROUP BY ALL),
r AS (SELECT o.*, CASE WHEN svtype = 'INS' THEN 'N' ELSE coalesce(substr(q.seq, pos + 1, size), '') END AS ref FROM o LEFT JOIN q ON q.name = chrom)
SELECT chrom, pos, e AS end_pos, svtype, ref, CASE svtype WHEN 'DEL' THEN '<DEL>' WHEN 'INV' THEN reverse(translate(ref, 'ACGT', 'TGCA')) ELSE '.' END AS alt,
'SVTYPE=' || svtype || ';END=' || e || CASE WHEN own AND svtype IN ('DEL', 'INS') THEN ';SVLEN=' || (size + 1) WHEN own THEN ';SVLEN=' || size ELSE ';SVLEN=' || (size + 1) END || CASE WHEN svtype = 'DUP' THEN ';DUP_POS=' || pos || ';DUP_TYPE=TANDEM;ICN=4' WHEN own AND svtype = 'INV' THEN ';INV_TYPE=PERFECT' ELSE '' END AS info,
CASE WHEN chrom IN ('c3', 'c5') THEN '1' WHEN own THEN '1|0' ELSE '0|1' END AS gt FROM r""")
def calls_with_sequences(spark, sf_dir):
    found = vcf.with_sequences(on_contigs(spark, sf_dir), chunks(spark, sf_dir), 64, ("c3", "c5"))
    return found.select("chrom", "pos", F.col("end").alias("end_pos"), "svtype", "ref", "alt", "info", "gt")


def block_file(spark: SparkSession, sf_dir: str) -> str:
    path = files.shared_folder(spark, "blocks")
    fasta.write_blocks(chunks(spark, sf_dir), path, 64, 16)
    return path


@query(f"WITH q AS ({CONTIGS}) SELECT name, length(seq) AS length FROM q")
def fasta_block_lengths(spark, sf_dir):
    return fasta.lengths(spark, block_file(spark, sf_dir))


@query(f"WITH q AS ({CONTIGS}) SELECT o_orderkey AS id, substr(seq, o_orderkey % 4000 + 1, o_custkey % 500) AS seq FROM orders JOIN q ON name = 'c' || (o_orderkey % 25)")
def fasta_block_ranges(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    s = F.col("o_orderkey") % 4000
    ranges = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 25).cast("string")).alias("name"), s.alias("s"), (s + F.col("o_custkey") % 500).alias("e"))
    return fasta.read_ranges(spark, block_file(spark, sf_dir), ranges, 64).select("id", "seq")


@query(f"""
WITH q AS ({CONTIGS}) SELECT name, greatest(64 * i, 100) AS start, substr(seq, greatest(64 * i, 100) + 1, least(64 * i + 64, 1000) - greatest(64 * i,
  100)) AS seq FROM q, range(1, 16) r(i) WHERE name = 'c7' AND length(seq) > greatest(64 * i, 100)
""")
def fasta_block_source(spark, sf_dir):
    spark.dataSource.register(fasta.FastaSource)
    return spark.read.format("fasta_blocks").option("contig", "c7").option("from", "100").option("to", "1000").option("size", "64").load(block_file(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY lpad(chrom, 100, '0'), pos, e, svtype, n % 5 = 0) AS place, chrom, pos, svtype FROM ({FILE_CALLS})")
def vcf_file_order(spark, sf_dir):
    """Calls by their places in the files, which follow one another by name."""
    lines = files.lines(spark, f"{vcf_file(spark, sf_dir)}/1-calls")
    f = F.split("value", "\t")
    return files.numbered(lines, ["file", "number"], "place").select("place", f[0].alias("chrom"), f[1].cast("long").alias("pos"), F.regexp_extract(f[7], "SVTYPE=([^;]*)", 1).alias("svtype"))


GTS = f"SELECT id, t, k, s // 50 AS s, e // 50 AS e, side, (id % 2) || '|' || (id // 2 % 2) AS gt, (id // 4 % 2) || '|0' AS gt2 FROM ({V.CALLS})"


def two_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A normal file of one sample, and a somatic one of it and two clones."""
    n, paths = F.col("id"), []
    gt = F.concat((n % 2).cast("string"), F.lit("|"), (F.floor(n / 2) % 2).cast("string"))
    end = F.floor(F.col("e") / 50)
    info = F.concat(F.lit("SVTYPE="), "t", F.lit(";END="), end.cast("string"), F.lit(";N="), n.cast("string"))
    rows = V.calls(spark, sf_dir).select("side", F.col("k").cast("string").alias("chrom"), F.floor(F.col("s") / 50).alias("pos"), end.alias("end"), F.col("t").alias("svtype"), F.lit("N").alias("ref"), F.lit("<X>").alias("alt"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), gt.alias("gt"), F.concat((F.floor(n / 4) % 2).cast("string"), F.lit("|0")).alias("gt2"))
    edges = spark.createDataFrame([("S_0", "S_1"), ("S_1", "S_2")], "parent string, child string")
    for side, samples, columns in (("F", ["S_0"], ["gt"]), ("O", ["S_0", "S_1", "S_2"], ["gt", "gt2", "gt"])):
        paths.append(files.shared_folder(spark, f"side-{side}"))
        vcf.write_calls(rows.filter(F.col("side") == side).withColumn("samples", F.array(*columns)), paths[-1], samples, edges)
    return f"{paths[0]}/*", f"{paths[1]}/*"


@query(f"""WITH g AS ({GTS}), x AS (SELECT *, gt2 AS second, row_number() OVER (PARTITION BY k, s, e, t, gt ORDER BY side, id) AS n, min(gt2) OVER (PARTITION BY side, k, s, e, t, gt) = max(gt2) OVER (PARTITION BY side, k, s, e, t, gt) AS sure FROM g WHERE side <> 'P')
SELECT k::VARCHAR AS chrom, s AS pos, e AS end_pos, t AS svtype, gt AS first, CASE WHEN side = 'F' THEN gt WHEN sure THEN second END AS second, 3::BIGINT AS columns FROM x WHERE n = 1""")
def merged_call_file(spark, sf_dir):
    """Where calls of one side that are alike differ in a clone's genotype, any of them may stand for them."""
    path, (normal, somatic) = files.shared_folder(spark, "merged"), two_files(spark, sf_dir)
    vcf.merge_files(spark, normal, somatic, path)
    found = vcf.read_calls(spark, f"{path}/*").withColumn("first", F.col("samples")[0]).withColumn("second", F.col("samples")[1])
    alike = vcf.read_calls(spark, somatic).groupBy("chrom", "pos", "end", "svtype", F.col("samples")[0].alias("first")).agg((F.min(F.col("samples")[1]) == F.max(F.col("samples")[1])).alias("sure"))
    own = vcf.read_calls(spark, normal).select("chrom", "pos", "end", "svtype", F.col("samples")[0].alias("first")).distinct().withColumn("normal", F.lit(True))
    key = ["chrom", "pos", "end", "svtype", "first"]
    second = F.when(F.coalesce("normal", "sure"), F.col("second"))
    return found.join(alike, key, "left").join(own, key, "left").select("chrom", "pos", F.col("end").alias("end_pos"), "svtype", "first", second.alias("second"), F.size("samples").cast("long").alias("columns"))


@query(f"WITH g AS ({GTS}), x AS (SELECT *, row_number() OVER (PARTITION BY k, s, e, t, gt ORDER BY id) AS n FROM g WHERE side = 'O') SELECT k::VARCHAR AS chrom, s AS pos, e AS end_pos, t AS svtype, gt FROM x WHERE n = 1 AND (k, s, e, t, gt) NOT IN (SELECT (k, s, e, t, gt) FROM g WHERE side = 'F')")
def split_call_file(spark, sf_dir):
    path, (normal, somatic) = files.shared_folder(spark, "split"), two_files(spark, sf_dir)
    vcf.split_files(spark, normal, somatic, path)
    return vcf.read_calls(spark, f"{path}/*").select("chrom", "pos", F.col("end").alias("end_pos"), "svtype", F.col("samples")[0].alias("gt"))


@query("SELECT 'c' || s_nationkey AS chrom, s_suppkey AS s, s_suppkey + 9 AS e FROM supplier WHERE s_suppkey % 3 > 0")
def exclude_regions(spark, sf_dir):
    """Lines of regions, of which each third lacks its end."""
    path, n = files.shared_folder(spark, "exclude"), F.col("s_suppkey")
    V.table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string"), F.lit(","), n.cast("string"), F.lit(", "), F.when(n % 3 > 0, (n + 9).cast("string")).otherwise("x"))).write.text(path)
    return T.read_exclude(spark, path)


@query(f"SELECT chrom, pos AS s, e, 2.5::DOUBLE AS weight, 'svs' AS class, [svtype] AS ids FROM ({FILE_CALLS})")
def calls_as_units(spark, sf_dir):
    return C.as_units(vcf.read_calls(spark, f"{vcf_file(spark, sf_dir)}/*"), 2.5, "svs")


@query(f"SELECT chrom, pos, e AS end_pos, svtype, 'SVTYPE=' || svtype || ';END=' || e || ';SVLEN=' || (e - pos) AS info FROM ({FILE_CALLS})")
def positions_as_calls(spark, sf_dir):
    """Calls of a file as positions by type, and back."""
    found = C.as_calls(C.positions_by_type(vcf.read_calls(spark, f"{vcf_file(spark, sf_dir)}/*")))
    return found.select("chrom", "pos", F.col("end").alias("end_pos"), "svtype", "info")


@query("""WITH RECURSIVE d AS (
  SELECT p_partkey, p_name AS a, p_type AS b, 0 AS i, list_transform(range(0, length(p_type) + 1), lambda j: 3.0::DOUBLE * j) AS r FROM part
  UNION ALL SELECT p_partkey, a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: 3.0::DOUBLE * (j - k)
    + least(r[k] + 2.0::DOUBLE, CASE WHEN k > 1 THEN r[k - 1] + CASE WHEN substr(a, i + 1, 1) = substr(b, k - 1, 1) THEN 0.5 ELSE 4 END ELSE 1e9 END)))) FROM d WHERE i < length(a))
SELECT p_partkey, r[length(b) + 1] AS distance FROM d WHERE i = length(a)""")
def weighted_edit_distance(spark, sf_dir):
    return D.weighted_distance(V.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type", "distance", 2, 3, 4, 0.5).select("p_partkey", "distance")


UNITS = """
SELECT p_brand AS chrom, p_partkey * 3 AS s, p_partkey * 3 + p_size AS e, p_size::DOUBLE AS weight, 'g' || (p_partkey % 7) AS class, [p_name, 'x' ||
  p_partkey] AS ids FROM part
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = V.table(spark, sf_dir, "part"), F.col("p_partkey") * 3
    return p.select(F.col("p_brand").alias("chrom"), s.alias("s"), (s + F.col("p_size")).alias("e"), F.col("p_size").cast("double").alias("weight"), F.concat(F.lit("g"), (F.col("p_partkey") % 7).cast("string")).alias("class"), F.array("p_name", F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).alias("ids"))


def unit_file(spark: SparkSession, sf_dir: str) -> str:
    path = files.shared_folder(spark, "units")
    P.units_json(units(spark, sf_dir)).write.text(path)
    return path


@query(f"SELECT chrom, s, e, weight, class, list_sort(list_distinct(ids)) AS ids FROM ({UNITS})")
def units_json(spark, sf_dir):
    return P.read_units(spark, unit_file(spark, sf_dir)).drop("place")


@query(f"WITH u AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s, e) - 1 AS place FROM ({UNITS})) SELECT chrom, place, s, e, place * 2.5::DOUBLE AS weight FROM u")
def units_reweighted(spark, sf_dir):
    """Weights from another table with the same contigs and places."""
    path = unit_file(spark, sf_dir)
    weights = P.read_units(spark, path).select("chrom", "place", (F.col("place") * 2.5).alias("weight"))
    return P.read_units(spark, path, weights).select("chrom", "place", "s", "e", "weight")


@query(f"""
SELECT class, id, arg_max(weight, (chrom, s, e)) AS weight, arg_max(e - s + 1, (chrom, s, e)) AS length
  FROM (SELECT *, unnest(ids) AS id FROM ({UNITS})) GROUP BY class, id
""")
def unit_weights_by_id(spark, sf_dir):
    return P.weights_by_id(units(spark, sf_dir))


@query(f"SELECT k::VARCHAR AS chrom, s, e, 'm_' || row_number() OVER (ORDER BY k::VARCHAR, s, e) AS id FROM ({V.CALLS})")
def mask_unit_ids(spark, sf_dir):
    path = files.shared_folder(spark, "mask-units")
    mask = V.calls(spark, sf_dir).select(F.col("k").cast("string").alias("chrom"), "s", "e")
    T.mask_json(mask).select(F.concat(F.lit('{"'), "chrom", F.lit('":'), "pairs", F.lit("}"))).repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return P.mask_units(T.read_mask(spark, path), "m", 0.0).select("chrom", "s", "e", F.col("ids")[0].alias("id"))


def gene_map_file(spark: SparkSession, sf_dir: str) -> str:
    path = files.shared_folder(spark, "gene-map")
    P.write_gene_map(V.gene(spark, sf_dir), units(spark, sf_dir).withColumn("label", F.lit("own")), path)
    return path


@query(V.GENE)
def gene_map_json(spark, sf_dir):
    return P.read_gene_map(spark, gene_map_file(spark, sf_dir))[0]


@query(f"SELECT 'own' AS label, chrom, s, e, weight, class, list_sort(list_distinct(ids)) AS ids FROM ({UNITS})")
def gene_map_units(spark, sf_dir):
    return P.read_gene_map(spark, gene_map_file(spark, sf_dir))[1].drop("place")


PACKAGE = "SELECT 'k' || s_nationkey AS key, count(*) AS n, list_sort(list(s_suppkey)) AS ids FROM supplier GROUP BY s_nationkey"


def package(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s_suppkey")).alias("ids"))
    return s.select(F.concat(F.lit("k"), F.col("s_nationkey").cast("string")).alias("key"), F.to_json(F.struct("n", "ids")).alias("value"))


@query(PACKAGE)
def package_unpacked(spark, sf_dir):
    """A package of JSON documents, unpacked into a file a key and read back."""
    path, out = files.shared_folder(spark, "package"), files.shared_folder(spark, "unpacked")
    P.pack(package(spark, sf_dir)).write.text(path)
    P.write_by_key(P.unpack(spark, path), out)
    return P.read_by_key(spark, out).select("key", F.from_json("value", "n long, ids array<long>").alias("x")).select("key", "x.*")


@query(f"SELECT * FROM ({PACKAGE}) WHERE key LIKE 'k1%' OR key = 'k2'")
def package_packed(spark, sf_dir):
    """Files whose keys match patterns, packed into one document and read again."""
    out, path = files.shared_folder(spark, "parts"), files.shared_folder(spark, "packed")
    P.write_by_key(package(spark, sf_dir), out)
    P.pack(P.read_by_key(spark, out, ["k1*", "k2"])).write.text(path)
    return P.unpack(spark, path).select("key", F.from_json("value", "n long, ids array<long>").alias("x")).select("key", "x.*")


@query(f"""WITH g AS ({V.GENE}), w AS (SELECT * FROM (VALUES ('germline', 'gain', 'a', 2.0), ('germline', 'loss', 'a', 0.5), ('germline', 'gain', 'b', 7.0)) t(origin, effect, label, weight))
SELECT origin || '_' || label || '_' || effect || '_wcu' AS key, chrom, s, e, weight::DOUBLE AS weight, label AS class, list_sort(list(DISTINCT symbol)) AS ids
FROM g JOIN w ON (label = 'a' AND s % 3 = 0) OR (label = 'b' AND s % 4 = 0) GROUP BY ALL""")
def effect_files(spark, sf_dir):
    """Files of two gene lists, one list written anew beside the other."""
    out, genes = files.shared_folder(spark, "effects"), V.gene(spark, sf_dir)
    weights = spark.createDataFrame([("a", "germline_gain", 2.0), ("a", "germline_loss", 0.5), ("b", "germline_gain", 7.0)], "label string, effect string, weight double")
    for label, n, factor in (("a", 3, 100.0), ("b", 4, 1.0), ("a", 3, 1.0)):
        own = genes.filter(F.col("s") % n == 0)
        P.write_by_key(P.effect_files(own.select("symbol"), own, weights.filter(F.col("label") == label).withColumn("weight", F.col("weight") * factor), label), out)
    return P.units(P.read_by_key(spark, out)).drop("place")


@query("SELECT s_name AS name, coalesce(sum(s_suppkey) OVER (ORDER BY s_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM supplier")
def offsets_json(spark, sf_dir):
    path = files.shared_folder(spark, "offsets")
    P.write_offsets(V.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("length")), path)
    return P.read_offsets(spark, path)


@query("SELECT n_nationkey::VARCHAR AS clone, n_nationkey % 4 > 0 AS alive, floor(log2(n_nationkey + 1))::INTEGER AS depth, n_regionkey AS freq FROM nation")
def clone_tree_written(spark, sf_dir):
    path, n = files.shared_folder(spark, "clone-tree"), V.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    nodes = n.select(key.alias("clone"), (F.col("n_nationkey") % 4 > 0).alias("alive"), F.floor(F.log2(F.col("n_nationkey") + 1)).cast("int").alias("depth"), F.col("n_regionkey").alias("freq"))
    edges = V.tree(spark, sf_dir).select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"))
    P.write_clone_tree(edges, nodes, path)
    return T.read_clone_tree(spark, path)[1]


@query(f"SELECT k::VARCHAR AS chrom, s, e, count(*) AS n FROM ({V.CALLS}) GROUP BY ALL")
def mask_bed(spark, sf_dir):
    path = files.shared_folder(spark, "mask-bed")
    P.mask_to_bed(V.calls(spark, sf_dir).select(F.col("k").cast("string").alias("chrom"), "s", "e"), path)
    return T.read_bed(spark, path, "b").groupBy("chrom", "s", "e").agg(F.count("*").alias("n"))


@query(f"SELECT id, t, k, s, e FROM ({V.CALLS}) WHERE id % 5 > 0")
def calls_json_lines(spark, sf_dir):
    """JSON lines of calls, of which each fifth is cut off in the middle."""
    path, cut = files.shared_folder(spark, "calls-json"), files.shared_folder(spark, "calls-json-cut")
    P.write_call_json(V.calls(spark, sf_dir).select("id", "t", "k", "s", "e"), path)
    lines = spark.read.text(path)
    id = F.get_json_object("value", "$.id").cast("long")
    lines.select(F.when(id % 5 == 0, F.left("value", F.length("value") - 3)).otherwise(F.col("value"))).write.text(cut)
    return P.read_call_json(spark, cut, "id long, t string, k long, s long, e long")


@query("""
SELECT o_orderkey AS id, [o_orderkey % 2, o_custkey % 2]::INTEGER[] AS alleles, (o_custkey % 2) || '|' || (o_orderkey % 2) || chr(9) || '0|1' AS
  written, '0|1' || chr(9) || '0|1' || chr(9) || '0|1' AS germline FROM orders
""")
def genotypes(spark, sf_dir):
    a, b = (F.col("o_orderkey") % 2).cast("int"), (F.col("o_custkey") % 2).cast("int")
    call = F.concat(F.lit("./1\t"), a.cast("string"), F.lit("/"), b.cast("string"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.genotype(call, 1).alias("alleles"), C.set_genotypes(F.array(F.array(b, a), F.array(F.lit(0), F.lit(1)))).alias("written"), C.repeated_genotype(F.lit("0|1"), 3).alias("germline"))


@query("""
SELECT 'c' || (o_custkey % 25) AS chrom, floor(o_totalprice / 10)::BIGINT AS s, floor(o_totalprice / 10)::BIGINT + 9 AS e
  FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0
""")
def complex_inversions(spark, sf_dir):
    o, pos = V.table(spark, sf_dir, "orders"), F.floor(F.col("o_totalprice") / 10)
    info = F.concat(F.lit("SVTYPE=INV;INV_TYPE="), F.when(F.col("o_orderkey") % 2 == 0, "COMPLEX").otherwise("PERFECT"))
    calls = o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("chrom"), pos.alias("pos"), (pos + 9).alias("end"), F.when(F.col("o_orderkey") % 3 == 0, "INV").otherwise("DUP").alias("svtype"), info.alias("info"))
    return vcf.complex_inversions(calls)


@query("SELECT o_orderkey AS id, 'INTER' AS type, 'chr' || (o_custkey % 25) AS contig, o_custkey AS s, o_custkey + 5 AS e FROM orders")
def translocation_info(spark, sf_dir):
    c = F.col("o_custkey")
    info = F.concat(F.lit("SVTYPE=TRA;TRA_TYPE=INTER;CHR2=chr"), (c % 25).cast("string"), F.lit(";POS2="), c.cast("string"), F.lit(";END2="), (c + 5).cast("string"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.translocation(info).alias("t")).select("id", "t.*")


@query("""
SELECT o_orderkey AS id, 'SVTYPE=DUP;END=' || o_custkey || ';DUP_POS=' || o_custkey || ',' || (o_custkey + 3) || ';DUP_TYPE=DISPERSED;ICN=' ||
  (o_orderkey % 5) AS info FROM orders
""")
def duplication_set(spark, sf_dir):
    c = F.col("o_custkey")
    info = F.concat(F.lit("SVTYPE=DUP;ICN=9;END="), c.cast("string"), F.lit(";DUP_TYPE=TANDEM"))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.set_duplication(info, F.lit("DISPERSED"), F.col("o_orderkey") % 5, F.array(c, c + 3)).alias("info"))


#: SQL: what no interval of the left side, and what none of the right side, covers of each contig.
OPEN = """
SELECT '{side}' AS side, k, min(p) AS s, max(p) AS e FROM (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS i
  FROM (SELECT k, p FROM m EXCEPT SELECT k, unnest(range(s, e + 1)) FROM c
  WHERE side = '{side}')) GROUP BY k, i
"""


@query(f"WITH c AS ({V.CALLS}), m AS (SELECT k, unnest(range(0, max(e) + 1)) AS p FROM c GROUP BY k) {OPEN.format(side='F')} UNION ALL {OPEN.format(side='O')}")
def open_positions_by_side(spark, sf_dir):
    """Contigs less the small calls and less the large ones, each."""
    c = V.calls(spark, sf_dir)
    limits = c.groupBy("k").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e"))
    both = c.filter("side <> 'P'").select("side", "k", "s", "e")
    return I.complement(both, both.select("side").distinct().join(F.broadcast(limits)), ["side", "k"])


@query("SELECT max(child)::BIGINT AS highest FROM (SELECT n_nationkey AS child FROM nation WHERE n_nationkey > 0)")
def highest_clone(spark, sf_dir):
    path = files.shared_folder(spark, "pedigree")
    edges = V.tree(spark, sf_dir).select(F.concat(F.lit("S_"), F.col("parent").cast("string")).alias("parent"), F.concat(F.lit("S_"), F.col("child").cast("string")).alias("child"))
    vcf.write_calls(call_rows(spark, sf_dir), path, ["one", "two"], edges)
    return vcf.highest_clone(vcf.pedigree(spark, f"{path}/0-header"))


@query("SELECT c_name AS sample FROM customer ORDER BY md5('7:' || c_name), c_custkey LIMIT 5")
def any_samples(spark, sf_dir):
    samples = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("sample"))
    return vcf.any_samples(samples, 5).select("sample")


@query(f"""WITH {HITS}, x AS (SELECT DISTINCT p_partkey AS symbol, CASE WHEN p_size > 25 THEN '+' ELSE '-' END AS rna FROM part),
d AS (SELECT effect, symbol FROM c WHERE sample = 'S1' EXCEPT SELECT effect, symbol FROM c WHERE kind = 'B')
SELECT gene_list, symbol, CASE effect WHEN 'gain' THEN 'DUP' ELSE 'DEL' END AS sv, rna FROM d JOIN l USING (symbol) JOIN x USING (symbol) WHERE effect <> 'other'""")
def report_file(spark, sf_dir):
    """The branches of calls beside expression, written as a report and read back."""
    path, found = files.shared_folder(spark, "report"), hits(spark, sf_dir)
    rna = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") > 25, "+").otherwise("-").alias("rna"))
    E.write_report(E.calls_beside_expression(found.filter("sample = 'S1'"), found.filter("kind = 'B'"), lists(found), rna), path)
    return spark.read.option("sep", "\t").option("header", True).schema("gene_list string, symbol long, sv string, rna string").csv(path)


#: SQL: calls of files that are not from 50 to 300 bases long are left out, and what touches is joined.
SIZED = f"""
SELECT DISTINCT svtype AS t, 'F' AS side, chrom AS k, pos AS s, e FROM ({FILE_CALLS})
  WHERE n % 2 = 0 AND e - pos + 1 BETWEEN 50 AND 300 UNION ALL SELECT DISTINCT svtype, 'O', chrom, pos, e
  FROM ({FILE_CALLS}) WHERE n % 3 > 0 AND e - pos + 1 BETWEEN 50 AND 300
"""
JOINED = f"""
SELECT t, side, k, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY t, side, k ORDER BY s, e) AS g
  FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY t, side, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0
  END AS new FROM ({SIZED}))) GROUP BY t, side, k, g
"""


@query(f"""WITH c AS ({JOINED}), h AS (SELECT a.t, a.k, a.s AS x, b.s AS y FROM c a JOIN c b ON a.t = b.t AND a.k = b.k AND a.s <= b.e AND a.e >= b.s AND {SIMILAR} >= 0.5 WHERE a.side = 'F' AND b.side = 'O'),
m AS (SELECT t, count(*) FILTER (WHERE side = 'F') AS n_a, count(*) FILTER (WHERE side = 'O') AS n_b FROM c GROUP BY t),
k AS (SELECT t, count(DISTINCT (k, x)) AS x, count(DISTINCT (k, y)) AS y FROM h GROUP BY t),
z AS (SELECT m.*, coalesce(coalesce(x, 0) / nullif(n_a, 0), 0) AS p, coalesce(coalesce(y, 0) / nullif(n_b, 0), 0) AS r FROM m LEFT JOIN k USING (t))
SELECT t AS svtype, n_a, n_b, round(p, 9) AS prec, round(r, 9) AS rec, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM z""")
def call_file_metrics(spark, sf_dir):
    paths = [files.shared_folder(spark, name) for name in ("metrics-a", "metrics-b")]
    rows = call_rows(spark, sf_dir)
    for path, keep in zip(paths, ("n % 2 = 0", "n % 3 > 0"), strict=True):
        vcf.write_calls(rows.filter(keep), path, ["one", "two"])
    return vcf.metrics(spark, f"{paths[0]}/*", f"{paths[1]}/*", 50, 300, True).drop("j")
