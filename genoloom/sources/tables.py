"""BED, masks, gene tables and lists, JSON maps, FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators.intervals import merge
from genoloom.sources.files import lines


def read_bed(spark: SparkSession, path: str, label: str, together: bool = False) -> DataFrame:
    """(chrom, s, e, id): ids are label and 1-based line number, with ``together`` through all files in order of their names.

    Lines without two whole numbers are dropped.
    """
    fields = lines(spark, path, together).select(F.split("value", "\t").alias("f"), (F.col("number") + 1).alias("n"))
    rows = fields.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("s"), F.get("f", F.lit(2)).try_cast("long").alias("e"), F.concat_ws("_", F.lit(label), "n").alias("id"))
    return rows.filter("s IS NOT NULL AND e IS NOT NULL")


def write_bedgraph(intervals: DataFrame, path: str, sign: int = 1) -> None:
    """chrom, start, end and signed weight."""
    intervals.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), (F.col("weight") * sign).cast("string"))).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One column ``value`` a file, parsed by ``schema``."""
    return spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("value"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e) of a JSON map of contigs to pairs."""
    found = read_json(spark, path, "map<string,array<array<bigint>>>").select(F.explode("value").alias("chrom", "pairs"))
    return found.select("chrom", F.explode("pairs").alias("p")).select("chrom", F.col("p")[0].alias("s"), F.col("p")[1].alias("e"))


def mask_json(mask: DataFrame) -> DataFrame:
    """One row a contig: its sorted pairs as JSON."""
    return mask.groupBy("chrom").agg(F.to_json(F.array_sort(F.collect_list(F.array("s", "e")))).alias("pairs"))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(layer, svtype, size, rate, het) of a JSON map layer -> type -> {"l:n": {size: rate}, "h": het}, keys as numbers."""
    inner = "map<string,map<string,struct<`l:n`:map<string,double>,h:double>>>"
    found = read_json(spark, path, inner).select(F.explode("value").alias("layer", "types")).select("layer", F.explode("types").alias("svtype", "x"))
    return found.select(F.col("layer").cast("int").alias("layer"), "svtype", F.col("x.h").alias("het"), F.explode(F.col("x.l:n")).alias("size", "rate")).withColumn("size", F.col("size").cast("double"))


def read_aneuploidy(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, ploidy, copies, chance)."""
    found = read_json(spark, path, "map<string,struct<dist:map<string,double>,n:int>>").select(F.explode("value").alias("chrom", "x"))
    return found.select("chrom", F.col("x.n").alias("ploidy"), F.explode("x.dist").alias("copies", "chance")).withColumn("copies", F.col("copies").cast("int"))


def read_clone_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (parent, child) and nodes (clone, alive, depth, freq) of a tree's JSON."""
    tree = read_json(spark, path, "struct<tree:map<string,array<string>>,alive:map<string,boolean>,depth:map<string,int>,freq:map<string,int>>").select("value.*")
    edges = tree.select(F.explode("tree").alias("parent", "children")).select("parent", F.explode("children").alias("child"))
    nodes = tree.select(F.explode("alive").alias("clone", "alive"), "depth", "freq")
    return edges, nodes.select("clone", "alive", F.col("depth")[F.col("clone")].alias("depth"), F.col("freq")[F.col("clone")].alias("freq"))


def read_exclude(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, s, e) of lines ``contig,start,end``; lines without a contig or two whole numbers are dropped."""
    f = spark.read.text(path).select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("f"))
    rows = f.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("s"), F.get("f", F.lit(2)).try_cast("long").alias("e"))
    return rows.filter("chrom <> '' AND s IS NOT NULL AND e IS NOT NULL")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("symbol"))


def read_genes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genes and exons (symbol, chrom, s, e) of a tab-separated transcript table.

    Fixed places: 2 contig, 4 and 5 transcript bounds, 9 and 10 exon starts and ends, 12 symbol. Transcripts of a symbol
    that overlap or touch are one gene; equal exons count once. Rows of fewer columns are dropped.
    """
    def at(i: int) -> Column:
        return F.get("f", F.lit(i))

    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") > 12)
    rows = f.select(at(12).alias("symbol"), at(2).alias("chrom"), at(4).try_cast("long").alias("s"), at(5).try_cast("long").alias("e"), *(F.filter(F.transform(F.split(at(i), ","), lambda x: x.try_cast("long")), lambda x: x.isNotNull()).alias(n) for i, n in ((9, "starts"), (10, "ends")))).filter("s IS NOT NULL AND e IS NOT NULL")
    exons = rows.select("symbol", "chrom", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("symbol", "chrom", F.col("x.starts").alias("s"), F.col("x.ends").alias("e")).distinct()
    return merge(rows, ["symbol", "chrom"]), exons


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): a record begins with a line that starts with ``>``; its name is the first word. A contig is one row."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    return records.select(F.regexp_extract("r", "^(\\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace("r", "^[^\\n]*", ""), "\\s", "").alias("seq"))


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """One record a (name, seq), lines of ``width``."""
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped)).write.text(path)


def windows(sequences: DataFrame, size: int) -> DataFrame:
    """(name, chunk, seq): a contig cut into pieces of ``size`` in one pass over it. An empty one has one empty piece."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.select("name", F.posexplode(F.when(F.length("seq") > 0, pieces).otherwise(F.array(F.lit("")))).alias("chunk", "seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, id, seq, plus, qual) of records of four lines; a last incomplete one is dropped."""
    rows = lines(spark, path).withColumn("record", F.floor(F.col("number") / 4)).groupBy("file", "record")
    fields = [F.max(F.when(F.col("number") % 4 == i, F.col("value"))).alias(x) for i, x in enumerate(("id", "seq", "plus", "qual"))]
    return rows.agg(*fields).filter("qual IS NOT NULL")


def sampled(records: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """Each record number with chance ``share``: mates of one number stay together."""
    return records.filter(chosen(F.col("record"), share, seed))


def chosen(number: Column, share: float, seed: int) -> Column:
    """Whether the first 20 bits of the MD5 of ``seed:number`` are below the share."""
    if share >= 1:
        return F.lit(True)
    return F.left(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"))), F.lit(5)) < f"{int(share * (1 << 20)):05x}"
