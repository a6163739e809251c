"""Variant-call files: readers, header readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.text import inversion
from genoloom.operators.calls import contig_order, info_replace, info_value, reverse_complement
from genoloom.operators.compare import score
from genoloom.operators.intervals import merge
from genoloom.operators.somatic import merged, split
from genoloom.sources.files import kept, lines, numbered

#: Columns of the format.
FIXED = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
#: Declarations of the INFO keys, types and genotype that the library reads and writes.
DECLARED = [
    *(f"##INFO=<ID={k},Number={n},Type={t},Description=\"{d}\">" for k, n, t, d in [
        ("END", 1, "Integer", "Last position"), ("SVLEN", 1, "Integer", "Length"), ("SVTYPE", 1, "String", "Type"), ("DUP_POS", ".", "Integer", "Places of the copies"),
        ("DUP_TYPE", 1, "String", "Kind of duplication"), ("ICN", 1, "Integer", "Copies"), ("CHR2", 1, "String", "Other contig"), ("SVEX", 1, "Float", "Expected quality"),
    ]),
    *(f"##ALT=<ID={x},Description=\"{d}\">" for x, d in [("DEL", "Deletion"), ("DUP", "Duplication"), ("INV", "Inversion"), ("INS", "Insertion"), ("TRA", "Translocation")]),
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
]
HEADER = "#" + "\t".join(x.upper() for x in FIXED)


def read_calls(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """FIXED, format, samples, svtype and end of each call.

    The end is INFO's END, else pos + abs(SVLEN); the type is SVTYPE, else MERGE_TYPE. Rows with fewer than 8 columns, a
    position that is no number, no type or no end are dropped, as are contigs other than ``contigs`` if given. Of
    repeated keys in INFO the last counts.
    """
    fields = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= len(FIXED))
    calls = fields.select(*(F.get("f", F.lit(i)).alias(x) for i, x in enumerate(FIXED)), F.get("f", F.lit(8)).alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"))
    info = F.col("info")
    length = F.abs(info_value(info, "SVLEN").try_cast("long"))
    calls = calls.withColumn("pos", F.col("pos").try_cast("long")).withColumn("svtype", F.coalesce(info_value(info, "SVTYPE"), info_value(info, "MERGE_TYPE")))
    calls = calls.withColumn("end", F.coalesce(info_value(info, "END").try_cast("long"), F.col("pos") + length)).filter("pos IS NOT NULL AND svtype IS NOT NULL AND end IS NOT NULL")
    return calls.filter(F.col("chrom").isin(contigs)) if contigs is not None else calls


def call_intervals(calls: DataFrame, low: int = 0, high: int = 1 << 62) -> DataFrame:
    """(chrom, s, e, svtype, ids): distinct calls as intervals with s <= e and low <= e - s + 1 <= high.

    The id is INFO's SAMPLE, of which one row an ID counts, else the ID. What the lines say is written first, so that they
    are taken apart once.
    """
    sample = info_value(F.col("info"), "SAMPLE")
    rows = calls.select("chrom", F.least("pos", "end").alias("s"), F.greatest("pos", "end").alias("e"), "svtype", "id", sample.alias("sample"))
    rows = kept(rows, "call-rows")
    first = rows.filter("sample IS NOT NULL").groupBy("id").agg(F.min(F.struct("chrom", "s", "e", "svtype", "sample")).alias("r")).select("r.*")
    plain = rows.filter("sample IS NULL").select("chrom", "s", "e", "svtype", F.col("id").alias("sample"))
    return first.union(plain).filter(F.expr(f"e - s + 1 BETWEEN {low} AND {high}")).groupBy("chrom", "s", "e", "svtype").agg(F.array_sort(F.collect_set("sample")).alias("ids"))


def alleles(genotype: Column) -> Column:
    """Allele numbers of ``a|b``, ``a/b`` or ``a``; a missing one is 0."""
    return F.transform(F.split(F.split_part(genotype, F.lit(":"), F.lit(1)), "[|/]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def sample_calls(calls: DataFrame, sample: int) -> DataFrame:
    """Calls that the sample (0-based column) carries, with gt, its copy number cn and its allele frequency af.

    An allele's copies are those of its ``<CNn>`` in ALT, 1 for the reference, 0 else. CNV becomes DEL below two copies
    and DUP above, unless a deleted allele is present. Equal calls count once.
    """
    gt = calls.withColumn("gt", alleles(F.get("samples", F.lit(sample)))).filter(F.exists("gt", lambda a: a > 0))
    alts = F.split("alt", ",")
    copies = F.transform("gt", lambda a: F.when(a == 0, 1).otherwise(F.coalesce(F.regexp_extract(F.get(alts, a - 1), "<CN(\\d+)>", 1).try_cast("int"), F.lit(0))))
    gt = gt.withColumn("copies", copies).withColumn("cn", F.aggregate("copies", F.lit(0), lambda x, y: x + y))
    frequency = F.split(info_value(F.col("info"), "AF"), ",")
    carried = F.filter(F.transform("gt", lambda a: F.get(frequency, a - 1).try_cast("double")), lambda x: x.isNotNull())
    kind = F.when((F.col("svtype") == "CNV") & (F.col("cn") < 2), "DEL").when((F.col("svtype") == "CNV") & (F.col("cn") > 2) & ~F.array_contains("copies", 0), "DUP").otherwise(F.col("svtype"))
    return gt.withColumn("af", F.array_max(carried)).withColumn("svtype", kind).drop("copies").dropDuplicates(["chrom", "pos", "end", "svtype"])


def header_samples(spark: SparkSession, path: str) -> DataFrame:
    """(place, sample): names of the sample columns."""
    return spark.read.text(path).filter(F.col("value").startswith("#CHROM")).select(F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 20)).alias("place", "sample"))


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of the PEDIGREE lines of a header."""
    found = spark.read.text(path).filter(F.col("value").startswith("##PEDIGREE="))
    return found.select(F.regexp_extract("value", "Original=([^,>]*)", 1).alias("parent"), F.regexp_extract("value", "Derived=([^,>]*)", 1).alias("child"))


def header_lines(spark: SparkSession, reference: str, contigs: DataFrame | None, edges: DataFrame | None, columns: list[str]) -> DataFrame:
    """(part, at, value): the lines of a header in their order: declarations, contigs by place, pedigree, column names."""
    top = ["##fileformat=VCFv4.2", f"##reference={reference}", *DECLARED]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(top)] + [(3, 0, "\t".join(columns))], "part int, at long, value string")
    if contigs is not None:
        rows = rows.union(contigs.select(F.lit(1), F.col("place").cast("long"), F.concat(F.lit("##contig=<ID="), "name", F.lit(",length="), F.col("size").cast("string"), F.lit(">"))))
    if edges is not None:
        derived = F.concat(F.lit("##PEDIGREE=<Derived="), "child", F.lit(",Original="), "parent", F.lit(">"))
        rows = rows.union(edges.select(F.lit(2), F.lit(0).cast("long"), derived))
    return rows


def write_calls(calls: DataFrame, path: str, samples: list[str] = (), edges: DataFrame | None = None, prefix: str = "gv_", contigs: DataFrame | None = None, reference: str = "") -> None:
    """Header, then the calls by (contig, pos), numbered over all of them: put together by name, the files are one sorted file.

    The header has a line for each of ``contigs`` (place, name, size) and of ``edges`` (parent, child). Calls with an empty
    or null REF have a number but no line, the others' REF is cut to its first base; a null QUAL or FILTER is a dot.
    ``samples`` names the columns of the array column ``samples``. The header is the first file; those of the calls are
    ranges of their numbers, so their names go in the order of what they hold.
    """
    spark = calls.sparkSession
    columns = [HEADER, *(["FORMAT", *samples] if samples else [])]
    header_lines(spark, reference, contigs, edges, columns).repartition(1).sortWithinPartitions("part", "at", "value").select("value").write.text(f"{path}/0-header")
    rows = numbered(calls.withColumn("contig_key", contig_order(F.col("chrom"))), ["contig_key", "pos", "end", "svtype", "info"]).withColumn("id", F.concat(F.lit(prefix), "number"))
    rows = rows.filter("length(ref) > 0").withColumn("ref", F.left("ref", F.lit(1))).withColumns({x: F.coalesce(F.col(x), F.lit(".")) for x in ("qual", "filter")})
    fields = [F.col(x).cast("string") for x in FIXED] + ([F.lit("GT"), F.array_join("samples", "\t")] if samples else [])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "number").sortWithinPartitions("number").select(F.concat_ws("\t", *fields)).write.text(f"{path}/1-calls")


def kept_header(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, value): the header lines of a file, or of files that follow one another by name, in their order."""
    rows = lines(spark, path).filter(F.col("value").startswith("#"))
    return rows.groupBy("value").agg(F.min(F.struct("file", "number")).alias("at")).select("at", "value")


def write_lines(spark: SparkSession, header: str, rows: DataFrame, path: str) -> None:
    """The header of the files ``header`` and ``rows`` (FIXED, format, gts, contig_key) by (contig, pos); ids stay."""
    kept_header(spark, header).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{path}/0-header")
    fields = [F.coalesce(F.col(x).cast("string"), F.lit(".")) for x in [*FIXED, "format"]]
    order = ["contig_key", "pos", "end", "svtype", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("contig_key", contig_order(F.col("chrom")))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.concat_ws("\t", *fields, F.array_join("gts", "\t"))).write.text(f"{path}/1-calls")


KEY = ["chrom", "pos", "end", "svtype"]


def merge_files(spark: SparkSession, normal: str, somatic: str, path: str) -> None:
    """One file of the calls of a normal and a somatic file, sorted, under the header of the somatic one.

    Calls are the same by contig, position, end, type and first genotype; a normal one wins and has its genotype in the
    column of each clone of the pedigree and of the root. A normal sample that the pedigree does not know is an error.
    """
    edges, sample = pedigree(spark, somatic), header_samples(spark, normal).orderBy(F.desc("place")).select("sample").first()
    known = edges.select(F.col("parent").alias("sample")).union(edges.select("child")).filter(F.col("sample") == (sample[0] if sample else ""))
    if not known.limit(1).count():
        raise ValueError("the sample of the normal file is not in the pedigree of the somatic one")
    sides = [read_calls(spark, x).withColumnRenamed("samples", "gts") for x in (normal, somatic)]
    write_lines(spark, somatic, merged(*sides, highest_clone(edges).first()[0] or 0, KEY), path)


def split_files(spark: SparkSession, normal: str, somatic: str, path: str) -> None:
    """The calls of a somatic file that are not in a normal one, each once (the least id), sorted, under the somatic header."""
    sides = [read_calls(spark, x).withColumnRenamed("samples", "gts") for x in (normal, somatic)]
    own = split(sides[1], sides[0], KEY).select("id", *KEY, "gt").withColumnsRenamed({x: f"own_{x}" for x in ["id", *KEY, "gt"]})
    same = F.lit(True)
    for x in ["id", *KEY]:
        same = same & (F.col(x) == F.col(f"own_{x}"))
    write_lines(spark, somatic, sides[1].join(own, same & F.get("gts", F.lit(0)).eqNullSafe(F.col("own_gt")), "left_semi"), path)


def with_sequences(calls: DataFrame, chunks: DataFrame, size: int, sexes: tuple[str, str] = ("X", "Y")) -> DataFrame:
    """Calls once by (chrom, pos, end, svtype) with REF and ALT from the sequence, INFO completed, and genotype ``gt``.

    ``chunks`` (name, chunk, seq) are pieces of ``size`` of the contigs: a call meets just those it lies over, and they are
    put together in order, so no contig is one row. REF is the sequence from pos (0-based) to end, without end, of a
    deletion (ALT ``<DEL>``), duplication or inversion (ALT its reverse complement); a part beyond the contig is missing,
    and without a contig REF is empty. Of calls with a genotype column deletions and insertions get SVLEN + 1 and
    inversions INV_TYPE, and gt is the first column; others get SVLEN end - pos + 1 and gt ``0|1``. Duplications get
    DUP_POS, DUP_TYPE and ICN. Where both ``sexes`` have calls, their gt is ``1``. Of equal calls the least id counts.
    """
    key = ["chrom", "pos", "end", "svtype"]
    once = calls.groupBy(*key).agg(F.min(F.struct("id", "ref", "alt", "qual", "filter", "info", "samples")).alias("row")).select(*key, "row.*")
    place = F.col("chunk") * size
    wanted = once.filter(F.col("svtype").isin("DEL", "DUP", "INV") & (F.col("end") > F.col("pos")) & (F.col("pos") >= 0)).select(*key, F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"))
    begin, stop = F.greatest(F.col("pos") - place, F.lit(0)), F.least(F.col("end") - place, F.lit(size))
    piece = F.substring("seq", (begin + 1).cast("int"), (stop - begin).cast("int"))
    met = wanted.join(chunks.select(F.col("name").alias("chrom"), F.col("chunk").cast("long").alias("chunk"), "seq"), ["chrom", "chunk"])
    found = met.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", piece.alias("piece")))), lambda x: x["piece"]), "").alias("found"))
    rows = once.join(found, key, "left")
    kind, info, own = F.col("svtype"), F.col("info"), F.size("samples") > 0
    cut = kind.isin("DEL", "DUP", "INV")
    longer = info_replace(info, "SVLEN", F.coalesce(info_value(info, "SVLEN").try_cast("long"), F.lit(0)) + 1)
    length = F.concat(info, F.lit(";SVLEN="), (F.col("end") - F.col("pos") + 1).cast("string"))
    base = F.when(own & kind.isin("DEL", "INS"), longer).when(own, info).otherwise(length)
    extra = F.when(kind == "DUP", F.concat(F.lit(";DUP_POS="), F.col("pos").cast("string"), F.lit(";DUP_TYPE=TANDEM;ICN=4"))).when(own & (kind == "INV"), F.lit(";INV_TYPE=PERFECT")).otherwise("")
    ref = F.when(cut, F.coalesce("found", F.lit(""))).otherwise(F.col("ref"))
    alt = F.when(kind == "DEL", "<DEL>").when(kind == "INV", reverse_complement(ref)).otherwise(F.col("alt"))
    seen = once.agg(*((F.count_if(F.col("chrom") == x) > 0).alias(f"has_{i}") for i, x in enumerate(sexes)))
    gt = F.when(F.col("has_0") & F.col("has_1") & F.col("chrom").isin(list(sexes)), "1").when(own, F.get("samples", F.lit(0))).otherwise("0|1")
    return rows.join(F.broadcast(seen)).select(*key, "id", ref.alias("ref"), alt.alias("alt"), "qual", "filter", F.concat(base, extra).alias("info"), gt.alias("gt"))


def metrics(spark: SparkSession, first: str, second: str, low: int = 0, high: int = 1 << 62, joined: bool = False, r: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and covered share of each type of two call files, as ``compare.score`` has them.

    Calls outside [low, high] bases are left out; with ``joined`` those of a type and contig that overlap or touch are one.
    """
    sides = []
    for path in (first, second):
        rows = call_intervals(read_calls(spark, path), low, high).select("svtype", "chrom", "s", "e")
        rows = merge(rows, ["svtype", "chrom"]) if joined else rows
        sides.append(rows.withColumn("id", F.struct("chrom", "s", "e")))
    return score(*sides, "svtype", ["svtype", "chrom"], "id", r)


def complex_inversions(calls: DataFrame) -> DataFrame:
    """(chrom, s, e) of the inversions that are COMPLEX."""
    return calls.filter((F.col("svtype") == "INV") & (inversion(F.col("info"))["type"] == "COMPLEX")).select("chrom", F.col("pos").alias("s"), F.col("end").alias("e"))


def highest_clone(edges: DataFrame) -> DataFrame:
    """(highest): the largest number behind the last ``_`` of a derived clone's name; null if no name has one."""
    return edges.agg(F.max(F.element_at(F.split("child", "_"), -1).try_cast("long")).alias("highest"))


def any_samples(samples: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` of the sample columns (place, sample), chosen by a seeded hash of the name, the same each time."""
    return samples.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "sample")), "place").limit(n)


def renumber(calls: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """IDs replaced by prefix and number in the given order."""
    return numbered(calls, order).withColumn("id", F.concat(F.lit(prefix), F.col("number").cast("string"))).drop("number")


def write_clone_calls(calls: DataFrame, path: str) -> None:
    """A folder of calls for each clone (place in ``samples``) whose genotype has allele 1."""
    each = calls.select("chrom", "pos", "id", "svtype", F.posexplode("samples").alias("clone", "gt")).filter(F.contains("gt", F.lit("1")))
    each.select("clone", F.concat_ws("\t", *(F.col(x).cast("string") for x in ("chrom", "pos", "id", "svtype", "gt"))).alias("value")).write.partitionBy("clone").text(path)
