"""Variant-call tables: (k, s, e) keyed set operations, genotypes, INFO strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["k", "s", "e"]
#: IUPAC letters and their complements, ambiguity codes resolved to one base.
FROM_BASES = "AaTtCcGguUmMrRwWsSyYkKvVhHdDbBxXnN"
TO_BASES = "TtAaGgCcAATTCCGGAAGGCCTTGGCCAANNNN"


def call_union(a: DataFrame, b: DataFrame, order: str, key: list[str] = KEY) -> DataFrame:
    """One row a key: a's before b's, of a side the one latest in ``order``."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("side", F.desc(order)))).filter("rn = 1").drop("rn")


def call_difference(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_anti")


def info_value(info: Column, key: str) -> Column:
    """The value of the key's last entry, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(info, F.lit(f"(?:^|;){key}=([^;]*)"), F.lit(1)), F.lit(-1))


def info_replace(info: Column, key: str, value: Column) -> Column:
    """The value of each entry of the key replaced; every other token stays."""
    return F.array_join(F.transform(F.split(info, ";"), lambda t: F.when(t.startswith(f"{key}="), F.concat(F.lit(f"{key}="), value.cast("string"))).otherwise(t)), ";")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, FROM_BASES, TO_BASES))


def mask_genotype(call: Column, loss: Column) -> Column:
    """Alleles on haplotypes that are lost become 0."""
    return F.zip_with(call, loss, lambda a, b: F.when((a == 1) & (b == 1), 0).otherwise(a))


def contig_order(chrom: Column) -> Column:
    return F.lpad(chrom, 100, "0")


def genotype(call: Column, clone: int) -> Column:
    """Alleles of a clone of ``a|b`` genotypes joined by tabs, as numbers; a missing one is 0, of an unknown clone null."""
    own = F.get(F.split(call, "\t"), F.lit(clone))
    return F.transform(F.split(own, "[|/]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def set_genotypes(alleles: Column) -> Column:
    """The genotype column of an array of clones' alleles."""
    return F.array_join(F.transform(alleles, lambda x: F.array_join(F.transform(x, lambda a: a.cast("string")), "|")), "\t")


def repeated_genotype(call: Column, clones: int) -> Column:
    """A germline genotype for each of ``clones`` clones."""
    return F.array_join(F.array_repeat(call, clones), "\t")


def as_units(calls: DataFrame, weight: float, label: str) -> DataFrame:
    """Calls (chrom, pos, end, svtype) as weighted units of class ``label`` whose id is the type."""
    return calls.select("chrom", F.col("pos").alias("s"), F.col("end").alias("e"), F.lit(weight).alias("weight"), F.lit(label).alias("class"), F.array("svtype").alias("ids"))


def positions_by_type(calls: DataFrame) -> DataFrame:
    """(chrom, svtype, s, e) of calls."""
    return calls.select("chrom", "svtype", F.col("pos").alias("s"), F.col("end").alias("e"))


def as_calls(positions: DataFrame) -> DataFrame:
    """Positions (chrom, svtype, s, e) as calls with INFO."""
    info = F.concat(F.lit("SVTYPE="), "svtype", F.lit(";END="), F.col("e").cast("string"), F.lit(";SVLEN="), (F.col("e") - F.col("s")).cast("string"))
    return positions.select("chrom", F.col("s").alias("pos"), F.col("e").alias("end"), "svtype", info.alias("info"))
