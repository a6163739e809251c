"""Reports of genes hit by calls: log odds against a background, calls beside expression, regions on a joint axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of samples in the report, and what a gain and a loss of a gene are called.
BACKGROUND, CLASSES, BOTH = "B", ["T", "N"], "TN"
EVENTS = {"gain": "DUP", "loss": "DEL"}


def share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def effect_report(hits: DataFrame, lists: DataFrame, effects: list[str]) -> DataFrame:
    """(class, gene_list, effect, gene_calls, effect_calls, log_odds) of each sample, of T, of N, and of all of them as TN.

    ``hits``: (sample, kind, effect, symbol), kind being T, N or B (background) or none of them; a symbol counts once a
    sample and effect. ``lists``: (gene_list, symbol); there are few lists. effect_calls are the genes hit, gene_calls
    those in the list; both are 0 where there are none. log_odds is ln of the share in the class over the share in the
    background, 0 where either is 0 or unknown. Samples without any hit do not appear.
    """
    hits = hits.select("sample", "kind", "effect", "symbol").distinct()
    names = lists.agg(F.array_sort(F.collect_set("gene_list")).alias("names"))
    grid = hits.select("sample", "kind").distinct().join(F.broadcast(names)).select("sample", "kind", F.explode("names").alias("gene_list"))
    grid = grid.withColumn("effect", F.explode(F.array(*map(F.lit, effects))))
    genes = hits.join(lists.distinct(), "symbol").groupBy("sample", "kind", "effect", "gene_list").agg(F.count("*").alias("n"))
    calls = hits.groupBy("sample", "kind", "effect").agg(F.count("*").alias("m"))
    genes, calls = (x.withColumnsRenamed({"kind": "other", "sample": "of", "effect": "by"}) for x in (genes, calls))
    here = [F.col("sample") == F.col("of"), F.col("effect") == F.col("by"), F.col("kind").eqNullSafe(F.col("other"))]
    full = grid.join(calls, here, "left").drop("of", "by", "other")
    full = full.join(genes.withColumnRenamed("gene_list", "list"), [*here, F.col("gene_list") == F.col("list")], "left").fillna(0, ["n", "m"])
    back = full.filter(F.col("kind") == BACKGROUND).groupBy("gene_list", "effect").agg(F.sum("n").alias("back_n"), F.sum("m").alias("back_m"))
    own = full.filter(~F.col("kind").eqNullSafe(F.lit(BACKGROUND)))
    groups = F.array_compact(F.array("sample", F.when(F.col("kind").isin(CLASSES), F.col("kind")), F.lit(BOTH)))
    sums = own.withColumn("class", F.explode(groups)).groupBy("class", "gene_list", "effect").agg(F.sum("n").alias("gene_calls"), F.sum("m").alias("effect_calls"))
    ratio = F.try_divide(share("gene_calls", "effect_calls"), share("back_n", "back_m"))
    odds = F.when(ratio > 0, F.ln(ratio)).otherwise(0.0)
    return sums.join(back, ["gene_list", "effect"], "left").select("class", "gene_list", "effect", "gene_calls", "effect_calls", odds.alias("log_odds"))


def calls_beside_expression(hits: DataFrame, background: DataFrame, lists: DataFrame, expressed: DataFrame) -> DataFrame:
    """(gene_list, symbol, sv, rna): genes of ``hits`` (effect, symbol) not so hit in ``background`` that are in ``expressed`` (symbol, rna).

    A gain is a DUP and a loss a DEL, each beside a rise (+) and a fall (-) of expression; other effects are left out.
    """
    sv = F.element_at(F.create_map(*(F.lit(x) for kv in EVENTS.items() for x in kv)), F.col("effect"))
    new = hits.filter(F.col("effect").isin(list(EVENTS))).select("effect", "symbol").distinct().join(background, ["effect", "symbol"], "left_anti")
    return new.join(lists, "symbol").join(expressed, "symbol").select("gene_list", "symbol", sv.alias("sv"), "rna").distinct()


def write_report(report: DataFrame, path: str) -> None:
    """A folder of tab-separated files, each with the names of the columns on top."""
    report.write.option("sep", "\t").option("header", True).csv(path)


def on_one_axis(regions: DataFrame, offsets: DataFrame, contig: str) -> DataFrame:
    """Regions (contig, s, e) moved by the offset of their contig; those of a contig without one are dropped."""
    return regions.join(offsets.select(contig, "start"), contig).withColumn("s", F.col("s") + F.col("start")).withColumn("e", F.col("e") + F.col("start")).drop("start")
