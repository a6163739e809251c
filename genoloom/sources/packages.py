"""Nested JSON maps: packages of many documents, gene maps, weighted units by contig, offsets, clone trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.sources.files import numbered, running_total

#: The four effects and the name of an effect's file.
EFFECTS = ["germline_gain", "germline_loss", "somatic_gain", "somatic_loss"]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file as one text. A JSON document is one row, as it has no other bounds."""
    return spark.read.option("wholetext", True).text(path)


def entries(text: Column) -> Column:
    """The entries of a JSON object, their values as JSON text; null if it is none."""
    return F.from_json(text, "map<string,string>")


def json_text(value: Column) -> Column:
    return F.to_json(F.struct(value.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("x")))) - 6)


def json_object(pairs: Column) -> Column:
    """The JSON object of an array of (key, JSON text), by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(json_text(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the documents of packages, a row each, values as JSON text. Files that hold no JSON object give none."""
    return documents(spark, path).select(F.explode(entries(F.col("value"))).alias("key", "value"))


def write_by_key(rows: DataFrame, folder: str) -> None:
    """``rows`` (key, value) as a folder ``key=...`` each, with one file; other keys that are there stay as they are."""
    by_key = rows.select("key", "value").repartition("key")
    by_key.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").text(folder)


def read_by_key(spark: SparkSession, folder: str, patterns: list[str] = ("*",)) -> DataFrame:
    """(key, value) of the keys that match any of the patterns, in which ``*`` stands for any letters."""
    rows = spark.read.option("wholetext", True).option("basePath", folder).schema("value string, key string").text([f"{folder}/key={p}" for p in patterns])
    return rows.select("key", F.rtrim("value", F.lit("\n")).alias("value")).dropDuplicates(["key"])


def pack(rows: DataFrame) -> DataFrame:
    """(value): one package of all ``rows`` (key, value as JSON text)."""
    return rows.agg(json_object(F.collect_list(F.struct("key", "value"))).alias("value"))


def read_units(spark: SparkSession, path: str, weights: DataFrame | None = None) -> DataFrame:
    """(chrom, place, s, e, weight, class, ids) of JSON ``{chrom: [[s, e, weight, {class: [ids]}]]}``; ids are sorted and different."""
    return units(documents(spark, path).select("value"), weights).drop("key")


def units(texts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Units of ``texts`` (value, and key if there is one). ``place`` is the unit's place in its contig's list.

    ``weights`` (chrom, place, weight) take the place of those of the file if they have just its contigs with as many
    places each, and are left aside otherwise. Units without whole bounds are dropped; one without a class has none.
    """
    key = F.col("key") if "key" in texts.columns else F.lit(None).cast("string")
    contigs = texts.select(key.alias("key"), F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("chrom", "list"))
    rows = contigs.select("key", "chrom", F.posexplode("list").alias("place", "u"))
    rows = rows.select("key", "chrom", F.col("place").cast("long").alias("place"), F.get("u", F.lit(0)).try_cast("long").alias("s"), F.get("u", F.lit(1)).try_cast("long").alias("e"), F.get("u", F.lit(2)).try_cast("double").alias("weight"), F.from_json(F.get("u", F.lit(3)), "map<string,array<string>>").alias("classes"))
    rows = rows.filter("s IS NOT NULL AND e IS NOT NULL")
    if weights is not None:
        sizes = [x.groupBy("chrom").agg(F.count("*").alias("n")) for x in (rows, weights)]
        differ = sizes[0].exceptAll(sizes[1]).union(sizes[1].exceptAll(sizes[0])).agg((F.count("*") == 0).alias("equal"))
        other = weights.select("chrom", F.col("place").cast("long").alias("place"), F.col("weight").alias("other"))
        rows = rows.join(other, ["chrom", "place"], "left").join(F.broadcast(differ)).withColumn("weight", F.when(F.col("equal") & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("weight"))).drop("other", "equal")
    return rows.select("key", "chrom", "place", "s", "e", "weight", F.explode_outer("classes").alias("class", "ids")).withColumn("ids", F.array_sort(F.array_distinct("ids")))


def units_json(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, value): the JSON of units (by, chrom, s, e, weight, class, ids), those of equal bounds and weight as one, by s and e."""
    one = rows.groupBy(*by, "chrom", "s", "e", "weight").agg(F.collect_list(F.struct(F.col("class").alias("key"), F.to_json(F.array_sort(F.array_distinct("ids"))).alias("value"))).alias("classes"))
    unit = F.concat(F.lit("["), F.col("s").cast("string"), F.lit(","), F.col("e").cast("string"), F.lit(","), F.coalesce(F.col("weight").cast("string"), F.lit("null")), F.lit(","), json_object(F.filter("classes", lambda c: c["key"].isNotNull())), F.lit("]"))
    lists = one.groupBy(*by, "chrom").agg(F.array_sort(F.collect_list(F.struct("s", "e", unit.alias("unit")))).alias("units"))
    texts = lists.select(*by, F.struct(F.col("chrom").alias("key"), F.concat(F.lit("["), F.array_join(F.transform("units", lambda u: u["unit"]), ","), F.lit("]")).alias("value")).alias("pair"))
    return texts.groupBy(*by).agg(json_object(F.collect_list("pair")).alias("value"))


def write_gene_map(genes: DataFrame, own_units: DataFrame, path: str) -> None:
    """Gene map JSON: ``seq`` (contig to genes), ``gene`` (symbol to places) and ``wcu`` (label to units).

    ``genes`` (symbol, chrom, s, e); ``own_units`` (label, chrom, s, e, weight, class, ids).
    """
    def of(key: str, first: str) -> DataFrame:
        lists = genes.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(first, "s", "e"))).alias("rows"))
        each = F.transform("rows", lambda r: F.concat(F.lit("["), json_text(r[first]), F.lit(","), r["s"].cast("string"), F.lit(","), r["e"].cast("string"), F.lit("]")))
        return lists.select("key", F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")).alias("value"))

    labels = units_json(own_units, ["label"]).select(F.col("label").alias("key"), "value")
    parts = [pack(x).select(F.lit(name).alias("key"), "value") for name, x in (("seq", of("chrom", "symbol")), ("gene", of("symbol", "chrom")), ("wcu", labels))]
    pack(parts[0].union(parts[1]).union(parts[2])).write.text(path)


def read_gene_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genes (symbol, chrom, s, e), from the map by contig, and units (label, chrom, place, s, e, weight, class, ids)."""
    parts = unpack(spark, path)
    rows = parts.filter("key = 'seq'").select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("chrom", "rows")).select("chrom", F.explode("rows").alias("r"))
    genes = rows.select(F.get("r", F.lit(0)).alias("symbol"), "chrom", F.get("r", F.lit(1)).try_cast("long").alias("s"), F.get("r", F.lit(2)).try_cast("long").alias("e")).filter("s IS NOT NULL AND e IS NOT NULL")
    labels = parts.filter("key = 'wcu'").select(F.explode(entries(F.col("value"))).alias("key", "value"))
    return genes, units(labels).withColumnRenamed("key", "label")


def effect_files(symbols: DataFrame, genes: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """(key, value): the units of a gene list for each effect that has a weight, a file each, named by effect and label.

    ``symbols`` (symbol), ``genes`` (symbol, chrom, s, e), ``weights`` (effect, weight) with effects of EFFECTS. A symbol's
    places all count, unknown symbols have none; the unit's class is the label and its id the symbol.
    """
    found = genes.join(symbols.select("symbol").distinct(), "symbol")
    rows = found.join(weights.filter(F.col("effect").isin(EFFECTS))).select("effect", "chrom", "s", "e", "weight", F.lit(label).alias("class"), F.array("symbol").alias("ids"))
    merged = rows.groupBy("effect", "chrom", "s", "e", "weight", "class").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    texts = units_json(merged, ["effect"])
    effect = F.split("effect", "_")
    return texts.select(F.concat_ws("_", F.get(effect, F.lit(0)), F.lit(label), F.get(effect, F.lit(1)), F.lit("wcu")).alias("key"), "value")


def mask_units(mask: DataFrame, label: str, weight: float) -> DataFrame:
    """Regions (chrom, s, e) as units of class ``label``, with ids ``label_1``, ... running over all contigs by (chrom, s, e)."""
    rows = numbered(mask.select("chrom", "s", "e"), ["chrom", "s", "e"])
    return rows.select("chrom", "s", "e", F.lit(weight).alias("weight"), F.lit(label).alias("class"), F.array(F.concat(F.lit(f"{label}_"), F.col("number").cast("string"))).alias("ids"))


def weights_by_id(rows: DataFrame) -> DataFrame:
    """(class, id, weight, length): what each id weighs and how long it is; of several units of an id the last by (chrom, s, e) counts."""
    each = rows.select("class", F.explode("ids").alias("id"), F.struct("chrom", "s", "e", "weight").alias("u"))
    last = each.groupBy("class", "id").agg(F.max("u").alias("u"))
    return last.select("class", "id", "u.weight", (F.col("u.e") - F.col("u.s") + 1).alias("length"))


def write_offsets(lengths: DataFrame, path: str) -> None:
    """JSON of each contig's offset on one axis: longest first, equal ones by name."""
    rows = running_total(lengths.select("name", "length"), [F.desc("length"), F.asc("name")], "length", "before")
    pack(rows.select(F.col("name").alias("key"), F.col("before").cast("string").alias("value"))).write.text(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(name, start)."""
    return documents(spark, path).select(F.explode(F.from_json("value", "map<string,long>")).alias("name", "start"))


def write_clone_tree(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A tree's JSON from edges (parent, child) and nodes (clone, alive, depth, freq); children are in order."""
    children = edges.groupBy(F.col("parent").alias("key")).agg(F.to_json(F.array_sort(F.collect_list("child"))).alias("value"))
    maps = [pack(nodes.select(F.col("clone").alias("key"), F.col(x).cast("string").alias("value")).filter("value IS NOT NULL")).select(F.lit(x).alias("key"), "value") for x in ("alive", "depth", "freq")]
    rows = pack(children).select(F.lit("tree").alias("key"), "value")
    for m in maps:
        rows = rows.union(m)
    pack(rows).write.text(path)


def mask_to_bed(mask: DataFrame, path: str) -> None:
    """Regions (chrom, s, e) as tab-separated lines, ranges of (chrom, s, e) in files that follow one another by name."""
    parts = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mask.repartitionByRange(parts, "chrom", "s", "e").sortWithinPartitions("chrom", "s", "e").select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"))).write.text(path)


def write_call_json(calls: DataFrame, path: str) -> None:
    """A JSON line a call."""
    calls.write.json(path)


def read_call_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Calls of JSON lines by ``schema``; lines that are no JSON object, or of other types, are dropped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL").drop("_bad")
