"""Weights of segments, classes over genes, rates by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators import intervals as I
from genoloom.sources.files import kept


def weighted_segments(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Disjoint segments with what lies over each: total, product, density (sum of weight * length / segment length) and n.

    All four are running sums of what begins and ends at the boundaries: the product by logarithms, as decimals so that
    what ends takes away just what began, with counts of zeros and of negative weights. Sums of weights that are no
    multiples of a power of two carry the rounding of a running sum. A null weight adds nothing and multiplies by 1.
    """
    w = F.col(weight).cast("double")
    logs = F.when(w != 0, F.ln(F.abs(w))).otherwise(0.0).cast("decimal(28,18)")
    marks = {"zeros": w == 0, "negatives": w < 0}
    counts = {k: F.coalesce(x.cast("long"), F.lit(0)) for k, x in marks.items()}
    deltas = I.boundaries(df, *keys, n=F.lit(1).cast("long"), total=F.coalesce(w, F.lit(0.0)), area=F.coalesce(w * (F.col("e") - F.col("s") + 1), F.lit(0.0)), logs=F.coalesce(logs, F.lit(0)), **counts)
    swept = I.swept(deltas, keys, ["n", "total", "area", "logs", *counts]).filter("n > 0")
    product = F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp(F.col("logs").cast("double")) * (1 - 2 * (F.col("negatives") % 2)))
    return swept.select(*keys, "s", "e", "total", product.alias("product"), (F.col("area") / (F.col("e") - F.col("s") + 1)).alias("density"), "n")


def scaled(segments: DataFrame, method: str, low: float, high: float) -> DataFrame:
    """``weight`` of each segment between ``low`` and about ``high`` by the method add, len, log, mult or add-mult.

    The least value is that over all segments, the largest is 0 at least. add-mult is the product of both scales. Where
    log has no value (a least total of 0 or less, or one as large as the largest), the weight is ``low``.
    """
    if method == "add-mult":
        both = scaled(scaled(segments, "add", low, high).withColumnRenamed("weight", "added"), "mult", low, high)
        return both.withColumn("weight", F.col("added") * F.col("weight")).drop("added")
    u = F.col({"add": "total", "len": "density", "log": "total", "mult": "product"}[method])
    bounds = segments.agg(F.min(u).alias("least"), F.greatest(F.max(u), F.lit(0.0)).alias("most"))
    a, b = F.col("least"), F.col("most")
    if method == "log":
        scale = F.try_divide(F.log10(1 + F.try_divide(u, a)), F.log10(1 + b - a))
        weight = (high - low) * F.when(a > 0, F.coalesce(scale, F.lit(0.0))).otherwise(0.0) + low
    elif method == "mult":
        weight = (high - low) / F.when(b == a, 1.0).otherwise(b - a) * (u - a) + low
    else:
        weight = (high - low) / (b - a + 1) * (u - a) + low
    return segments.join(F.broadcast(bounds)).withColumn("weight", weight).drop("least", "most")


def distribution(df: DataFrame, limits: DataFrame, keys: list[str], weight: str, background: float, method: str = "mult", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Sampling weights over whole keys: intervals put in order, a background over ``limits`` (keys, s, e), swept and scaled."""
    clean = df.select(*keys, F.least("s", "e").alias("s"), F.greatest("s", "e").alias("e"), weight)
    return scaled(weighted_segments(clean.union(limits.select(*keys, "s", "e", F.lit(background))), keys, weight), method, low, high)


def unweighted(segments: DataFrame, keys: list[str], cutoff: float = 0.0) -> DataFrame:
    """Regions of weight ``cutoff`` or less, merged."""
    return I.merge(segments.filter(F.col("weight") <= cutoff), keys)


def majority(df: DataFrame, keys: list[str], kind: str, id: str, low: int, high: int) -> DataFrame:
    """Of each segment the number of different ids over it, kept within [low, high], and the class with most (ties: the last name).

    Classes are swept beside the boundaries of all intervals, by running sums of their different ids. Ids whose intervals
    in a class are all equal, as most are, come of one aggregation; only those of others are merged first.
    """
    keyed = F.lit(True)
    for c in [*keys, "s", "e", kind, id]:
        keyed = keyed & F.col(c).isNotNull()
    keyed = F.coalesce(keyed & (F.col("s") <= F.col("e")), F.lit(False))
    known, group = df.filter(keyed).select(*keys, "s", "e", kind, id), [*keys, kind, id]
    each = kept(known.groupBy(*group).agg(F.min("s").alias("s"), F.max("s").alias("last"), F.min("e").alias("first"), F.max("e").alias("e")), "ids")
    same = (F.col("s") == F.col("last")) & (F.col("first") == F.col("e"))
    # boundaries of no class only cut: those inside the merged ones, and of rows without an id, a class or an extent
    none = F.lit(None).cast(df.schema[kind].dataType).alias(kind)
    deltas = I.of_kinds(each.filter(same), keys, kind).union(I.of_kinds(df.filter(~keyed).select(*keys, "s", "e", none), keys, kind))
    if each.filter(~same).limit(1).count():
        several = known.join(each.filter(~same).select(*group), group, "left_semi")
        deltas = deltas.union(I.of_kinds(I.merge(several, group), keys, kind)).union(I.of_kinds(several.select(*keys, "s", "e", none), keys, kind))
    found = I.lying_over(deltas, keys, kind, weight=F.sum("n"), most=F.max(F.struct("n", F.col(kind).alias("kind"))))
    return found.filter(F.col("weight").between(low, high)).select(*keys, "s", "e", "weight", F.col("most.kind").alias("major"))


def enrichment(events: DataFrame, genes: DataFrame, keys: list[str], kind: str, symbol: str) -> DataFrame:
    """Per key and event class: different genes hit, genes of the key, events. Genes meet the merged regions of a class, not each event."""
    regions = I.merge(events, [*keys, kind])
    hits = I.overlaps(regions, genes.select(*keys, "s", "e", symbol), keys).groupBy(*(F.col(f"a_{c}").alias(c) for c in [*keys, kind])).agg(F.countDistinct(f"b_{symbol}").alias("hit"))
    out = events.groupBy(*keys, kind).agg(F.count("*").alias("events")).join(hits, [*keys, kind], "left")
    return out.join(genes.groupBy(*keys).agg(F.countDistinct(symbol).alias("genes")), keys, "left").select(*keys, kind, F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("genes", F.lit(0)).alias("genes"), "events")


def effects(events: DataFrame, genes: DataFrame, keys: list[str], kind: str, symbol: str, ranks: dict[str, int]) -> DataFrame:
    """(symbol, effect) of genes that events touch; where several classes lie over one segment, the lowest rank counts there."""
    parts = I.segments(events, keys, kind).withColumn("effect", F.array_min(F.transform("ids", lambda x: F.struct(F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ranks.items() for v in kv)), x), F.lit(99)).alias("rank"), x.alias("kind"))))["kind"])
    hits = I.overlaps(I.merge(parts, [*keys, "effect"]), genes.select(*keys, "s", "e", symbol), keys)
    return hits.select(F.col(f"b_{symbol}").alias(symbol), F.col("a_effect").alias("effect")).distinct()


def rate_bins(events: DataFrame, rates: DataFrame, kind: str, size: Column, length: float) -> DataFrame:
    """Observed events against ``rate * length`` by class and size. A bin holds sizes in [0.5001 s, 1.5 s]; the least fitting one counts."""
    sized = events.select(kind, size.alias("size"))
    bins = rates.groupBy(kind).agg(F.array_sort(F.collect_set("size")).alias("bins"))
    placed = sized.join(bins, kind).withColumn("bin", F.get(F.filter("bins", lambda b: (F.col("size") >= 0.5001 * b) & (F.col("size") <= 1.5 * b)), F.lit(0)))
    counts = placed.filter("bin is not null").groupBy(kind, F.col("bin").alias("size")).agg(F.count("*").alias("observed"))
    out = rates.select(kind, "size", "rate").join(counts, [kind, "size"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return out.withColumn("ratio", F.try_divide("observed", F.col("rate") * length))


def log_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """log1p(a / b) / log1p(c / d); null where a denominator is not positive or the lower logarithm is 0."""
    return F.when((b > 0) & (d > 0), F.try_divide(F.log1p(a / b), F.log1p(c / d)))
