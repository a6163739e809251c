"""Algebra of closed integer intervals. A table has key columns and ``s``, ``e`` with 0 <= s <= e."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from genoloom.sources.files import by_range, dealt, ranges

#: Width of the finest bins, how much wider each next level is, and levels: the coarsest bins hold whole contigs.
BIN, LEVEL, LEVELS = 32, 8, 9


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Joins overlapping and adjacent intervals of a key.

    Rows are put into ranges of (keys, s), and a range's rows are joined into islands by themselves; an island that
    reaches into later ranges meets theirs in a second pass over islands, in which only the furthest reach of the ranges
    before comes from outside. So a hot key goes through as many tasks as it has ranges, however its intervals lie.
    """
    rows = by_range(df.select(*keys, "s", "e"), [*keys, "s"])
    local = islands(dealt(rows, rows), [*keys, "part"])
    reach = F.max("e").over(order_of([*keys, "part"], "s").rowsBetween(Window.unboundedPreceding, -1))
    own = carried(local, keys, {"before": F.max("e")}, F.max)
    reach = F.greatest("before", reach)
    begins = own.withColumn("begins", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    number = F.sum("begins").over(order_of([*keys, "part"], "s"))
    # an island is known by its place among those that begin in its part, and goes by the last part that has a beginning
    named = begins.withColumn("nth", number)
    starts = carried(named.drop("before"), keys, {"earlier": F.sum("begins")}, F.sum)
    return starts.withColumn("island", F.col("nth") + F.coalesce("earlier", F.lit(0))).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def order_of(keys: list[str], at: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(at)


def islands(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0)).over(order)
    return df.withColumn("reach", reach).withColumn("island", island).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def carried(df: DataFrame, keys: list[str], values: dict[str, Column], put_together: Callable[[Column], Column], after: dict[str, Column] | None = None) -> DataFrame:
    """``df`` (with ``part``, its range) and what the ranges before come to for its key: null where there are none.

    ``values`` are aggregates of a range, put together over the ranges before by ``put_together``; of those of ``after``
    the least over the ranges behind is taken. Only keys that reach over a border are sent along, so there are no more rows of that than
    ranges, and it is broadcast.
    """
    after = after or {}
    each = df.groupBy(*keys, "part").agg(*(v.alias(k) for k, v in {**values, **after}.items()))
    order = order_of(keys, "part")
    before = [put_together(F.col(k)).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias(k) for k in values]
    later = [F.min(k).over(order.rowsBetween(1, Window.unboundedFollowing)).alias(k) for k in after]
    border = each.select(*(F.col(k).alias(f"carry_{k}") for k in [*keys, "part"]), *before, *later, F.count("*").over(Window.partitionBy(*keys)).alias("parts")).filter("parts > 1").drop("parts")
    same = F.lit(True)
    for k in [*keys, "part"]:
        same = same & F.col(k).eqNullSafe(F.col(f"carry_{k}"))
    return df.join(F.broadcast(border), same, "left").drop(*(f"carry_{k}" for k in [*keys, "part"]))


def swept(deltas: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, s, e, sums): segments between boundaries ``s`` with the running sums of the columns ``sums`` of ``deltas``.

    Deltas of a boundary are summed first. Boundaries lie in ranges of (keys, s); sums run within each, and a row a range
    carries what the ranges before come to and where the next begins. A last segment without an end is left out.
    """
    totals = deltas.groupBy(*keys, "s").agg(*(F.sum(x).alias(x) for x in sums))
    rows = by_range(totals, [*keys, "s"])
    order = order_of([*keys, "part"], "s")
    own = dealt(carried(rows, keys, {f"before_{x}": F.sum(x) for x in sums}, F.sum, {"next": F.min("s")}), rows)
    ends = F.coalesce(F.lead("s").over(order), F.col("next")) - 1
    running = [(F.sum(x).over(order) + F.coalesce(f"before_{x}", F.lit(0))).alias(x) for x in sums]
    return own.select(*keys, "s", ends.alias("e"), *running).filter("e IS NOT NULL")


def boundaries(df: DataFrame, *columns: str, **values: Column) -> DataFrame:
    """(columns, s, values): each interval's values at its start, and their negatives behind its end."""
    sides = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("sign")))
    both = df.withColumns(values).select(*columns, *values, F.explode(sides).alias("x"))
    return both.select(*columns, F.col("x.at").alias("s"), *((F.col(v) * F.col("x.sign")).alias(v) for v in values))


def depth(df: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal disjoint segments between boundaries with the number of intervals over each (1 or more), by running sums."""
    return swept(boundaries(df, *keys, depth=F.lit(1).cast("long")), keys, ["depth"]).filter("depth > 0")


def combine(left: DataFrame, right: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Set algebra of two tables: ``keep`` decides on the boolean columns ``a`` and ``b`` of each segment."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    deltas = boundaries(left, *keys, in_a=one, in_b=none).unionByName(boundaries(right, *keys, in_a=none, in_b=one))
    flagged = swept(deltas, keys, ["in_a", "in_b"]).select(*keys, "s", "e", (F.col("in_a") > 0).alias("a"), (F.col("in_b") > 0).alias("b"))
    return merge(flagged.filter(keep), keys)


def intersect(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return combine(left, right, keys, F.col("a") & F.col("b"))


def union(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return merge(left.select(*keys, "s", "e").unionByName(right.select(*keys, "s", "e")), keys)


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return combine(left, right, keys, F.col("a") & ~F.col("b"))


def complement(df: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    return difference(limits, df, keys)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], bin_width: int = BIN) -> DataFrame:
    """Pairs of equal keys that overlap, columns of the left as ``a_*``, of the right as ``b_*``.

    An interval lies on the level whose bins, each LEVEL times as wide as those below, are at least as long as it is, so
    it touches two bins there at most, however long it is. A pair meets on the coarser of its two levels, in the bin of
    the larger start: left intervals on their own level meet right ones of that level or a finer one, and right
    intervals on theirs meet left ones of finer levels. So intervals meet in bins of about their own length, and what is
    compared stays in proportion to the pairs. Levels that the other side has no interval on are not dealt to: they come
    from an aggregation of at most LEVELS rows.
    """
    widths = [bin_width * LEVEL**i for i in range(LEVELS)]

    def levelled(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
        own = F.lit(LEVELS - 1)
        for i in range(LEVELS - 2, -1, -1):
            own = F.when(F.col(f"{p}_e") - F.col(f"{p}_s") + 1 <= widths[i], i).otherwise(own)
        return named.withColumn(f"{p}_level", own)

    def placed(df: DataFrame, p: str, levels: Column) -> DataFrame:
        at = df.withColumn(f"{p}_at", levels)
        width = F.element_at(F.array(*map(F.lit, widths)), F.col(f"{p}_at") + 1)
        return at.withColumn(f"{p}_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_s") / width), F.floor(F.col(f"{p}_e") / width))))

    def met(own: DataFrame, p: str, other: DataFrame, q: str, least: int) -> DataFrame:
        used = F.broadcast(own.agg(F.collect_set(f"{p}_level").alias("used")))
        levels = F.filter("used", lambda x: x >= F.col(f"{q}_level") + least)
        a, b = placed(own, p, F.col(f"{p}_level")), placed(other.join(used), q, F.explode(levels)).drop("used")
        on = (F.col(f"{p}_at") == F.col(f"{q}_at")) & (F.col(f"{p}_bin") == F.col(f"{q}_bin"))
        for k in keys:
            on = on & (F.col(f"{p}_{k}") == F.col(f"{q}_{k}"))
        width = F.element_at(F.array(*map(F.lit, widths)), F.col(f"{p}_at") + 1)
        once = F.floor(F.greatest(f"{p}_s", f"{q}_s") / width) == F.col(f"{p}_bin")
        return a.join(b, on & (F.col(f"{p}_s") <= F.col(f"{q}_e")) & (F.col(f"{p}_e") >= F.col(f"{q}_s")) & once).select(*names)

    a, b = levelled(left, "a"), levelled(right, "b")
    names = [c for c in [*a.columns, *b.columns] if c not in ("a_level", "b_level")]
    return met(a, "a", b, "b", 0).union(met(b, "b", a, "a", 1))


def level_of(s: Column, e: Column, width: int, step: int) -> Column:
    """The level of bins that is the first to have them as wide as the interval: bins of ``width``, ``step`` times as wide on each next one."""
    own = F.lit(40 // (step.bit_length() - 1))
    for i in reversed(range(40 // (step.bit_length() - 1))):
        own = F.when(e - s + 1 <= width * step**i, i).otherwise(own)
    return own


def width_of(level: Column, width: int, step: int) -> Column:
    return F.lit(width) * F.pow(F.lit(step), level).cast("long")


def apart(df: DataFrame, disjoint: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` that overlap none of the ``disjoint`` intervals (keys, s, e).

    Of disjoint intervals that begin at or before the end of a row the last one reaches furthest, so a running maximum
    over ranges of ends and beginnings decides, and no pairs are formed.
    """
    ends = df.select(*keys, F.col("e").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("reach"), F.struct(*df.columns).alias("row"))
    begins = disjoint.select(*keys, F.col("s").alias("at"), F.lit(0).alias("side"), F.col("e").cast("long").alias("reach"), F.lit(None).cast(ends.schema["row"].dataType).alias("row"))
    ranged = by_range(ends.union(begins), [*keys, "at"])
    rows = dealt(carried(ranged, keys, {"earlier": F.max("reach")}, F.max), ranged)
    reach = F.max("reach").over(Window.partitionBy(*keys, "part").orderBy("at", "side"))
    return rows.withColumn("reach", F.greatest(reach, "earlier")).filter("side = 1 AND (reach IS NULL OR reach < row.s)").select("row.*")


def touching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e) of ``df``, each once, that overlap any interval of ``other``: only the merged regions of that are met."""
    hits = overlaps(df.select(*keys, "s", "e").distinct(), merge(other, keys), keys)
    return hits.select(*(F.col(f"a_{c}").alias(c) for c in [*keys, "s", "e"])).distinct()


def jaccard(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    """Closed-interval Jaccard of two intervals, 0 if they are apart."""
    return F.greatest(F.lit(0), F.least(a_e, b_e) - F.greatest(a_s, b_s) + 1) / (F.greatest(a_e, b_e) - F.least(a_s, b_s) + 1)


def lying_over(deltas: DataFrame, keys: list[str], kind: str, **values: Column) -> DataFrame:
    """(keys, s, e, values): segments between boundaries ``s``, with aggregates of the kinds that lie over each (``kind``) and of their running sums (``n``).

    ``deltas`` (keys, s, kind, n) are what begins (n > 0) and ends; rows of no kind only cut. A kind lies over a segment if its
    running sum is above 0 there. Boundaries lie in ranges of (keys, s), which are swept by themselves: a kind that reaches
    over a border ends there and begins again, so rows are dealt once, no segment is joined with what made it, and what
    is grouped lies in its range already. Segments under no kind, and null keys and places, are left out.
    """
    keyed = F.lit(True)
    for c in [*keys, "s"]:
        keyed = keyed & F.col(c).isNotNull()
    rows = by_range(deltas.filter(keyed).groupBy(*keys, "s", kind).agg(F.sum("n").alias("n")), [*keys, "s"])
    parts = order_of([*keys, "part"], "s"), order_of([*keys, "part", kind], "s")
    own = rows.unionByName(cut_at_borders(rows, keys, kind)).repartition(ranges(rows), *keys, "part")
    placed = own.select("*", F.dense_rank().over(parts[0]).alias("place"), F.lead("s").over(parts[0]).alias("next"))
    placed = placed.select(*keys, "part", "place", "s", "next", kind, F.sum("n").over(parts[1]).alias("n"), F.lead("place").over(parts[1]).alias("until"))
    # 0: the segment itself, from the last row of its boundary; beyond it the places that the row's kind lies over
    own = F.when(F.col("next") > F.col("s"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    over = F.when(F.col(kind).isNotNull() & (F.col("n") > 0) & (F.col("until") > F.col("place")), F.sequence("place", F.col("until") - 1)).otherwise(F.array().cast("array<int>"))
    dealt_out = placed.withColumn("at", F.explode(F.concat(own, over)))
    itself, whole = F.col("at") == 0, Window.partitionBy(*keys, "part", "place")
    each = dealt_out.select(*keys, "part", F.when(itself, F.col("place")).otherwise(F.col("at")).alias("place"), "s", (F.col("next") - 1).alias("e"), itself.alias("itself"), F.when(~itself, F.col(kind)).alias(kind), F.when(~itself, F.col("n")).alias("n"))
    found = each.select(*keys, "s", "e", "itself", F.count(kind).over(whole).alias("kinds"), *(v.over(whole).alias(k) for k, v in values.items()))
    return found.filter("itself AND kinds > 0").select(*keys, "s", "e", *values)


def cut_at_borders(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """What ends kinds where a key's next range begins, and lets them begin again there: rows like ``rows`` (keys, s, kind, n, part).

    There are at most two rows for each border that a kind reaches over.
    """
    order, of_kind = order_of(keys, "part"), order_of([*keys, kind], "nth")
    first = rows.groupBy(*keys, "part").agg(F.min("s").alias("first"))
    border = first.select(*keys, "part", "first", F.lag("part").over(order).alias("earlier"), F.row_number().over(order).alias("nth"), F.count("*").over(Window.partitionBy(*keys)).alias("parts")).filter("parts > 1").drop("parts")
    sums = rows.filter(F.col(kind).isNotNull()).join(F.broadcast(border.select(*keys, "part", "nth")), [*keys, "part"]).groupBy(*keys, "nth", kind).agg(F.sum("n").alias("n")).filter("n <> 0")
    running = sums.select(*keys, kind, "nth", F.sum("n").over(of_kind).alias("n"), F.lead("nth").over(of_kind).alias("until")).filter("n <> 0")
    over = running.select(*keys, kind, "n", F.explode(F.sequence(F.col("nth") + 1, F.col("until"))).alias("nth")).join(F.broadcast(border), [*keys, "nth"])
    both = F.array(F.struct((-F.col("n")).alias("n"), F.col("earlier").alias("part")), F.struct("n", "part"))
    return over.select(*keys, F.col("first").alias("s"), kind, F.explode(both).alias("x")).select(*keys, "s", kind, "x.n", "x.part")


def of_kinds(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, s, kind, n): the boundaries of intervals; those of no kind, and those that hold nothing, only cut."""
    one = F.when(F.col(kind).isNotNull() & (F.col("s") <= F.col("e")), 1).otherwise(0).cast("long")
    return boundaries(df, *keys, kind, n=one)


def segments(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """The sweep with the set of ids over each segment."""
    return lying_over(of_kinds(df, keys, ids), keys, ids, ids=F.collect_set(ids)).withColumn("ids", F.array_sort("ids"))


def overlapping(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """Segments under two intervals or more, with their number and whether they are of more than one class."""
    classes = depth(merge(df.filter(F.col(ids).isNotNull()), [*keys, ids]), keys).withColumnRenamed("depth", "classes")
    hits = overlaps(depth(df, keys).filter("depth > 1"), classes, keys)
    return hits.select(*(F.col(f"a_{c}").alias(c) for c in [*keys, "s", "e", "depth"]), (F.col("b_classes") > 1).alias("mixed"))


def reflect(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Inner intervals inside an outer one, turned around in it."""
    hits = overlaps(outer, inner, keys).filter("a_s <= b_s and b_e <= a_e")
    return hits.select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_s").alias("outer_s"), F.col("a_e").alias("outer_e"), (F.col("a_e") - (F.col("b_e") - F.col("a_s"))).alias("s"), (F.col("a_e") - (F.col("b_s") - F.col("a_s"))).alias("e"))
