"""Comparison of call sets by interval similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators import intervals as I


def similar(a: DataFrame, b: DataFrame, keys: list[str], r: float) -> DataFrame:
    hits = I.overlaps(a, b, keys).withColumn("j", I.jaccard(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e")))
    return hits.filter(F.col("j") >= r)


def matched(a: DataFrame, b: DataFrame, keys: list[str], r: float | None, how: str) -> DataFrame:
    """Rows of ``a`` with (left_semi) or without (left_anti) a partner: similar by ``r``, or any overlap if null.

    Whether a row has a partner hangs on its keys and ends alone, so the hits are joined back by these: ids may repeat or
    be null. Rows with a null among keys or ends have no partner.
    """
    if r is None:
        hits = I.touching(a, b, keys)
    else:
        hits = similar(a.select(*keys, "s", "e").distinct(), b.select(*keys, "s", "e").distinct(), keys, r)
        hits = hits.select(*(F.col(f"a_{c}").alias(c) for c in [*keys, "s", "e"])).distinct()
    hits = hits.select(*(F.col(c).alias(f"hit_{c}") for c in [*keys, "s", "e"]))
    same = F.lit(True)
    for c in [*keys, "s", "e"]:
        same = same & (F.col(c) == F.col(f"hit_{c}"))
    return a.join(hits, same, how)


def score(a: DataFrame, b: DataFrame, type: str, keys: list[str], id: str, r: float) -> DataFrame:
    """Per type: rows, precision, recall, F1, and the covered share: intersection over union of lengths e - s."""
    n = [x.groupBy(type).agg(F.count("*").alias(f"{p}n")) for x, p in ((a, "a"), (b, "b"))]
    good = similar(a, b, keys, r)
    ok = good.groupBy(F.col(f"a_{type}").alias(type)).agg(F.countDistinct(f"a_{id}").alias("a_ok"), F.countDistinct(f"b_{id}").alias("b_ok"))
    spans = [op(a, b, keys).groupBy(type).agg(F.sum(F.col("e") - F.col("s")).alias(name)) for op, name in ((I.intersect, "common"), (I.union, "all"))]
    t = n[0].join(n[1], type, "full")
    for x in (ok, *spans):
        t = t.join(x, type, "left")
    t = t.fillna(0)
    p, q = F.coalesce(F.try_divide("a_ok", "an"), F.lit(0.0)), F.coalesce(F.try_divide("b_ok", "bn"), F.lit(0.0))
    t = t.withColumn("prec", p).withColumn("rec", q).withColumn("f1", F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))).withColumn("j", F.coalesce(F.try_divide("common", "all"), F.lit(0.0)))
    return t.select(type, F.col("an").alias("n_a"), F.col("bn").alias("n_b"), *(F.round(c, 9).alias(c) for c in ("prec", "rec", "f1", "j")))
