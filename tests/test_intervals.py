import pytest
from pyspark.sql import functions as F

from genoloom.operators import calls as C
from genoloom.operators import intervals as I
from genoloom.operators import tree as T


def table(spark, spans):
    return spark.createDataFrame([("c", s, e) for s, e in spans], "k string, s long, e long")


def spans(df):
    return sorted((r.s, r.e) for r in df.collect())


@pytest.mark.parametrize("given, want", [([(1, 3), (4, 6), (8, 9)], [(1, 6), (8, 9)]), ([(1, 3), (5, 6)], [(1, 3), (5, 6)]), ([(1, 10), (2, 3)], [(1, 10)]), ([(7, 9), (7, 9)], [(7, 9)]), ([], [])])
def test_merge(spark, given, want):
    assert spans(I.merge(table(spark, given), ["k"])) == want


@pytest.mark.parametrize("a, b, both, either, left, right", [
    ([(1, 5)], [(3, 9)], [(3, 5)], [(1, 9)], [(1, 2)], [(6, 9)]),
    ([(1, 10)], [(4, 6)], [(4, 6)], [(1, 10)], [(1, 3), (7, 10)], []),
    ([(2, 4)], [(2, 4)], [(2, 4)], [(2, 4)], [], []),
    ([], [(1, 2)], [], [(1, 2)], [], [(1, 2)]),
])
def test_set_operations(spark, a, b, both, either, left, right):
    a, b = table(spark, a), table(spark, b)
    assert spans(I.intersect(a, b, ["k"])) == both
    assert spans(I.union(a, b, ["k"])) == either
    assert spans(I.difference(a, b, ["k"])) == left
    assert spans(I.difference(b, a, ["k"])) == right


def test_segments(spark):
    df = table(spark, [(1, 5)]).withColumn("id", F.lit("A")).union(table(spark, [(3, 9)]).withColumn("id", F.lit("B")))
    assert sorted((r.s, r.e, r.ids) for r in I.segments(df, ["k"], "id").collect()) == [(1, 2, ["A"]), (3, 5, ["A", "B"]), (6, 9, ["B"])]


def test_jaccard_and_reflection(spark):
    df = spark.createDataFrame([(1, 10, 6, 15), (1, 2, 8, 9), (3, 7, 3, 7)], "a long, b long, c long, d long")
    assert [r[0] for r in df.select(I.jaccard(*map(F.col, "abcd"))).collect()] == [5 / 15, 0, 1]
    assert spans(I.reflect(table(spark, [(100, 200)]), table(spark, [(110, 120)]), ["k"])) == [(180, 190)]


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTN", "X=1;CIEND=2;END=7;END=9;F")], "seq string, info string")
    assert df.select(C.reverse_complement(F.col("seq")), C.info_value(F.col("info"), "END"), C.info_replace(F.col("info"), "X", F.lit(5))).first()[:] == ("NACGT", "9", "X=5;CIEND=2;END=7;END=9;F")
    names = spark.createDataFrame([(x,) for x in ("X", "10", "2", "9", "MT")], "c string")
    assert [r.c for r in names.orderBy(C.contig_order(F.col("c"))).collect()] == ["2", "9", "X", "10", "MT"]


def test_clone_frequency(spark):
    edges = spark.createDataFrame([("root", "a"), ("root", "b"), ("a", "c")], "parent string, child string")
    assert {r.node: r.freq for r in T.frequency(edges).collect()} == {"root": 4, "a": 2, "b": 1, "c": 1}
