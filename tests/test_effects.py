from genoloom.operators import effects as E


def test_report_of_samples_classes_and_zeros(spark):
    hits = spark.createDataFrame([("a", "T", "gain", 1), ("a", "T", "gain", 1), ("a", "T", "gain", 2), ("b", None, "gain", 1), ("x", "B", "gain", 1), ("x", "B", "gain", 3)], "sample string, kind string, effect string, symbol long")
    lists = spark.createDataFrame([("p", 1), ("p", 1), ("q", 9)], "gene_list string, symbol long")
    got = {(r["class"], r["gene_list"], r["effect"]): (r["gene_calls"], r["effect_calls"], round(r["log_odds"], 6)) for r in E.effect_report(hits, lists, ["gain", "loss"]).collect()}
    assert set(got) == {(c, g, e) for c in ("a", "b", "T", "TN") for g in "pq" for e in ("gain", "loss")}
    assert got["a", "p", "gain"] == got["T", "p", "gain"] == (1, 2, 0.0)
    assert got["b", "p", "gain"] == (1, 1, 0.693147) and got["TN", "p", "gain"] == (2, 3, 0.287682)
    assert got["a", "q", "gain"] == (0, 2, 0.0) and got["a", "p", "loss"] == (0, 0, 0.0)
    assert E.effect_report(hits.limit(0), lists, ["gain"]).count() == 0


def test_branches_and_report_files(spark, tmp_path):
    hits = spark.createDataFrame([("gain", 1), ("loss", 1), ("gain", 2), ("other", 3)], "effect string, symbol long")
    lists = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "gene_list string, symbol long")
    rna = spark.createDataFrame([(1, "+"), (1, "-"), (2, "+"), (3, "+")], "symbol long, rna string")
    got = E.calls_beside_expression(hits, hits.filter("symbol = 2"), lists, rna)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("p", 1, "DEL", "+"), ("p", 1, "DEL", "-"), ("p", 1, "DUP", "+"), ("p", 1, "DUP", "-")]
    E.write_report(got, str(tmp_path / "report"))
    back = spark.read.option("sep", "\t").option("header", True).schema(got.schema).csv(str(tmp_path / "report"))
    assert sorted(map(tuple, back.collect())) == rows
