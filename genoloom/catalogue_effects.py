"""Queries of the reports on genes hit by calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoloom.catalogue import query
from genoloom.operators import effects as E
from genoloom.plans import views as V

#: SQL: genes hit by five samples, one of them background, and four gene lists.
HITS = f"""c AS (SELECT DISTINCT 'S' || (k % 5) AS sample, CASE WHEN k % 5 = 0 THEN 'B' WHEN k % 5 < 3 THEN 'T' ELSE 'N' END AS kind,
CASE side WHEN 'F' THEN 'gain' WHEN 'O' THEN 'loss' ELSE 'other' END AS effect, id % 5003 AS symbol FROM ({V.CALLS})),
l AS (SELECT DISTINCT 'l' || (symbol % 4) AS gene_list, symbol FROM c WHERE symbol % 7 < 5)"""


def hits(spark, sf_dir):
    k = F.col("k") % 5
    kind = F.when(k == 0, "B").when(k < 3, "T").otherwise("N")
    effect = F.when(F.col("side") == "F", "gain").when(F.col("side") == "O", "loss").otherwise("other")
    return V.calls(spark, sf_dir).select(F.concat(F.lit("S"), k.cast("string")).alias("sample"), kind.alias("kind"), effect.alias("effect"), (F.col("id") % 5003).alias("symbol"))


def lists(found):
    return found.filter("symbol % 7 < 5").select(F.concat(F.lit("l"), (F.col("symbol") % 4).cast("string")).alias("gene_list"), "symbol").distinct()


@query(f"""WITH {HITS}, n AS (SELECT sample, kind, effect, gene_list, (SELECT count(*) FROM c WHERE c.sample = s.sample AND c.effect = e.effect) AS m,
(SELECT count(*) FROM c JOIN l USING (symbol) WHERE c.sample = s.sample AND c.effect = e.effect AND l.gene_list = g.gene_list) AS n
FROM (SELECT DISTINCT sample, kind FROM c) s, (VALUES ('gain'), ('loss'), ('other')) e(effect), (SELECT DISTINCT gene_list FROM l) g),
u AS (SELECT sample AS class, * EXCLUDE (sample) FROM n WHERE kind <> 'B' UNION ALL SELECT kind, * EXCLUDE (sample) FROM n WHERE kind <> 'B' UNION ALL SELECT 'TN', * EXCLUDE (sample) FROM n WHERE kind <> 'B'),
a AS (SELECT class, gene_list, effect, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m FROM u GROUP BY ALL), b AS (SELECT gene_list, effect, sum(n) AS bn, sum(m) AS bm FROM n WHERE kind = 'B' GROUP BY ALL)
SELECT class, gene_list, effect, n AS gene_calls, m AS effect_calls, CASE WHEN n > 0 AND bn > 0 THEN round(ln((n / m) / (bn / bm)), 9) ELSE 0 END AS log_odds FROM a LEFT JOIN b USING (gene_list, effect)""")
def gene_effect_report(spark, sf_dir):
    found = hits(spark, sf_dir)
    return E.effect_report(found, lists(found), ["gain", "loss", "other"]).withColumn("log_odds", F.round("log_odds", 9))


@query(f"""WITH {HITS}, x AS (SELECT DISTINCT p_partkey AS symbol, CASE WHEN p_size > 25 THEN '+' ELSE '-' END AS rna FROM part),
d AS (SELECT effect, symbol FROM c WHERE sample = 'S1' EXCEPT SELECT effect, symbol FROM c WHERE kind = 'B')
SELECT gene_list, symbol, CASE effect WHEN 'gain' THEN 'DUP' ELSE 'DEL' END AS sv, rna FROM d JOIN l USING (symbol) JOIN x USING (symbol) WHERE effect <> 'other'""")
def expression_branches(spark, sf_dir):
    found = hits(spark, sf_dir)
    rna = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") > 25, "+").otherwise("-").alias("rna"))
    return E.calls_beside_expression(found.filter("sample = 'S1'"), found.filter("kind = 'B'"), lists(found), rna)


@query(f"WITH c AS ({V.CALLS}) SELECT k, s + k * 1000000 AS s, e + k * 1000000 AS e FROM c WHERE k < 20")
def offset_regions(spark, sf_dir):
    c = V.calls(spark, sf_dir).select("k", "s", "e")
    offsets = c.filter("k < 20").select("k", (F.col("k") * 1_000_000).alias("start")).distinct()
    return E.on_one_axis(c, offsets, "k")
