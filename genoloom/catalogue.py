"""Registered queries over the driver's tables, each with SQL of another structure where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.operators import calls as C
from genoloom.operators import compare as P
from genoloom.operators import intervals as I
from genoloom.operators import tree as T
from genoloom.plans import views as V
from genoloom.sources.files import numbered, running_total

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL that merges a table x(k, s, e).
MERGED = """
(SELECT k, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e, r) AS g
  FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END
  AS new FROM (SELECT k, s, e, row_number() OVER (ORDER BY s) AS r FROM {x})))
  GROUP BY k, g)
"""
#: SQL of set algebra by points: every coordinate that either side covers.
POINTS = """
WITH c AS ({calls}), a AS (SELECT DISTINCT k, unnest(range(s, e + 1)) AS p
  FROM c WHERE side = 'F'), b AS (SELECT DISTINCT k, unnest(range(s, e + 1)) AS p
  FROM c WHERE side = 'O'), x AS ({points}), g AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS island
  FROM x) SELECT k, min(p) AS s, max(p) AS e FROM g GROUP BY k, island
"""
SIMILAR = "greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1)::DOUBLE / (greatest(a.e, b.e) - least(a.s, b.s) + 1)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = V.calls(spark, sf_dir)
    return c.filter("side = 'F'"), c.filter("side = 'O'")


@query(f"WITH d AS ({V.DENSE}) SELECT * FROM {MERGED.format(x='d')}")
def interval_merge(spark, sf_dir):
    return I.merge(V.dense(spark, sf_dir), ["k"])


@query(f"""
WITH d AS ({V.DENSE}), p AS (SELECT k, s AS x FROM d UNION SELECT k, e + 1
  FROM d), w AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p) SELECT w.k, w.s, w.e, count(*) AS depth FROM w JOIN d ON d.k = w.k AND d.s <= w.e AND d.e >= w.s
  GROUP BY ALL
""")
def interval_depth(spark, sf_dir):
    return I.depth(V.dense(spark, sf_dir), ["k"])


@query(f"""
WITH d AS ({V.DENSE}), p AS (SELECT k, s AS x FROM d UNION SELECT k, e + 1
  FROM d), w AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p) SELECT w.k, w.s, w.e, list_sort(list(DISTINCT t)) AS ids FROM w JOIN d ON d.k = w.k AND d.s <= w.e AND d.e >= w.s
  GROUP BY ALL
""")
def interval_segments(spark, sf_dir):
    return I.segments(V.dense(spark, sf_dir), ["k"], "t")


@query(POINTS.format(calls=V.CALLS, points="SELECT k, p FROM a INTERSECT SELECT k, p FROM b"))
def interval_intersect(spark, sf_dir):
    return I.intersect(*sides(spark, sf_dir), ["k"])


@query(POINTS.format(calls=V.CALLS, points="SELECT k, p FROM a UNION SELECT k, p FROM b"))
def interval_union(spark, sf_dir):
    return I.union(*sides(spark, sf_dir), ["k"])


@query(POINTS.format(calls=V.CALLS, points="SELECT k, p FROM a EXCEPT SELECT k, p FROM b"))
def interval_difference_left(spark, sf_dir):
    return I.difference(*sides(spark, sf_dir), ["k"])


@query(POINTS.format(calls=V.CALLS, points="SELECT k, p FROM b EXCEPT SELECT k, p FROM a"))
def interval_difference_right(spark, sf_dir):
    f, o = sides(spark, sf_dir)
    return I.difference(o, f, ["k"])


@query(POINTS.format(calls=V.CALLS, points="SELECT k, unnest(range(0, m + 1)) AS p FROM (SELECT k, max(e) AS m FROM c GROUP BY k) EXCEPT SELECT k, unnest(range(s, e + 1)) FROM c"))
def interval_complement(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    return I.complement(c, c.groupBy("k").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e")), ["k"])


@query(f"""
WITH d AS ({V.CALLS}), p AS (SELECT k, s AS x FROM d UNION SELECT k, e + 1
  FROM d), w AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p) SELECT w.k, w.s, w.e, count(*) AS depth FROM w JOIN d ON d.k = w.k AND d.s <= w.e AND d.e >= w.s
  GROUP BY ALL HAVING count(*) > 1
""")
def interval_overlap_detect(spark, sf_dir):
    return I.depth(V.calls(spark, sf_dir), ["k"]).filter("depth > 1")


@query(f"""
WITH c AS ({V.CALLS}) SELECT a.k, a.s AS outer_s, a.e AS outer_e, a.s + a.e - b.e AS s, a.s + a.e - b.s AS e
  FROM c a JOIN c b ON a.k = b.k AND b.s >= a.s AND b.e <= a.e WHERE a.side = 'F' AND b.side = 'O'
""")
def interval_reflect(spark, sf_dir):
    return I.reflect(*sides(spark, sf_dir), ["k"])


@query(f"""
WITH d AS ({V.DENSE}) SELECT a.k, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e, round({SIMILAR}, 9) AS j
  FROM d a JOIN d b ON a.k = b.k AND a.s <= b.e AND a.e >= b.s WHERE a.t = 'R' AND b.t = 'A' AND {SIMILAR} >= 0.5
""")
def similarity_join(spark, sf_dir):
    d = V.dense(spark, sf_dir)
    return P.similar(d.filter("t = 'R'"), d.filter("t = 'A'"), ["k"], 0.5).select(F.col("a_k").alias("k"), "a_s", "a_e", "b_s", "b_e", F.round("j", 9).alias("j"))


@query(f"""
WITH c AS ({V.CALLS}) SELECT * FROM c a WHERE side = 'F' AND EXISTS (SELECT 1
  FROM c b WHERE b.side = 'O' AND a.t = b.t AND a.k = b.k AND a.s <= b.e AND a.e >= b.s AND {SIMILAR} >= 0.5)
""")
def callset_semi(spark, sf_dir):
    return P.matched(*sides(spark, sf_dir), ["t", "k"], 0.5, "left_semi")


@query(f"""
WITH c AS ({V.CALLS}) SELECT * FROM c a WHERE side = 'F' AND NOT EXISTS
  (SELECT 1 FROM c b WHERE b.side = 'O' AND a.t = b.t AND a.k = b.k AND a.s <= b.e AND a.e >= b.s AND {SIMILAR} >= 0.5)
""")
def callset_anti(spark, sf_dir):
    return P.matched(*sides(spark, sf_dir), ["t", "k"], 0.5, "left_anti")


@query(f"WITH c AS ({V.CALLS}), g AS ({V.GENE}) SELECT * FROM c WHERE EXISTS (SELECT 1 FROM g WHERE g.s % 25 = k AND c.s <= g.e AND c.e >= g.s)")
def callset_gene_semi(spark, sf_dir):
    g = V.gene(spark, sf_dir).select((F.col("s") % 25).alias("k"), "s", "e")
    return P.matched(V.calls(spark, sf_dir), g, ["k"], None, "left_semi")


@query(f"""WITH c AS ({V.CALLS}), a AS (SELECT * FROM c WHERE side = 'F'), b AS (SELECT * FROM c WHERE side = 'O'),
h AS (SELECT a.t, a.id AS x, b.id AS y FROM a JOIN b ON a.t = b.t AND a.k = b.k AND a.s <= b.e AND a.e >= b.s AND {SIMILAR} >= 0.5),
p AS (SELECT t, k, unnest(range(s, e + 1)) AS p, side FROM c WHERE side <> 'P'),
q AS (SELECT t, k, p, bool_or(side = 'F') AS f, bool_or(side = 'O') AS o FROM p GROUP BY ALL),
u AS (SELECT t, sum(n - 1) AS l FROM (SELECT t, k, g, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY t, k ORDER BY p) AS g FROM q) GROUP BY ALL) GROUP BY t),
i AS (SELECT t, sum(n - 1) AS l FROM (SELECT t, k, g, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY t, k ORDER BY p) AS g FROM q WHERE f AND o) GROUP BY ALL) GROUP BY t),
m AS (SELECT t, count(*) FILTER (WHERE side = 'F') AS n_a, count(*) FILTER (WHERE side = 'O') AS n_b FROM c WHERE side <> 'P' GROUP BY t),
k AS (SELECT t, count(DISTINCT x) AS x, count(DISTINCT y) AS y FROM h GROUP BY t),
z AS (SELECT m.*, coalesce(k.x, 0) / n_a AS p, coalesce(k.y, 0) / n_b AS r, coalesce(i.l, 0) / u.l AS jj FROM m LEFT JOIN k USING (t) LEFT JOIN i USING (t) LEFT JOIN u USING (t))
SELECT t, n_a, n_b, round(p, 9) AS prec, round(r, 9) AS rec, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, round(jj, 9) AS j FROM z""")
def callset_score(spark, sf_dir):
    return P.score(*sides(spark, sf_dir), "t", ["t", "k"], "id", 0.5)


@query(f"SELECT t, k, count(*) AS n FROM ({V.CALLS}) GROUP BY t, k")
def callset_counts(spark, sf_dir):
    return V.calls(spark, sf_dir).groupBy("t", "k").agg(F.count("*").alias("n"))


COARSE = f"SELECT id, t, side, k, s // 100 AS s, e // 100 AS e FROM ({V.CALLS})"


def coarse(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return tuple(x.withColumn("s", F.floor(F.col("s") / 100)).withColumn("e", F.floor(F.col("e") / 100)) for x in sides(spark, sf_dir))


@query(f"""
WITH c AS ({COARSE}), x AS (SELECT k, s, e, CASE WHEN count(*) FILTER (WHERE side = 'F') > 0 THEN max(id) FILTER
  (WHERE side = 'F') ELSE max(id) END AS id FROM c WHERE side <> 'P' GROUP BY ALL)
  SELECT id, k, s, e FROM x
""")
def callset_union(spark, sf_dir):
    return C.call_union(*coarse(spark, sf_dir), "id").select("id", "k", "s", "e")


@query(f"WITH c AS ({COARSE}) SELECT id, k, s, e FROM c WHERE side = 'F' AND (k, s, e) NOT IN (SELECT (k, s, e) FROM c WHERE side = 'O')")
def callset_diff(spark, sf_dir):
    return C.call_difference(*coarse(spark, sf_dir)).select("id", "k", "s", "e")


INFO = "'SVTYPE=' || left(o_orderpriority, 1) || ';END=' || o_custkey || ';SVLEN=-' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ';IMPRECISE' ELSE '' END"


def infos(spark, sf_dir) -> DataFrame:
    flag = F.when(F.col("o_orderkey") % 3 == 0, ";IMPRECISE").otherwise("")
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("SVTYPE="), F.left("o_orderpriority", F.lit(1)), F.lit(";END="), F.col("o_custkey"), F.lit(";SVLEN=-"), F.col("o_orderkey"), flag).alias("info"))


@query("SELECT o_orderkey AS id, left(o_orderpriority, 1) AS svtype, o_custkey AS end_pos, o_orderkey AS sv_len, o_orderkey % 3 = 0 AS imprecise FROM orders")
def info_parse(spark, sf_dir):
    i = F.col("info")
    return infos(spark, sf_dir).select("id", C.info_value(i, "SVTYPE").alias("svtype"), C.info_value(i, "END").cast("long").alias("end_pos"), F.abs(C.info_value(i, "SVLEN").cast("long")).alias("sv_len"), F.array_contains(F.split("info", ";"), "IMPRECISE").alias("imprecise"))


@query(f"SELECT id, replace(info, ';END=' || c, ';END=' || (c + 7)) AS info FROM (SELECT o_orderkey AS id, o_custkey AS c, {INFO} AS info FROM orders)")
def info_set(spark, sf_dir):
    return infos(spark, sf_dir).select("id", C.info_replace(F.col("info"), "END", C.info_value(F.col("info"), "END").cast("long") + 7).alias("info"))


@query("SELECT doc_id, reverse(translate(text, 'AaTtCcGguUmMrRwWsSyYkKvVhHdDbBxXnN', 'TtAaGgCcAATTCCGGAAGGCCTTGGCCAANNNN')) AS seq FROM documents")
def reverse_complement(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", C.reverse_complement(F.col("text")).alias("seq"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, a.p_type) AS distance FROM part a")
def edit_distance(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("""
WITH g AS (SELECT o_orderkey AS id, o_orderkey % 2 AS a, o_custkey % 2 AS b, o_custkey % 25 AS k
  FROM orders), l AS (SELECT *, k % 5 = 0 AS x, k % 5 = 1 AS y FROM g), m AS
  (SELECT id, k, CASE WHEN x THEN 0 ELSE a END AS h1, CASE WHEN y THEN 0 ELSE b END AS h2
  FROM l) SELECT * FROM m WHERE h1 + h2 > 0
""")
def call_filter_mask(spark, sf_dir):
    k = F.col("o_custkey") % 25
    gt, loss = F.array(F.col("o_orderkey") % 2, F.col("o_custkey") % 2), F.array((k % 5 == 0).cast("long"), (k % 5 == 1).cast("long"))
    masked = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), k.alias("k"), C.mask_genotype(gt, loss).alias("gt"))
    return masked.filter(F.exists("gt", lambda x: x == 1)).select("id", "k", F.col("gt")[0].alias("h1"), F.col("gt")[1].alias("h2"))


@query("""
SELECT o_orderkey AS id, clone, CASE clone WHEN 0 THEN (o_orderkey % 2) || '|' || (o_custkey % 2) WHEN 1 THEN '0|' || (o_orderkey % 2) ELSE (o_custkey
  % 2) || '|0' END AS gt FROM orders, (VALUES (0), (1), (2)) c(clone) WHERE CASE clone WHEN 0 THEN o_orderkey % 2 + o_custkey % 2 WHEN 1 THEN
  o_orderkey % 2 ELSE o_custkey % 2 END > 0
""")
def clone_unpivot(spark, sf_dir):
    a, b = (F.col("o_orderkey") % 2).cast("string"), (F.col("o_custkey") % 2).cast("string")
    columns = F.array(F.concat(a, F.lit("|"), b), F.concat(F.lit("0|"), a), F.concat(b, F.lit("|0")))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(columns).alias("clone", "gt")).filter(F.contains("gt", F.lit("1")))


@query(f"WITH g AS ({V.GENE}), l AS (SELECT DISTINCT p_name AS symbol FROM part WHERE p_size > 40) SELECT g.* FROM g SEMI JOIN l USING (symbol)")
def gene_lookup(spark, sf_dir):
    wanted = V.table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_name").alias("symbol")).distinct()
    return V.gene(spark, sf_dir).join(wanted, "symbol", "left_semi").select("symbol", "chrom", "s", "e")


@query(f"""
WITH g AS (SELECT t, count(*) AS a FROM ({V.CALLS}) WHERE side = 'F' GROUP BY t), b AS
  (SELECT t, count(*) AS c FROM ({V.CALLS}) WHERE side = 'O' GROUP BY t)
  SELECT t, a, round(ln((a / sum(a) OVER ()) / (c / sum(c) OVER ())), 9) AS log_odds
  FROM g JOIN b USING (t)
""")
def gene_log_odds(spark, sf_dir):
    c = V.calls(spark, sf_dir).groupBy("t").agg(F.count_if(F.col("side") == "F").alias("a"), F.count_if(F.col("side") == "O").alias("c"))
    whole = F.broadcast(c.agg(F.sum("a").alias("all_a"), F.sum("c").alias("all_c")))
    ratio = F.try_divide(F.try_divide("a", "all_a"), F.try_divide("c", "all_c"))
    return c.join(whole).select("t", "a", F.round(F.when(ratio > 0, F.ln(ratio)), 9).alias("log_odds"))


@query(f"SELECT t, side, count(*) AS n FROM ({V.CALLS}) GROUP BY GROUPING SETS ((t, side), (t), ())")
def effect_groupings(spark, sf_dir):
    return V.calls(spark, sf_dir).groupingSets([["t", "side"], ["t"], []], "t", "side").agg(F.count("*").alias("n"))


@query("""
SELECT DISTINCT p_name AS symbol FROM part WHERE p_size > 25 AND p_name NOT IN
  (SELECT p_name FROM part WHERE p_size < 2) AND p_name IN (SELECT p_name
  FROM part WHERE p_retailprice > 950)
""")
def expression_sets(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").withColumnRenamed("p_name", "symbol")
    return p.filter("p_size > 25").select("symbol").distinct().join(p.filter("p_size < 2"), "symbol", "left_anti").join(p.filter("p_retailprice > 950"), "symbol", "left_semi")


@query(f"SELECT t, round(avg(e - s), 6) AS mean_size, round(max(e - s)::DOUBLE, 6) AS max_size FROM ({V.CALLS}) GROUP BY t")
def mean_size(spark, sf_dir):
    size = F.col("e") - F.col("s")
    return V.calls(spark, sf_dir).groupBy("t").agg(F.round(F.avg(size), 6).alias("mean_size"), F.round(F.max(size).cast("double"), 6).alias("max_size"))


@query(f"WITH n AS (SELECT k, sum(e - s) AS l FROM ({V.CALLS}) GROUP BY k) SELECT k, round(l / (SELECT max(l) FROM n), 9) AS ratio FROM n")
def ratio_to_largest(spark, sf_dir):
    n = V.calls(spark, sf_dir).groupBy("k").agg(F.sum(F.col("e") - F.col("s")).alias("l"))
    return n.join(F.broadcast(n.agg(F.max("l").alias("most")))).select("k", F.round(F.col("l") / F.col("most"), 9).alias("ratio"))


@query("""
SELECT s_name AS chrom, s_suppkey AS len, coalesce(sum(s_suppkey) OVER (ORDER BY s_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  0)::BIGINT AS start FROM supplier
""")
def contig_offsets(spark, sf_dir):
    lengths = V.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("chrom"), F.col("s_suppkey").alias("len"))
    return running_total(lengths, [F.desc("len"), F.asc("chrom")], "len", "start")


@query("SELECT chrom, row_number() OVER (ORDER BY length(chrom), chrom) AS place FROM (SELECT n_nationkey::VARCHAR AS chrom FROM nation UNION SELECT 'X' UNION SELECT 'MT')")
def contig_sort(spark, sf_dir):
    names = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("chrom")).union(spark.sql("VALUES ('X'), ('MT')"))
    return numbered(names, [C.contig_order(F.col("chrom"))], "place")


@query(f"""
WITH RECURSIVE e AS ({V.TREE}), c AS (SELECT child AS node, child AS ancestor, 0 AS depth
  FROM e UNION ALL SELECT 0, 0, 0 UNION ALL SELECT c.node, e.parent, c.depth + 1
  FROM c JOIN e ON e.child = c.ancestor) SELECT ancestor::INTEGER AS ancestor, node::INTEGER AS node, depth
  FROM c
""")
def clone_closure(spark, sf_dir):
    return T.closure(V.tree(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS ({V.TREE}), c AS (SELECT child AS node, child AS ancestor
  FROM e UNION ALL SELECT 0, 0 UNION ALL SELECT c.node, e.parent FROM c JOIN e ON e.child = c.ancestor)
  SELECT ancestor::INTEGER AS node, count(*) AS freq FROM c GROUP BY ancestor
""")
def clone_frequency(spark, sf_dir):
    return T.frequency(V.tree(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS ({V.TREE}), c AS (SELECT child AS node, child AS ancestor
  FROM e UNION ALL SELECT 0, 0 UNION ALL SELECT c.node, e.parent FROM c JOIN e ON e.child = c.ancestor)
  SELECT DISTINCT c.node::INTEGER AS clone, s_suppkey AS variant FROM c JOIN supplier ON s_nationkey = ancestor
""")
def clone_alleles(spark, sf_dir):
    parts = V.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("variant"))
    return T.allele_map(V.tree(spark, sf_dir), parts)


@query(f"SELECT id, t, side, k, s, e FROM ({V.CALLS}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('7:' || id), id) <= 10")
def sample_calls(spark, sf_dir):
    """Ten calls of each contig in the order of a seeded hash, the same whatever the partitions."""
    order = Window.partitionBy("k").orderBy(F.md5(F.concat(F.lit("7:"), F.col("id").cast("string"))), "id")
    return V.calls(spark, sf_dir).withColumn("rn", F.row_number().over(order)).filter("rn <= 10").drop("rn")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
