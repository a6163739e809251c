"""Queries of weights, classes, normal and somatic calls, filters and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoloom.catalogue import SIMILAR, infos, query, sides
from genoloom.functions import text as X
from genoloom.operators import intervals as I
from genoloom.operators import compare as P
from genoloom.operators import somatic as S
from genoloom.operators import weights as W
from genoloom.plans import views as V

#: SQL: segments of weighted intervals, with what lies over each.
SEGMENTS = f"""d AS (SELECT k, s, e, 1 + (e - s) % 3 AS w FROM ({V.CALLS})), p AS (SELECT k, s AS x FROM d UNION SELECT k, e + 1 FROM d),
g AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e FROM p),
u AS (SELECT g.k, g.s, g.e, sum(w) AS total, product(w) AS product, sum(w * (d.e - d.s + 1) / (g.e - g.s + 1)) AS density FROM g JOIN d ON d.k = g.k AND d.s <= g.e AND d.e >= g.s GROUP BY ALL),
m AS (SELECT min(total) AS ta, max(total) AS tb, min(product) AS pa, max(product) AS pb, min(density) AS da, max(density) AS db FROM u)"""
ADD, MULT = "9 / (tb - ta + 1) * (total - ta) + 1", "9 / CASE WHEN pb = pa THEN 1 ELSE pb - pa END * (product - pa) + 1"
SCALES = {"add": ADD, "len": "9 / (db - da + 1) * (density - da) + 1", "log": "9 * log10(1 + total / ta) / log10(1 + tb - ta) + 1", "mult": MULT, "add_mult": f"({ADD}) * ({MULT})"}


def weighted(spark, sf_dir):
    return V.calls(spark, sf_dir).withColumn("w", (1 + (F.col("e") - F.col("s")) % 3).cast("double"))


def scale_query(method: str):
    def run(spark, sf_dir):
        found = W.scaled(W.weighted_segments(weighted(spark, sf_dir), ["k"], "w"), method.replace("_", "-"), 1.0, 10.0)
        return found.select("k", "s", "e", F.round("weight", 6).alias("weight"))

    run.__name__ = f"segment_weights_{method}"
    return run


for name, formula in SCALES.items():
    query(f"WITH {SEGMENTS} SELECT k, s, e, round({formula}, 6) AS weight FROM u, m")(scale_query(name))

LIMITS = "SELECT k, 0::BIGINT AS s, max(e) AS e FROM c GROUP BY k"


@query(f"""
WITH c AS ({V.CALLS}), d AS (SELECT k, s, e, 1 + (e - s) % 3 AS w FROM c
  UNION ALL SELECT k, s, e, 0.5 FROM ({LIMITS})), p AS (SELECT k, s AS x
  FROM d UNION SELECT k, e + 1 FROM d), g AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p), u AS (SELECT g.k, g.s, g.e, sum(w) AS total FROM g JOIN d ON d.k = g.k AND d.s <= g.e AND d.e >= g.s
  GROUP BY ALL), m AS (SELECT min(total) AS a, max(total) AS b FROM u) SELECT k, s, e, round(1 / (b - a + 1) * (total - a), 6)::DOUBLE AS weight
  FROM u, m
""")
def sampling_distribution(spark, sf_dir):
    calls = weighted(spark, sf_dir)
    limits = calls.groupBy("k").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e"))
    return W.distribution(calls, limits, ["k"], "w", 0.5, "add").select("k", "s", "e", F.round("weight", 6).alias("weight"))


@query(f"""
WITH c AS ({V.CALLS}), x AS (SELECT k, s, e FROM c WHERE (e - s) % 3 = 0), g AS
  (SELECT k, unnest(range(s, e + 1)) AS p FROM x), h AS (SELECT DISTINCT k, p
  FROM g), i AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS n
  FROM h) SELECT k, min(p) AS s, max(p) AS e FROM i GROUP BY k, n
""")
def unweighted_regions(spark, sf_dir):
    return W.unweighted(V.calls(spark, sf_dir).withColumn("weight", (F.col("e") - F.col("s")) % 3), ["k"])


@query(f"""
WITH d AS ({V.DENSE}), p AS (SELECT k, s AS x FROM d UNION SELECT k, e + 1
  FROM d), g AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p), h AS (SELECT g.k, g.s, g.e, t, count(DISTINCT d.s * 1000 + d.e - d.s) AS n
  FROM g JOIN d ON d.k = g.k AND d.s <= g.e AND d.e >= g.s GROUP BY ALL)
  SELECT k, s, e, sum(n)::BIGINT AS weight, arg_max(t, {{'n': n, 't': t}}) AS major
  FROM h GROUP BY k, s, e HAVING sum(n) BETWEEN 2 AND 12
""")
def majority_class(spark, sf_dir):
    d = V.dense(spark, sf_dir).withColumn("id", F.col("s") * 1000 + F.col("e") - F.col("s"))
    return W.majority(d, ["k"], "t", "id", 2, 12)


GENES = f"SELECT symbol, s % 25 AS k, s, e FROM ({V.GENE})"


def genes(spark, sf_dir):
    return V.gene(spark, sf_dir).select("symbol", (F.col("s") % 25).alias("k"), "s", "e")


@query(f"""
WITH c AS ({V.CALLS}), g AS ({GENES}), n AS (SELECT k, count(DISTINCT symbol) AS genes
  FROM g GROUP BY k), h AS (SELECT c.k, c.t, count(DISTINCT symbol) AS hit
  FROM c JOIN g ON g.k = c.k AND c.s <= g.e AND c.e >= g.s GROUP BY ALL), v AS
  (SELECT k, t, count(*) AS events FROM c GROUP BY ALL) SELECT v.k, v.t, coalesce(hit, 0) AS hit, coalesce(genes, 0) AS genes, events
  FROM v LEFT JOIN h USING (k, t) LEFT JOIN n USING (k)
""")
def class_enrichment(spark, sf_dir):
    return W.enrichment(V.calls(spark, sf_dir), genes(spark, sf_dir), ["k"], "t", "symbol")


@query(f"""
WITH c AS ({V.CALLS}), p AS (SELECT k, s AS x FROM c UNION SELECT k, e + 1
  FROM c), w AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p), y AS (SELECT w.k, w.s, w.e, min(CASE side WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS r
  FROM w JOIN c ON c.k = w.k AND c.s <= w.e AND c.e >= w.s GROUP BY ALL)
  SELECT DISTINCT symbol, CASE r WHEN 1 THEN 'F' WHEN 2 THEN 'O' ELSE 'P' END AS effect
  FROM y JOIN ({GENES}) g ON g.k = y.k AND y.s <= g.e AND y.e >= g.s
""")
def gene_effects(spark, sf_dir):
    return W.effects(V.calls(spark, sf_dir), genes(spark, sf_dir), ["k"], "side", "symbol", {"F": 1, "O": 2, "P": 3})


@query(f"""
WITH r AS (SELECT t, unnest([100, 200, 400])::DOUBLE AS size, 0.001::DOUBLE AS rate
  FROM (SELECT DISTINCT t FROM ({V.CALLS}))), c AS (SELECT id, t, e - s + 1 AS n
  FROM ({V.CALLS})), h AS (SELECT id, c.t, min(size) AS size FROM c, (VALUES (100.0::DOUBLE), (200.0::DOUBLE), (400.0::DOUBLE)) v(size)
  WHERE n BETWEEN 0.5001 * size AND 1.5 * size GROUP BY ALL), o AS (SELECT t, size, count(*) AS observed
  FROM h GROUP BY ALL) SELECT r.t, r.size, rate, coalesce(observed, 0) AS observed, round(coalesce(observed, 0) / (rate * 1000000), 9) AS ratio
  FROM r LEFT JOIN o USING (t, size)
""")
def rate_bins(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    rates = c.select("t").distinct().select("t", F.explode(F.array(*map(F.lit, (100.0, 200.0, 400.0)))).alias("size"), F.lit(0.001).alias("rate"))
    return W.rate_bins(c, rates, "t", F.col("e") - F.col("s") + 1, 1e6).withColumn("ratio", F.round("ratio", 9))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 AND p_size > 0 AND ln(1 + p_size / 10.0) <> 0 THEN round(ln(1 + p_size / (p_partkey % 4)) / ln(1 + 7 /
  p_size), 9) END AS lods FROM part
""")
def log_ratio(spark, sf_dir):
    size = F.col("p_size")
    return V.table(spark, sf_dir, "part").select("p_partkey", F.round(W.log_ratio(size, F.col("p_partkey") % 4, F.lit(7), size), 9).alias("lods"))


#: Normal and somatic calls: sides F and O on coarse places, genotypes by parity.
COARSE = f"SELECT id, t, side, k, s // 500 AS s, s // 500 + 1 AS e, [(id % 2) || '|' || (s % 2), (k % 2) || '|1'] AS gts FROM ({V.CALLS})"


def normal_somatic(spark, sf_dir):
    gts = F.array(F.concat_ws("|", (F.col("id") % 2).cast("string"), (F.col("s") % 2).cast("string")), F.concat((F.col("k") % 2).cast("string"), F.lit("|1")))
    c = V.calls(spark, sf_dir).withColumn("gts", gts).withColumn("s", F.floor(F.col("s") / 500)).withColumn("e", F.col("s") + 1)
    return c.filter("side = 'F'").drop("side"), c.filter("side = 'O'").drop("side")


@query(f"""
WITH c AS ({COARSE}), x AS (SELECT *, row_number() OVER (PARTITION BY k, s, e, t, gts[1] ORDER BY side, id) AS rn
  FROM c WHERE side <> 'P') SELECT id, t, k, s, e, CASE WHEN side = 'F' THEN [gts[1], gts[1], gts[1]] ELSE gts END AS gts
  FROM x WHERE rn = 1
""")
def somatic_merge(spark, sf_dir):
    return S.merged(*normal_somatic(spark, sf_dir), 2).select("id", "t", "k", "s", "e", "gts")


@query(f"""
WITH c AS ({COARSE}) SELECT k, s, e, t, gts[1] AS gt, min(id) AS id FROM c
  WHERE side = 'O' AND (k, s, e, t, gts[1]) NOT IN (SELECT (k, s, e, t, gts[1])
  FROM c WHERE side = 'F') GROUP BY ALL
""")
def somatic_split(spark, sf_dir):
    normal, somatic = normal_somatic(spark, sf_dir)
    return S.split(somatic, normal)


@query(f"WITH c AS ({COARSE}) SELECT id FROM c WHERE split_part(gts[2], '|', 1) = '1'")
def haplotype_filter(spark, sf_dir):
    normal, somatic = normal_somatic(spark, sf_dir)
    rest = V.calls(spark, sf_dir).filter("side = 'P'").select("id", F.array(F.lit("x"), F.concat((F.col("k") % 2).cast("string"), F.lit("|1"))).alias("gts"))
    return normal.select("id", "gts").union(somatic.select("id", "gts")).union(rest).filter(S.on_haplotype(1, 0)).select("id")


@query(f"""
WITH c AS (SELECT id, k, s, e, id % 2 AS a, s % 2 AS b FROM ({V.CALLS})
  WHERE e - s + 1 BETWEEN 100 AND 300), m AS (SELECT id, k, s, e, CASE WHEN k % 5 = 0 THEN 0 ELSE a END AS h1, CASE WHEN k % 5 = 1 THEN 0 ELSE b END
  AS h2 FROM c) SELECT * FROM m WHERE h1 + h2 > 0 UNION ALL SELECT -k - 1, k, 0, 1000, 1, 0
  FROM (SELECT DISTINCT k FROM ({V.CALLS}) WHERE k % 5 < 2)
""")
def final_call_filter(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    calls = c.select("id", "k", "s", "e", F.array(F.col("id") % 2, F.col("s") % 2).alias("gt"))
    k = F.col("k")
    losses = c.select("k").distinct().filter("k % 5 < 2").select("k", F.array((k % 5 == 0).cast("long"), (k % 5 == 1).cast("long")).alias("loss"))
    extra = losses.select((-k - 1).alias("id"), "k", F.lit(0).cast("long").alias("s"), F.lit(1000).cast("long").alias("e"), F.array(F.lit(1).cast("long"), F.lit(0).cast("long")).alias("gt"))
    return S.final_calls(calls, losses, extra, 100, 300).select("id", "k", "s", "e", F.col("gt")[0].alias("h1"), F.col("gt")[1].alias("h2"))


@query(f"SELECT id FROM ({V.CALLS}) WHERE abs(e - s + 1) BETWEEN 100 AND 200")
def size_filter(spark, sf_dir):
    return V.calls(spark, sf_dir).filter(F.abs(F.col("e") - F.col("s") + 1).between(100, 200)).select("id")


@query("SELECT doc_id FROM documents WHERE length(text) > 20 AND 2 * (length(text) - length(replace(text, 'N', ''))) > length(text)")
def unknown_filter(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").filter(S.mostly_unknown(F.col("text"), 20)).select("doc_id")


@query(f"SELECT DISTINCT t FROM ({V.CALLS}) WHERE k IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def classes_of_contigs(spark, sf_dir):
    contigs = V.table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("k"))
    return V.calls(spark, sf_dir).join(contigs, "k", "left_semi").select("t").distinct()


@query(f"SELECT k FROM (SELECT DISTINCT k FROM ({V.CALLS})) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def contigs_without_reference(spark, sf_dir):
    there = V.table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("k"))
    return V.calls(spark, sf_dir).select("k").distinct().join(there, "k", "left_anti")


@query("SELECT s_name AS chrom, s_suppkey AS len FROM supplier ORDER BY s_suppkey DESC LIMIT 5")
def longest_contigs(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").orderBy(F.desc("s_suppkey")).limit(5).select(F.col("s_name").alias("chrom"), F.col("s_suppkey").alias("len"))


@query(f"SELECT id, least(s, e - 200) AS s, greatest(s, e - 200) AS e FROM ({V.CALLS})")
def normalised_coordinates(spark, sf_dir):
    return V.calls(spark, sf_dir).withColumn("e", F.col("e") - 200).select("id", F.least("s", "e").alias("s"), F.greatest("s", "e").alias("e"))


@query(f"""
WITH c AS ({V.CALLS}) SELECT a.id, coalesce(max(b.id), -1) AS outer_id FROM c a
  LEFT JOIN c b ON a.k = b.k AND b.side = 'F' AND a.s <= b.e AND a.e >= b.s
  WHERE a.side = 'O' GROUP BY a.id
""")
def inner_genotype(spark, sf_dir):
    outer, inner = sides(spark, sf_dir)
    found = S.inherited_genotypes(inner, outer.withColumn("gt", F.col("id").cast("string")), ["k"])
    return found.select("id", F.coalesce(F.col("gt").try_cast("long"), F.lit(-1)).alias("outer_id"))


@query("""
WITH w AS (SELECT p_partkey, p_partkey % 700 AS n FROM part), g AS (SELECT DISTINCT s_suppkey * 13 % 400 AS m
  FROM supplier) SELECT p_partkey, CASE WHEN 2 * arg_min(m, {'d': abs(m - n), 'm': -m}) >= n THEN arg_min(m, {'d': abs(m - n), 'm': -m}) ELSE -1 END
  AS nearest FROM w, g GROUP BY p_partkey, n
""")
def nearest_length(spark, sf_dir):
    wanted = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 700).alias("n"))
    given = V.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 13 % 400).alias("n"))
    return S.nearest_length(wanted, given, "p_partkey", "n").fillna(-1)


@query(f"WITH c AS ({V.CALLS}) SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.k = b.k AND a.t = b.t AND a.id < b.id AND a.s <= b.e AND a.e >= b.s")
def call_conflicts(spark, sf_dir):
    return S.conflicts(V.calls(spark, sf_dir), ["k", "t"])


#: SQL: of each k the calls that stay when they go one by one in the order r and none may overlap one that stayed.
GREEDY = """WITH RECURSIVE c AS ({calls}), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS r FROM (SELECT *, count(*) OVER (PARTITION BY k, t) AS often FROM c)),
g AS (
  SELECT DISTINCT k, 0::BIGINT AS r, []::STRUCT(id BIGINT, s BIGINT, e BIGINT)[] AS stay FROM o
  UNION ALL
  SELECT o.k, o.r, CASE WHEN len(list_filter(g.stay, lambda x: x.s <= o.e AND x.e >= o.s)) > 0 THEN g.stay ELSE list_append(g.stay, {{'id': o.id, 's': o.s, 'e': o.e}}) END
  FROM g JOIN o ON o.k = g.k AND o.r = g.r + 1)
SELECT k, unnest({stay}, recursive := true) FROM (SELECT k, arg_max(stay, r) AS stay FROM g GROUP BY k)"""


@query("SELECT id, k, s, e FROM (" + GREEDY.format(calls=V.CALLS, order="often, md5(id::VARCHAR), id", stay="stay") + ")")
def conflicts_removed(spark, sf_dir):
    return S.without_conflicts(V.calls(spark, sf_dir), ["k"]).select("id", "k", "s", "e")


@query("SELECT id, k, s, e FROM (" + GREEDY.format(calls=V.CALLS, order="md5('x' || id), id", stay="stay[1:12]") + ")")
def first_disjoint_events(spark, sf_dir):
    return S.first_disjoint(V.calls(spark, sf_dir), ["k"], F.md5(F.concat(F.lit("x"), F.col("id").cast("string"))), 12).select("id", "k", "s", "e")


@query(f"""WITH c AS ({V.CALLS}), g AS ({GENES}), h AS (SELECT DISTINCT c.k, c.id, g.symbol, min(struct_pack(s := g.s, e := g.e, symbol := g.symbol)) OVER (PARTITION BY c.k, c.id) AS first FROM c JOIN g ON g.k = c.k AND c.s <= g.e AND c.e >= g.s),
d AS (SELECT k, symbol, count(*) AS n, min(id) AS least, min(id) FILTER (WHERE first.symbol = symbol) AS chooser FROM h GROUP BY ALL)
SELECT g.k, g.s, g.e, coalesce(chooser, least) AS id, d.symbol FROM d JOIN g USING (k, symbol) WHERE n = 1 OR chooser IS NOT NULL
UNION ALL SELECT k, s, e, id, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = c.k AND c.s <= g.e AND c.e >= g.s)""")
def events_split_over_genes(spark, sf_dir):
    return S.split_over_genes(V.calls(spark, sf_dir), genes(spark, sf_dir), ["k"])


@query(f"""
WITH d AS ({V.CALLS}), p AS (SELECT k, s AS x FROM d UNION SELECT k, e + 1
  FROM d), w AS (SELECT k, x AS s, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS e
  FROM p) SELECT w.k, w.s, w.e, count(*) AS depth, count(DISTINCT t) > 1 AS mixed
  FROM w JOIN d ON d.k = w.k AND d.s <= w.e AND d.e >= w.s GROUP BY ALL HAVING count(*) > 1
""")
def overlap_flags(spark, sf_dir):
    return I.overlapping(V.calls(spark, sf_dir), ["k"], "t")


@query(f"""
WITH c AS ({V.CALLS}), g AS ({GENES}) SELECT id, c.k, least(c.s, coalesce(min(g.s), c.s)) AS s, greatest(c.e, coalesce(max(g.e), c.e)) AS e
  FROM c LEFT JOIN g ON g.k = c.k AND c.s <= g.e AND c.e >= g.s GROUP BY id, c.k, c.s, c.e
""")
def events_to_gene_bounds(spark, sf_dir):
    return S.extended(V.calls(spark, sf_dir), genes(spark, sf_dir), ["k"])


@query("""
SELECT n_nationkey, CASE WHEN (SELECT count(*) FILTER (WHERE n_nationkey % 3 > 0) * 2 > count(*)
  FROM nation) THEN 'chr' || n_nationkey ELSE n_nationkey::VARCHAR END AS chrom
  FROM nation
""")
def contig_rename(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 3 > 0, "chr").otherwise(""), F.col("n_nationkey").cast("string")).alias("name"))
    style = n.agg((2 * F.count_if(F.col("name").startswith("chr")) > F.count("*")).alias("prefixed"))
    return n.join(F.broadcast(style)).select("n_nationkey", X.contig_style(F.col("name"), F.col("prefixed")).alias("chrom"))


@query(f"""
WITH c AS ({V.CALLS}), h AS (SELECT a.t, a.k % 5 AS sample, count(DISTINCT a.id) AS ok
  FROM c a JOIN c b ON a.t = b.t AND a.k = b.k AND a.s <= b.e AND a.e >= b.s AND {SIMILAR} >= 0.5
  WHERE a.side = 'F' AND b.side = 'O' GROUP BY ALL), n AS (SELECT t, k % 5 AS sample, count(*) AS n
  FROM c WHERE side = 'F' GROUP BY ALL) SELECT sample, round(sum(coalesce(ok, 0) / n) / 5, 9) AS mean
  FROM n LEFT JOIN h USING (t, sample) GROUP BY sample
""")
def nearest_sample(spark, sf_dir):
    """Each sample's mean share of calls with a partner over the five types, whether it has them or not."""
    a, b = sides(spark, sf_dir)
    sample = (F.col("k") % 5).alias("sample")
    n = a.groupBy("t", sample).agg(F.count("*").alias("n"))
    ok = P.matched(a, b, ["t", "k"], 0.5, "left_semi").groupBy("t", sample).agg(F.count("*").alias("ok"))
    return n.join(ok, ["t", "sample"], "left").groupBy("sample").agg(F.round(F.sum(F.coalesce("ok", F.lit(0)) / F.col("n")) / 5, 9).alias("mean"))


@query("SELECT o_orderkey AS id, 'DISPERSED' AS type, (o_orderkey % 7)::INTEGER AS copies, [o_custkey, o_custkey + 9] AS positions FROM orders")
def typed_info(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    info = F.concat(F.lit("SVTYPE=DUP;DUP_TYPE=DISPERSED;ICN="), (F.col("o_orderkey") % 7).cast("string"), F.lit(";DUP_POS="), c.cast("string"), F.lit(","), (c + 9).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), X.duplication(info).alias("d")).select("id", "d.*")


@query("SELECT p_partkey, [substr(p_name, 1, 3), substr(p_name, 4, 4), substr(p_name, 8)] AS pieces, repeat(p_brand, 2) AS twice FROM part")
def split_and_repeat(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", X.split_at(F.col("p_name"), F.array(F.lit(3), F.lit(7))).alias("pieces"), F.repeat("p_brand", F.lit(2)).alias("twice"))


@query("""
SELECT doc_id, list_transform(range(1, len(x)), lambda i: (list_sum(list_transform(x[1:i], lambda p: length(p))) + (i - 1) * 2)::INTEGER) AS places
  FROM (SELECT doc_id, string_split(text, 'an') AS x FROM documents WHERE text IS NOT NULL)
""")
def literal_positions(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", X.positions(F.col("text"), "an").alias("places"))


@query("""
SELECT o_orderkey AS id, CASE WHEN n >= 1000000000000 THEN (n // 1000000000000) || 'TB' WHEN n >= 1000000000 THEN (n // 1000000000) || 'GB' WHEN n >=
  1000000 THEN (n // 1000000) || 'MB' WHEN n >= 1000 THEN (n // 1000) || 'KB' ELSE n || 'B' END AS pretty, round(50 / (1 + o_orderkey % 9) * 2 *
  100)::BIGINT AS expected FROM (SELECT o_orderkey, o_custkey * o_custkey * o_custkey AS n
  FROM orders)
""")
def pretty_sizes(spark, sf_dir):
    c = F.col("o_custkey")
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.pretty_size(c * c * c).alias("pretty"), X.expected_window(1 + F.col("o_orderkey") % 9, F.lit(100), F.lit(50)).alias("expected"))


@query(f"""
WITH c AS ({V.CALLS}), a AS (SELECT k, s, e FROM c WHERE side = 'F' AND t LIKE '1%'), m AS
  (SELECT k, unnest(range(0, max(e) + 1)) AS p FROM c GROUP BY k), x AS
  (SELECT k, p FROM m EXCEPT SELECT k, unnest(range(s, e + 1)) FROM a), g AS
  (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS i FROM x)
  SELECT k, min(p) AS s, max(p) AS e FROM g GROUP BY k, i
""")
def open_positions(spark, sf_dir):
    c = V.calls(spark, sf_dir)
    return I.complement(c.filter("side = 'F' AND t LIKE '1%'"), c.groupBy("k").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e")), ["k"])
