"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.operators import matrix as mx
from strandframe.operators import stats as st
from strandframe.operators.control import finished_names, pending, same_order
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table


def _side(spark, sf, kind: str):
    """Events of one type as intervals, by user group in place of chromosomes."""
    p = S.peaks(spark, sf).where(F.col("chr") == kind)
    return p.select("ord", F.col("sample").cast("string").alias("chr"), "start", "stop", "q")


_SIDES = "a AS (SELECT ord, CAST(sample AS VARCHAR) AS chr, start, stop FROM peaks WHERE chr = 'error'), b AS (SELECT ord, CAST(sample AS VARCHAR) AS chr, start, stop FROM peaks WHERE chr = 'signup')"
_HIT = "a.chr = b.chr AND a.start < b.stop AND b.start < a.stop"


@query("J1_match", "SELECT s.n, coalesce(r.i, -1) AS idx FROM (SELECT n_nationkey AS n, substr(n_name, 1, 1) AS c FROM nation) s LEFT JOIN (SELECT substr(r_name, 1, 1) AS c, min(r_regionkey) AS i FROM region GROUP BY 1) r USING (c)")
def j1(spark, sf):
    look = read_table(spark, sf, "region").select(F.substring("r_name", 1, 1).alias("c"), F.col("r_regionkey").alias("i"))
    names = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.substring("n_name", 1, 1).alias("c"))
    first = look.groupBy("c").agg(F.min("i").alias("i"))
    return names.join(first, "c", "left").select("n", F.coalesce("i", F.lit(-1)).alias("idx"))


@query("J2_left_join_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS gene_cluster, coalesce(l.toxic, -1) AS peak_cluster FROM documents d LEFT JOIN labels l USING (doc_id)")
def j2(spark, sf):
    both = read_table(spark, sf, "documents").select("doc_id").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("gene_cluster"), F.coalesce("toxic", F.lit(-1)).alias("peak_cluster"))


@query("J3_densify_ids", "WITH e AS (SELECT DISTINCT l_partkey AS e1, l_suppkey + 1000000 AS e2 FROM lineitem), v AS (SELECT e1 AS x FROM e UNION SELECT e2 FROM e), i AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS n FROM v) SELECT a.n AS e1, b.n AS e2 FROM e JOIN i a ON a.x = e.e1 JOIN i b ON b.x = e.e2")
def j3(spark, sf):
    e = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("e1"), (F.col("l_suppkey") + 1000000).alias("e2")).distinct()
    ids = mx.dense_ids(e.select(F.col("e1").alias("x")).union(e.select(F.col("e2").alias("x"))).distinct(), "x")
    out = e.join(ids.select(F.col("x").alias("e1"), F.col("n").alias("n1")), "e1").join(ids.select(F.col("x").alias("e2"), F.col("n").alias("n2")), "e2")
    return out.select(F.col("n1").alias("e1"), F.col("n2").alias("e2"))


@query("J4_inner_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j4(spark, sf):
    c, n, r = (read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("J5_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j5(spark, sf):
    c = read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read_table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("J6_interval_anti", sql("peaks", f"WITH {_SIDES} SELECT ord, chr, start, stop FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_HIT})"))
def j6(spark, sf):
    return iv.overlap_anti(_side(spark, sf, "error"), _side(spark, sf, "signup"), "ord").select("ord", "chr", "start", "stop")


@query("J7_interval_semi", sql("peaks", f"WITH {_SIDES} SELECT ord, chr, start, stop FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_HIT})"))
def j7(spark, sf):
    return iv.overlap_semi(_side(spark, sf, "error"), _side(spark, sf, "signup"), "ord").select("ord", "chr", "start", "stop")


@query("J8_interval_count", sql("peaks", f"WITH {_SIDES} SELECT a.ord, count(b.ord) AS n FROM a LEFT JOIN b ON {_HIT} GROUP BY a.ord"))
def j8(spark, sf):
    b = _side(spark, sf, "signup").withColumnRenamed("ord", "read")
    return iv.overlap_count(_side(spark, sf, "error"), b, "ord", "read").select("ord", "n")


_NEAREST = """
WITH {sides}, d AS (
  SELECT a.ord, b.ord AS b_ord, b.start AS bs, b.stop AS be,
    CASE WHEN b.ord IS NULL THEN NULL WHEN a.start < b.stop AND b.start < a.stop THEN 0 WHEN b.start >= a.stop THEN b.start - a.stop + 1 ELSE a.start - b.stop + 1 END AS distance
  FROM a LEFT JOIN b ON a.chr = b.chr
), r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY distance, bs, be, b_ord) AS k FROM d)
SELECT ord, coalesce(b_ord, -1) AS b_ord, CAST(coalesce(distance, -1) AS BIGINT) AS distance FROM r WHERE k = 1
"""


@query("J9_nearest_interval", sql("peaks", _NEAREST.format(sides=_SIDES.replace("'signup')", "'signup' AND sample <> 3)"))))
def j9(spark, sf):
    b = _side(spark, sf, "signup").where("chr <> '3'").withColumnRenamed("ord", "b_ord")
    return iv.nearest(_side(spark, sf, "error"), b, "ord", "b_ord").select("ord", F.coalesce("b_ord", F.lit(-1)).alias("b_ord"), F.coalesce("distance", F.lit(-1)).alias("distance"))


_SAMPLES = list(range(10))


@query("J10_presence", sql("peaks", "WITH w AS (SELECT ord, chr, start, stop FROM peaks) SELECT w.ord, " + ", ".join(f"CAST(coalesce(max(CASE WHEN p.sample = {s} THEN 1 END), 0) AS INTEGER) AS s{s}" for s in _SAMPLES) + " FROM w LEFT JOIN peaks p ON p.chr = w.chr AND p.start < w.stop AND w.start < p.stop GROUP BY w.ord"))
def j10(spark, sf):
    p = S.peaks(spark, sf)
    return iv.presence(p, p, "ord", _SAMPLES)


@query("J11_block_self_join", sql("bits", "WITH r AS (SELECT row_id, sum(x) AS ones, list(x ORDER BY col_id) AS v FROM bits GROUP BY row_id), d AS (SELECT a.ones AS n1, b.ones AS n2, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS d FROM r a JOIN r b ON a.row_id <> b.row_id AND b.ones - a.ones IN (0, 1)) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, d, count(*) AS pairs FROM d GROUP BY n1, n2, d"))
def j11(spark, sf):
    d = st.distance_histogram(mx.pack(S.bits(spark, sf), 64), 64)
    return d.groupBy("n1", "n2", "d").agg(F.sum("n").alias("pairs")).select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.col("d").cast("long").alias("d"), "pairs")


@query("J12_replicate_pairs", "SELECT a.conv_id, a.turn AS i, b.turn AS j FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def j12(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn")
    return c.select("conv_id", F.col("turn").alias("i")).join(c.select("conv_id", F.col("turn").alias("j")), "conv_id").where("i < j")


@query("J13_expand_grid", "SELECT a.c || b.c || d.c AS word FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS c) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) b, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) d")
def j13(spark, sf):
    letters = F.array(*map(F.lit, "ACGT"))
    g = spark.range(1).select(F.explode(letters).alias("a"))
    for c in "bc":
        g = g.select("*", F.explode(letters).alias(c))
    return g.select(F.concat("a", "b", "c").alias("word"))


@query("J14_zip_by_row_id", "SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j14(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "n_chars").join(read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("J15_matrix_product", sql("cells", "SELECT c.col_id AS tf, CAST(sum(o.ones) AS BIGINT) AS y FROM cells c JOIN (SELECT row_id, sum(x) AS ones FROM cells GROUP BY row_id) o USING (row_id) WHERE c.x = 1 GROUP BY c.col_id"))
def j15(spark, sf):
    hit = S.ones(spark, sf)
    x = hit.groupBy("row_id").agg(F.count("*").alias("ones"))
    return hit.join(x, "row_id").groupBy(F.col("col_id").alias("tf")).agg(F.sum("ones").alias("y"))


@query("J16_pending_items", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j16(spark, sf):
    files = read_table(spark, sf, "labels").select(F.concat(F.lit("run_"), "doc_id", F.lit(".fastq.gz")).alias("name"))
    done = finished_names(files, r"^run_(\d+)\.fastq\.gz$").select(F.col("item").cast("long").alias("doc_id"))
    return pending(read_table(spark, sf, "documents").select("doc_id"), done, "doc_id")


@query("J17_same_order", "SELECT count(*) AS n, count(*) FILTER (WHERE quality <> toxic) AS differ FROM labels")
def j17(spark, sf):
    both = read_table(spark, sf, "labels")
    return same_order(both.select(F.col("doc_id").alias("i"), F.col("quality").alias("v")), both.select(F.col("doc_id").alias("i"), F.col("toxic").alias("v")))
