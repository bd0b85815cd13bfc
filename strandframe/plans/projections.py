"""P: projections, filters, predicates and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions.scalar import binarise, bit_filter, percent_round
from strandframe.operators.intervals import summit_window, tagalign, tss_window
from strandframe.operators.matrix import align_columns, complement_rows, default_assign, drop_zero_rows, row_sums, slice_rows, to_wide
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table


@query("P1_binarise", sql("counts", "SELECT row_id, col_id, CAST(n > 1 AS INTEGER) AS x FROM counts"))
def p1(spark, sf):
    return S.counts(spark, sf).select("row_id", "col_id", binarise("n", 1).alias("x"))


_WIDE = ", ".join(f"max(CASE WHEN col_id = {c} THEN x END) AS c{c}" for c in reversed(range(S.N_COLS)))


@query("P2_align_columns", sql("cells", f"SELECT row_id, {_WIDE} FROM cells GROUP BY row_id"))
def p2(spark, sf):
    wide = to_wide(S.cells(spark, sf), list(range(S.N_COLS)), prefix="c")
    return align_columns(wide, [f"c{c}" for c in reversed(range(S.N_COLS))], ["row_id"])


@query("P3_rename", "SELECT n_nationkey AS id, regexp_replace(n_name || '.bed', '\\.bed$', '') AS sample, CASE n_regionkey WHEN 0 THEN 'afr' WHEN 1 THEN 'ame' ELSE 'other' END AS grp FROM nation")
def p3(spark, sf):
    n = read_table(spark, sf, "nation")
    names = F.create_map(*(F.lit(x) for x in (0, "afr", 1, "ame")))
    return n.select(F.col("n_nationkey").alias("id"), F.regexp_replace(F.concat("n_name", F.lit(".bed")), r"\.bed$", "").alias("sample"), F.coalesce(F.try_element_at(names, F.col("n_regionkey")), F.lit("other")).alias("grp"))


@query("P4_positional_slice", "SELECT l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def p4(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(li.columns[2:6])


@query("P5_membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def p5(spark, sf):
    return read_table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("P6_row_sum_filters", sql("cells", "SELECT row_id, ones, ones > 0 AS any_on, ones <= 2 AS at_most_two, ones > 2 AS over_two, ones >= 23 AS nearly_all FROM (SELECT row_id, CAST(sum(x) AS BIGINT) AS ones FROM cells GROUP BY row_id) WHERE ones > 0"))
def p6(spark, sf):
    o = row_sums(S.cells(spark, sf)).where("ones > 0")
    return o.select("row_id", "ones", (F.col("ones") > 0).alias("any_on"), (F.col("ones") <= 2).alias("at_most_two"), (F.col("ones") > 2).alias("over_two"), (F.col("ones") >= S.N_COLS - 2).alias("nearly_all"))


@query("P7_distance_ranges", "SELECT event_id, d < 500 AS promoter, d > 3000 AS enhancer, d > 3000 AND d < 100000 AS enhancer_capped, d <= 500 AS promoter_closed, d >= 3000 AS enhancer_closed FROM (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS d FROM events)")
def p7(spark, sf):
    d = read_table(spark, sf, "events").select("event_id", F.floor(F.abs("value") * 100).alias("d"))
    return d.select("event_id", (F.col("d") < 500).alias("promoter"), (F.col("d") > 3000).alias("enhancer"), ((F.col("d") > 3000) & (F.col("d") < 100000)).alias("enhancer_capped"), (F.col("d") <= 500).alias("promoter_closed"), (F.col("d") >= 3000).alias("enhancer_closed"))


@query("P8_flag_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CAST(l_partkey % 4096 AS BIGINT) & 1804) = 0 AND (CAST(l_partkey % 4096 AS BIGINT) & 2) = 2 AND l_quantity >= 30")
def p8(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.where(bit_filter(F.col("l_partkey") % 4096, require=2, exclude=1804) & (F.col("l_quantity") >= 30)).select("l_orderkey", "l_linenumber")


@query(
    "P9_tagalign",
    sql("peaks", "SELECT ord, chr, strand, CASE WHEN strand = '+' THEN s + 4 ELSE s END AS start, CASE WHEN strand = '-' THEN e - 5 ELSE e END AS stop FROM (SELECT ord, chr, '+' AS strand, start AS s, start + 50 AS e FROM peaks UNION ALL SELECT ord, chr, '-', stop - 50, stop FROM peaks)"),
)
def p9(spark, sf):
    p = S.peaks(spark, sf).select("ord", F.col("chr").alias("chr1"), F.col("start").alias("start1"), (F.col("start") + 50).alias("stop1"), F.lit("+").alias("strand1"), F.col("chr").alias("chr2"), (F.col("stop") - 50).alias("start2"), F.col("stop").alias("stop2"), F.lit("-").alias("strand2"))
    return tagalign(p, keep=["ord"])


@query("P10_summit_window", sql("peaks", "SELECT ord, chr, start + ord % 500 - 250 AS start, start + ord % 500 + 250 AS stop FROM peaks"))
def p10(spark, sf):
    return summit_window(S.peaks(spark, sf).withColumn("peak", F.col("ord") % 500), 250).select("ord", "chr", "start", "stop")


@query("P11_tss_window", "SELECT s_suppkey, s_nationkey AS chr, CAST(s_suppkey * 1000 - 300 AS BIGINT) AS start, CAST(s_suppkey * 1000 + 300 AS BIGINT) AS stop FROM supplier")
def p11(spark, sf):
    s = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("chr"), (F.col("s_suppkey") * 1000).alias("tss"))
    return tss_window(s, 300, keep=["s_suppkey"])


@query("P12_point_interval", sql("peaks", "SELECT ord, chr, start + 250 AS start, start + 251 AS stop FROM peaks"))
def p12(spark, sf):
    return S.peaks(spark, sf).select("ord", "chr", (F.col("start") + 250).alias("start"), (F.col("start") + 251).alias("stop"))


@query("P13_slice_cluster", sql("bits", "SELECT row_id, col_id, x FROM bits WHERE cluster = 3"))
def p13(spark, sf):
    b = S.bits(spark, sf)
    clusters = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster"))
    return slice_rows(b.drop("cluster"), clusters, 3).select("row_id", "col_id", "x")


@query("P14_complement", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p14(spark, sf):
    return complement_rows(read_table(spark, sf, "documents").select("doc_id", "n_chars"), read_table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("P15_default_assign", "SELECT d.doc_id, coalesce(l.quality, -1) AS cluster FROM documents d LEFT JOIN labels l USING (doc_id)")
def p15(spark, sf):
    return default_assign(read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cluster")), "doc_id", "cluster", -1)


@query("P16_significance_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice / 10000 - 3) > 2 AND l_discount < 0.03 AND l_tax < 0.05")
def p16(spark, sf):
    return read_table(spark, sf, "lineitem").where((F.abs(F.col("l_extendedprice") / 10000 - 3) > 2) & (F.col("l_discount") < 0.03) & (F.col("l_tax") < 0.05)).select("l_orderkey", "l_linenumber")


@query("P17_percent_round", "SELECT l_orderkey, l_linenumber, round_even((l_quantity + l_linenumber) / 8, 2) AS pct FROM lineitem")
def p17(spark, sf):
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", percent_round((F.col("l_quantity") + F.col("l_linenumber")) / 8).alias("pct"))


@query("P18_parameter_grid", "SELECT a.idr_fdr, b.edge_fdr FROM (VALUES (0.01), (0.05), (0.1), (0.15)) a(idr_fdr), (VALUES (0.0001), (0.001), (0.01)) b(edge_fdr)".replace("a.idr_fdr", "CAST(a.idr_fdr AS DOUBLE) AS idr_fdr").replace("b.edge_fdr", "CAST(b.edge_fdr AS DOUBLE) AS edge_fdr"))
def p18(spark, sf):
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in (0.01, 0.05, 0.1, 0.15)))).alias("idr_fdr"))
    return grid.select("idr_fdr", F.explode(F.array(*(F.lit(x) for x in (0.0001, 0.001, 0.01)))).alias("edge_fdr")).orderBy("idr_fdr", "edge_fdr")


@query("P19_chromosome_whitelist", sql("peaks", "SELECT ord, chr FROM peaks WHERE chr IN ('click', 'error', 'signup')"))
def p19(spark, sf):
    return S.peaks(spark, sf).where(F.col("chr").isin("click", "error", "signup")).select("ord", "chr")


@query("P20_significant_names", "SELECT upper(p_name) AS tf FROM part WHERE p_size > 25 UNION ALL SELECT 'EXTRA'")
def p20(spark, sf):
    return read_table(spark, sf, "part").where(F.col("p_size") > 25).select(F.upper("p_name").alias("tf")).union(spark.range(1).select(F.lit("EXTRA")))


@query("P21_label_decode", "SELECT vec_id, label + 1 AS cluster, ['red', 'green', 'blue', 'gold', 'grey', 'pink', 'teal', 'navy', 'lime', 'rust'][label + 1] AS colour FROM embeddings")
def p21(spark, sf):
    colours = F.array(*(F.lit(c) for c in ("red", "green", "blue", "gold", "grey", "pink", "teal", "navy", "lime", "rust")))
    return read_table(spark, sf, "embeddings").select("vec_id", (F.col("label") + 1).alias("cluster"), F.element_at(colours, F.col("label") + 1).alias("colour"))


@query("P22_regex_filter", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, 'STEEL|^PROMO')")
def p22(spark, sf):
    return read_table(spark, sf, "part").where(F.col("p_type").rlike("STEEL|^PROMO")).select("p_partkey", "p_type")


@query("P23_closed_ranges", "SELECT doc_id, n_chars, coalesce(quality, -1) AS cluster FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars BETWEEN 500 AND 5000 AND coalesce(quality, -1) >= 0 AND coalesce(quality, -1) <= 1")
def p23(spark, sf):
    both = default_assign(read_table(spark, sf, "documents").select("doc_id", "n_chars"), read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cluster")), "doc_id", "cluster", -1)
    return both.where(F.col("n_chars").between(500, 5000) & (F.col("cluster") >= 0) & (F.col("cluster") <= 1))


@query("P24_restrict_to_clusters", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p24(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "n_chars").join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("P25_drop_zero_rows", sql("cells", "SELECT row_id, CAST(sum(x) AS BIGINT) AS ones FROM cells GROUP BY row_id HAVING sum(x) > 0"))
def p25(spark, sf):
    return drop_zero_rows(S.cells(spark, sf))
