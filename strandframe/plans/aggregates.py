"""A: aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.operators import matrix as mx
from strandframe.operators import stats as st
from strandframe.operators.control import require
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table

#: Column clusters of the 64 embedding columns: k = col_id div 8.
EIGHTHS = "SELECT CAST(unnest(range(64)) AS INTEGER) AS col_id"


def eighths(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("col_id"), F.expr("cast(id div 8 as int)").alias("k"))


@query("A1_row_sums", sql("cells", "SELECT row_id, CAST(sum(x) AS BIGINT) AS ones FROM cells GROUP BY row_id"))
def a1(spark, sf):
    return mx.row_sums(S.cells(spark, sf))


@query("A2_column_means", sql("bits", "SELECT cluster, col_id, round(avg(x), 6) AS freq FROM bits GROUP BY cluster, col_id"))
def a2(spark, sf):
    return mx.column_means(S.bits(spark, sf)).withColumn("freq", F.round("freq", 6))


@query("A3_block_means", sql("bits", "SELECT cluster, col_id // 8 AS k, count(*) AS n, round(avg(x), 6) AS mean FROM bits GROUP BY 1, 2"))
def a3(spark, sf):
    return mx.block_means(mx.column_stats(S.bits(spark, sf)), eighths(spark)).withColumn("mean", F.round("mean", 6))


@query("A4_cluster_info", "SELECT quality AS cluster, count(*) AS size, round(avg(CAST(n_chars < 500 AS INTEGER)), 6) AS promoter, round(avg(CAST(n_chars > 3000 AS INTEGER)), 6) AS enhancer, round(avg(n_chars / 1000.0), 6) AS fraction_on FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def a4(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars").join(read_table(spark, sf, "labels"), "doc_id")
    return d.groupBy(F.col("quality").alias("cluster")).agg(F.count("*").alias("size"), F.round(F.avg((F.col("n_chars") < 500).cast("int")), 6).alias("promoter"), F.round(F.avg((F.col("n_chars") > 3000).cast("int")), 6).alias("enhancer"), F.round(F.avg(F.col("n_chars") / 1000), 6).alias("fraction_on"))


@query("A5_count_having", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 40")
def a5(spark, sf):
    return read_table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).where("n > 40")


@query("A6_specific_fraction", sql("cells", "SELECT cut, round(sum(CASE WHEN ones > 0 AND ones <= cut THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN ones > 0 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS fraction, round(100 * sum(CASE WHEN ones > 0 AND ones <= cut THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN ones > 0 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS percent FROM (SELECT row_id, sum(x) AS ones FROM cells GROUP BY row_id), (VALUES (2), (4), (6)) c(cut) GROUP BY cut"))
def a6(spark, sf):
    o = mx.row_sums(S.cells(spark, sf)).where("ones > 0").withColumn("cut", F.explode(F.array(*map(F.lit, (2, 4, 6)))))
    f = F.avg((F.col("ones") <= F.col("cut")).cast("int"))
    return o.groupBy("cut").agg(F.round(f, 6).alias("fraction"), F.round(100 * f, 6).alias("percent"))


@query("A7_cluster_summary", "SELECT count(*) AS total, CAST(sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS clustered, round(avg(CASE WHEN label >= 1 THEN 1.0 ELSE 0 END), 6) AS clustered_share, CAST(sum(CASE WHEN label BETWEEN 0 AND 4 THEN 1 ELSE 0 END) AS BIGINT) AS top, round(avg(CASE WHEN label BETWEEN 0 AND 4 THEN 1.0 ELSE 0 END), 6) AS top_share FROM embeddings")
def a7(spark, sf):
    c = F.col("label")
    share = lambda p: F.round(F.avg(p.cast("int")), 6)
    return read_table(spark, sf, "embeddings").agg(F.count("*").alias("total"), F.count_if(c >= 1).alias("clustered"), share(c >= 1).alias("clustered_share"), F.count_if(c.between(0, 4)).alias("top"), share(c.between(0, 4)).alias("top_share"))


@query("A8_percent_clustered", sql("cells", "SELECT round(100.0 * (SELECT count(*) FROM labels) / (SELECT count(*) FROM (SELECT row_id FROM cells GROUP BY row_id HAVING sum(x) > 2)), 6) AS percent"))
def a8(spark, sf):
    part = read_table(spark, sf, "labels").agg(F.count("*").alias("a"))
    rows = mx.row_sums(S.cells(spark, sf)).where("ones > 2").agg(F.count("*").alias("b"))
    return part.crossJoin(rows).select(F.round(100 * F.col("a") / F.col("b"), 6).alias("percent"))


@query("A9_distinct_genes", "SELECT c_mktsegment, count(DISTINCT o_custkey) AS genes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def a9(spark, sf):
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count_distinct("o_custkey").alias("genes"))


@query("A10_two_key_counts", "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def a10(spark, sf):
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A11_value_counts", "SELECT event_type, user_id % 5 AS grp, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS share FROM events GROUP BY 1, 2")
def a11(spark, sf):
    n = read_table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("grp")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


@query("A12_replicate_means", "SELECT l_suppkey AS gene, l_returnflag AS cell_type, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2")
def a12(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("cell_type")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("A13_row_max", "SELECT l_orderkey, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) >= 40")
def a13(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("most")).where("most >= 40")


@query("A14_group_max_or_null", "SELECT c_custkey, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a14(spark, sf):
    best = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return read_table(spark, sf, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query("A15_population_variance", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
def a15(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.var_pop("l_quantity"), 6).alias("v"))


@query("A16_sample_deviation", "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS s FROM lineitem GROUP BY l_linestatus")
def a16(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("s"))


_PAIR = "WITH r AS (SELECT row_id, sum(x) AS ones, list(x ORDER BY col_id) AS v FROM bits GROUP BY row_id), d AS (SELECT a.row_id AS r1, b.ones AS n2, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS d FROM r a JOIN r b ON a.row_id <> b.row_id AND b.ones = a.ones)"


@query("A17_distance_histogram", sql("bits", _PAIR + " SELECT r1, d, count(*) AS n FROM d GROUP BY r1, d"))
def a17(spark, sf):
    d = st.distance_histogram(mx.pack(S.bits(spark, sf), 64), 64, (0,))
    return d.select("r1", F.col("d").cast("long").alias("d"), "n")


@query("A18_quantiles", "SELECT l_suppkey, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.75), 6) AS q75 FROM lineitem GROUP BY l_suppkey")
def a18(spark, sf):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.75)))
    return read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(q.alias("q")).select("l_suppkey", F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("q75"))


@query("A19_median_of_means", sql("bits", "SELECT cluster, col_id // 8 AS k, round(quantile_cont(m, 0.5), 6) AS median FROM (SELECT cluster, col_id, CAST(avg(x) AS DOUBLE) AS m FROM bits GROUP BY 1, 2) GROUP BY 1, 2"))
def a19(spark, sf):
    m = mx.column_means(S.bits(spark, sf)).join(eighths(spark), "col_id")
    return m.groupBy("cluster", "k").agg(F.round(F.percentile("freq", F.lit(0.5)), 6).alias("median"))


@query("A20_arg_max", sql("peaks", "SELECT chr, sample, ord FROM (SELECT *, row_number() OVER (PARTITION BY chr, sample ORDER BY q DESC, start, ord) AS k FROM peaks) WHERE k = 1"))
def a20(spark, sf):
    best = F.max(F.struct("q", (-F.col("start")).alias("s"), (-F.col("ord")).alias("o"))).alias("b")
    return S.peaks(spark, sf).groupBy("chr", "sample").agg(best).select("chr", "sample", (-F.col("b.o")).alias("ord"))


@query("A21_best_pair", "SELECT a.l_orderkey, arg_max(struct_pack(i := CAST(a.l_linenumber AS BIGINT), j := CAST(b.l_linenumber AS BIGINT)), struct_pack(n := CAST(a.l_quantity + b.l_quantity AS BIGINT), i := -a.l_linenumber, j := -b.l_linenumber)).i AS i, arg_max(struct_pack(i := CAST(a.l_linenumber AS BIGINT), j := CAST(b.l_linenumber AS BIGINT)), struct_pack(n := CAST(a.l_quantity + b.l_quantity AS BIGINT), i := -a.l_linenumber, j := -b.l_linenumber)).j AS j, CAST(max(a.l_quantity + b.l_quantity) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey")
def a21(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("i"), F.col("l_quantity").alias("qa"))
    b = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("qb"))
    n = (F.col("qa") + F.col("qb")).cast("long")
    best = F.max(F.struct(n.alias("n"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("b")
    return a.join(b, "l_orderkey").where("i < j").groupBy("l_orderkey").agg(best).select("l_orderkey", (-F.col("b.i")).alias("i"), (-F.col("b.j")).alias("j"), F.col("b.n").alias("n"))


@query("A22_all_zero_files", "SELECT CAST(l_suppkey AS BIGINT) AS file, sum(CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END) = 0 AS bad FROM lineitem GROUP BY l_suppkey")
def a22(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg((F.count_if(F.col("l_discount") >= 0.1) == 0).alias("bad"))


@query("A23_majority_vote", sql("bits", "SELECT row_id, col_id // 8 AS k, CAST(avg(x) > 0.5 AS INTEGER) AS vote FROM bits GROUP BY 1, 2"))
def a23(spark, sf):
    return mx.majority(S.bits(spark, sf).join(eighths(spark), "col_id"), ["row_id", "k"], "x")


@query("A24_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def a24(spark, sf):
    return read_table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("A25_drop_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def a25(spark, sf):
    return read_table(spark, sf, "orders").dropDuplicates(["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderstatus")


@query("A26_box_table", sql("bits", "SELECT cluster, col_id // 8 AS k, round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.5), 6) AS q50, round(quantile_cont(m, 0.75), 6) AS q75 FROM (SELECT cluster, col_id, CAST(avg(x) AS DOUBLE) AS m FROM bits WHERE cluster < 6 GROUP BY 1, 2) GROUP BY 1, 2"))
def a26(spark, sf):
    m = mx.column_means(S.bits(spark, sf).where("cluster < 6")).join(eighths(spark), "col_id")
    q = F.percentile("freq", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return m.groupBy("cluster", "k").agg(q.alias("q")).select("cluster", "k", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))))


@query("A27_distinct_guards", "SELECT count(DISTINCT n_regionkey) AS k, count(DISTINCT n_name) AS names FROM nation")
def a27(spark, sf):
    g = read_table(spark, sf, "nation").agg(F.count_distinct("n_regionkey").alias("k"), F.count_distinct("n_name").alias("names"), F.count("*").alias("n"))
    return require(g, (F.col("k") == 5) & (F.col("names") == F.col("n")), "clusters or names are not what they should be").drop("n")
