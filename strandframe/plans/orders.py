"""T, U, W: sorts and top-k, set operations, windows and sequential selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.operators import control
from strandframe.operators import intervals as iv
from strandframe.operators import matrix as mx
from strandframe.operators import stats as st
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table


@query("T1_bed_sort", sql("peaks", "SELECT ord, chr, start, q FROM peaks"))
def t1(spark, sf):
    return S.peaks(spark, sf).select("ord", "chr", "start", "q").orderBy("chr", "start", F.desc("q"), "ord")


@query("T2_rank_names", "SELECT event_id, 'Peak_' || row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS name FROM events")
def t2(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "event_type", (-F.col("value")).alias("down"))
    return st.ranks(e, ["event_type"], "down", ["event_id"]).select("event_id", F.concat(F.lit("Peak_"), "rank").alias("name"))


@query("T3_top_clusters", "SELECT p_type, n, round(n / CAST((SELECT count(*) FROM part) AS DOUBLE), 6) AS share FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20)")
def t3(spark, sf):
    p = read_table(spark, sf, "part")
    top = p.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(20)
    return top.crossJoin(p.agg(F.count("*").alias("total"))).select("p_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("T4_n_largest", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def t4(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    li = read_table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return li.withColumn("k", F.row_number().over(w)).where("k <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("T5_best_fit", "SELECT o_custkey % 11 + 2 AS k, min(o_totalprice) AS residual, arg_min(o_orderkey, o_totalprice) AS start_id FROM orders GROUP BY 1")
def t5(spark, sf):
    o = read_table(spark, sf, "orders").select((F.col("o_custkey") % 11 + 2).alias("k"), "o_totalprice", "o_orderkey")
    return o.groupBy("k").agg(F.min("o_totalprice").alias("residual"), F.min_by("o_orderkey", "o_totalprice").alias("start_id"))


@query("T6_ranked_pick", "SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) WHERE k = 1 ORDER BY s_acctbal, s_suppkey LIMIT 10")
def t6(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    first = read_table(spark, sf, "supplier").withColumn("k", F.row_number().over(w)).where("k = 1")
    return first.orderBy("s_acctbal", "s_suppkey").limit(10).select("s_suppkey", "s_nationkey")


@query("T7_multi_key_sort", "SELECT n_nationkey, n_regionkey, n_name FROM nation")
def t7(spark, sf):
    return read_table(spark, sf, "nation").orderBy("n_regionkey", "n_name").select("n_nationkey", "n_regionkey", "n_name")


@query("T8_sort_by_p", "SELECT p_partkey, p_retailprice FROM part WHERE p_size < 20")
def t8(spark, sf):
    return read_table(spark, sf, "part").where("p_size < 20").select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey")


@query("U1_union_all", "SELECT c_custkey AS id, c_nationkey AS nation, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 's' FROM supplier")
def u1(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"))
    return c.unionByName(s)


@query("U2_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u2(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(read_table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("U3_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u3(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id").intersect(read_table(spark, sf, "labels").select("doc_id"))


@query("U4_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id").subtract(read_table(spark, sf, "labels").select("doc_id"))


@query("U5_blacklist_union", sql("peaks", "SELECT chr, start, stop FROM peaks WHERE chr = 'error' UNION ALL SELECT chr, start, stop FROM peaks WHERE q > 50"))
def u5(spark, sf):
    p = S.peaks(spark, sf)
    return iv.blacklist_union(p.where("chr = 'error'"), p.where("q > 50"))


def greedy_sql(rule: str) -> str:
    """Follow 'next' pointers: what an anchor keeps and where the rule goes on."""
    pick = "a.rn" if rule == "first" else "arg_max(g.rn, struct_pack(q := g.q, r := -g.rn))"
    limit = "max(b.stop)" if rule == "pick" else "max(b.stop_anchor)"
    return sql(
        "peaks",
        f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY start, stop, ord) AS rn FROM peaks),
        p AS (SELECT a.chr, a.rn, a.stop AS stop_anchor, {pick} AS pick FROM s a JOIN s g ON g.chr = a.chr AND g.rn >= a.rn AND g.start <= a.stop GROUP BY a.chr, a.rn, a.stop),
        b AS (SELECT p.*, s.stop FROM p JOIN s ON s.chr = p.chr AND s.rn = p.pick),
        c AS (SELECT b.chr, b.rn, b.pick, {limit.replace("max(", "(")} AS lim FROM b),
        n AS (SELECT c.chr, c.rn, c.pick, min(s.rn) AS nxt FROM c LEFT JOIN s ON s.chr = c.chr AND s.start > c.lim AND s.rn > c.{'pick' if rule == 'pick' else 'rn'} GROUP BY c.chr, c.rn, c.pick),
        w AS (SELECT chr, rn, pick, nxt FROM n WHERE rn = 1 UNION ALL SELECT n.chr, n.rn, n.pick, n.nxt FROM w JOIN n ON n.chr = w.chr AND n.rn = w.nxt)
        SELECT s.ord, s.chr, s.start, s.stop, s.q FROM w JOIN s ON s.chr = w.chr AND s.rn = w.pick""",
    )


def _greedy(spark, sf, rule: str):
    return iv.greedy(S.peaks(spark, sf).select("ord", "chr", "start", "stop", "q"), rule, ["ord"])


@query("W1_greedy_pick", greedy_sql("pick"))
def w1(spark, sf):
    return _greedy(spark, sf, "pick")


@query("W2_greedy_group", greedy_sql("group"))
def w2(spark, sf):
    return _greedy(spark, sf, "group")


@query("W3_greedy_first", greedy_sql("first"))
def w3(spark, sf):
    return _greedy(spark, sf, "first")


@query("W4_cumulative_histogram", sql("bits", "WITH r AS (SELECT row_id, sum(x) AS ones, list(x ORDER BY col_id) AS v FROM bits GROUP BY row_id), d AS (SELECT a.row_id AS r1, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS d FROM r a JOIN r b ON a.row_id <> b.row_id AND b.ones = a.ones), h AS (SELECT r1, d, count(*) AS n FROM d GROUP BY r1, d) SELECT r1, d, CAST(sum(n) OVER (PARTITION BY r1 ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM h"))
def w4(spark, sf):
    h = st.distance_histogram(mx.pack(S.bits(spark, sf), 64), 64, (0,))
    w = Window.partitionBy("r1").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("r1", F.col("d").cast("long").alias("d"), F.sum("n").over(w).alias("cum"))


@query("W5_cluster_bounds", "SELECT cluster, size, upto, size > 45 AS labelled FROM (SELECT label AS cluster, count(*) AS size, CAST(sum(count(*)) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, max(label) OVER () AS last FROM embeddings GROUP BY label) WHERE cluster < last")
def w5(spark, sf):
    n = read_table(spark, sf, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    # One row for each cluster.
    w = Window.orderBy("cluster")
    n = n.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.lead("cluster").over(w))
    return n.where("after is not null").select("cluster", "size", "upto", (F.col("size") > 45).alias("labelled"))


@query("W6_running_share", sql("bits", "WITH m AS (SELECT cluster, col_id, avg(x) AS m FROM bits GROUP BY 1, 2), v AS (SELECT cluster, var_pop(m) AS v FROM m GROUP BY cluster) SELECT cluster, round(100 * v / sum(v) OVER (ORDER BY cluster ROWS UNBOUNDED PRECEDING), 6) AS share FROM v"))
def w6(spark, sf):
    v = mx.column_means(S.bits(spark, sf)).groupBy("cluster").agg(F.var_pop("freq").alias("v"))
    w = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0)
    return v.select("cluster", F.round(100 * F.col("v") / F.sum("v").over(w), 6).alias("share"))


_EXPR = "SELECT l_suppkey AS row_id, CAST(year(l_shipdate) AS INTEGER) AS col_id, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2"


@query("W7_quantile_normalise", f"WITH e AS ({_EXPR}), g AS (SELECT r.row_id, c.col_id, log2(1 + round(coalesce(e.v, 0), 2)) AS v FROM (SELECT DISTINCT row_id FROM e) r CROSS JOIN (SELECT DISTINCT col_id FROM e) c LEFT JOIN e ON e.row_id = r.row_id AND e.col_id = c.col_id), k AS (SELECT *, row_number() OVER (PARTITION BY col_id ORDER BY v, row_id) AS r FROM g), m AS (SELECT r, avg(v) AS m FROM k GROUP BY r) SELECT row_id, col_id, round(avg(m) OVER (PARTITION BY col_id, v), 6) AS q FROM k JOIN m USING (r)")
def w7(spark, sf):
    e = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("row_id"), F.year("l_shipdate").alias("col_id")).agg(F.sum("l_extendedprice").alias("v"))
    years = [r.col_id for r in e.select("col_id").distinct().orderBy("col_id").collect()]
    every = e.select("row_id").distinct().withColumn("col_id", F.explode(F.array(*map(F.lit, years))))
    full = every.join(e, ["row_id", "col_id"], "left").withColumn("v", F.round(F.coalesce("v", F.lit(0.0)), 2))
    return st.quantile_normalise(full).withColumn("q", F.round("q", 6))


@query("W8_pseudo_replicates", sql("peaks", "SELECT ord, chr, CASE WHEN r <= round_even(n / 2, 0) THEN 1 ELSE 2 END AS replicate FROM (SELECT ord, chr, row_number() OVER (PARTITION BY chr ORDER BY substr(md5(ord || '_17'), 1, 15), ord) AS r, count(*) OVER (PARTITION BY chr) AS n FROM peaks)"))
def w8(spark, sf):
    """Each chr's reads in an order of hashes, split in two halves."""
    p = S.peaks(spark, sf)
    dealt = st.ranks(p.select("ord", "chr", st.hashed("ord", 17).alias("h")), ["chr"], "h", ["ord"])
    half = p.groupBy("chr").agg(F.bround(F.count("*") / 2).alias("half"))
    return dealt.join(half, "chr").select("ord", "chr", F.when(F.col("rank") <= F.col("half"), 1).otherwise(2).alias("replicate"))


@query("W9_rank_naming", "SELECT o_orderkey, o_orderpriority || '_' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS name FROM orders")
def w9(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (-F.col("o_totalprice")).alias("down"))
    return st.ranks(o, ["o_orderpriority"], "down", ["o_orderkey"]).select("o_orderkey", F.concat_ws("_", "o_orderpriority", "rank").alias("name"))


@query("W10_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 5 AS batch FROM documents")
def w10(spark, sf):
    return control.batches(read_table(spark, sf, "documents").select("doc_id"), 5, "doc_id")
