"""M: statistics of binary matrices, enrichment and biclusters."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions.scalar import minus_log10
from strandframe.operators import cluster as cl
from strandframe.operators import graph as gr
from strandframe.operators import intervals as iv
from strandframe.operators import matrix as mx
from strandframe.operators import stats as st
from strandframe.plans import standins as S
from strandframe.plans.aggregates import eighths
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table, shared_dir
from strandframe.sources import readers

#: Effort of searches, as the reference's defaults: K, starts of either kind for each K, submatrix restarts.
KS, STARTS, RESTARTS = list(range(2, 13)), 10, 1000

_PMF = "exp(lgamma(n1 + 1) - lgamma(k + 1) - lgamma(n1 - k + 1) + lgamma({m} - n1 + 1) - lgamma(n2 - k + 1) - lgamma({m} - n1 - n2 + k + 1) - lgamma({m} + 1) + lgamma(n2 + 1) + lgamma({m} - n2 + 1))"


def _null_sql(m: int) -> str:
    return f"SELECT n2, n1, n1 + n2 - 2 * k AS d, {_PMF.format(m=m)} AS p FROM (SELECT unnest(range({m + 1})) AS n2), (SELECT unnest(range({m + 1})) AS n1), (SELECT unnest(range({m + 1})) AS k) WHERE k <= n1 AND k <= n2 AND n1 + n2 - k <= {m}"


@query("M1_null_distances", f"SELECT CAST(n2 AS INTEGER) AS n2, CAST(n1 AS INTEGER) AS n1, CAST(d AS INTEGER) AS d, round(p, 9) AS p FROM ({_null_sql(25)})")
def m1(spark, sf):
    return st.null_distances(spark, 25).withColumn("p", F.round("p", 9))


def word_bits(spark, sf, top: int = 64):
    """(row_id, col_id, x = 1): which of the commonest words a document holds."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("w"))
    best = d.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(top)
    named = best.select("w", (F.row_number().over(Window.orderBy(F.desc("n"), "w")) - 1).alias("col_id"))
    return d.join(F.broadcast(named), "w").select("row_id", "col_id", F.lit(1).alias("x"))


_WORDS = """t AS (SELECT doc_id AS row_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents),
 b AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS col_id FROM t GROUP BY w QUALIFY col_id < 64),
 h AS (SELECT row_id, col_id FROM t JOIN b USING (w)),
 r AS (SELECT row_id, count(*) AS ones, sum(CASE WHEN col_id < 32 THEN CAST(1 AS BIGINT) << CAST(col_id AS INTEGER) ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN col_id >= 32 THEN CAST(1 AS BIGINT) << CAST(col_id - 32 AS INTEGER) ELSE 0 END)::BIGINT AS hi FROM h GROUP BY row_id)"""


def _edges_sql(fdr: float) -> str:
    return f"""WITH {_WORDS},
 q AS (SELECT * FROM r WHERE ones BETWEEN 3 AND 61),
 p AS (SELECT a.row_id AS r1, c.row_id AS r2, a.ones AS n1, c.ones AS n2, bit_count(xor(a.lo, c.lo)) + bit_count(xor(a.hi, c.hi)) AS d FROM q a JOIN q c ON a.row_id <> c.row_id AND c.ones - a.ones IN (0, 1) WHERE a.ones <= 60),
 z AS (SELECT ones AS n2, count(*) AS size FROM q GROUP BY ones),
 nul AS (SELECT n2, n1, d, sum(p) AS p FROM ({_null_sql(64)}) WHERE n2 - n1 IN (0, 1) GROUP BY ALL),
 g AS (SELECT n1, n2, d FROM (SELECT unnest(range(65)) AS n1), (SELECT unnest(range(65)) AS n2), (SELECT unnest(range(65)) AS d) WHERE n2 - n1 IN (0, 1)),
 f AS (SELECT g.n1, g.n2, g.d, sum(coalesce(nul.p, 0)) OVER (PARTITION BY g.n1, g.n2 ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS f0 FROM g LEFT JOIN nul USING (n1, n2, d)),
 s AS (SELECT r1, n1, n2, d, count(*) AS c FROM p GROUP BY ALL),
 k AS (SELECT DISTINCT r1, n1, n2 FROM s),
 e AS (SELECT k.r1, k.n1, k.n2, f.d, f.f0 * z.size AS e0, sum(coalesce(s.c, 0) + CASE WHEN f.d = 64 AND k.n1 = k.n2 THEN 1 ELSE 0 END) OVER (PARTITION BY k.r1, k.n2 ORDER BY f.d ROWS UNBOUNDED PRECEDING) AS seen
   FROM k JOIN f ON f.n1 = k.n1 AND f.n2 = k.n2 JOIN z ON z.n2 = k.n2 LEFT JOIN s ON s.r1 = k.r1 AND s.n2 = k.n2 AND s.d = f.d),
 c AS (SELECT r1, n2, max(d) AS cut FROM e WHERE seen > 0 AND e0 <= seen * {fdr} GROUP BY r1, n2)
 SELECT p.r1 AS e1, p.r2 AS e2 FROM p JOIN c ON c.r1 = p.r1 AND c.n2 = p.n2 WHERE p.d <= c.cut AND (p.n1 <> p.n2 OR p.r1 < p.r2)"""


@query("M2_fdr_edges", _edges_sql(0.001))
def m2(spark, sf):
    return st.fdr_edges(mx.pack(word_bits(spark, sf), 64), 64, 0.001)


@query("M3_assemble_clusters", sql("cells", "WITH o AS (SELECT row_id, sum(x) AS ones FROM cells GROUP BY row_id) SELECT row_id AS row, CAST(0 AS INTEGER) AS cluster FROM o WHERE ones >= 14 UNION ALL SELECT row_id, CAST(row_id % 5 + 1 AS INTEGER) FROM o WHERE ones BETWEEN 3 AND 13"))
def m3(spark, sf):
    o = mx.row_sums(S.cells(spark, sf))
    labels = o.where("ones >= 3").select(F.col("row_id").alias("v"), (F.col("row_id") % 5).alias("cluster"))
    return st.assemble_clusters(o, labels, 14, margin=0)


_MEANS = "m AS (SELECT cluster, col_id, col_id // 8 AS k, CAST(avg(x) AS DOUBLE) AS mean, count(*) AS n, CAST(sum(x) AS DOUBLE) AS s FROM bits GROUP BY cluster, col_id)"
_BLOCKS = _MEANS + ", b AS (SELECT cluster, k, sum(n) AS n, sum(s) AS s, sum(s) / sum(n) AS mean FROM m GROUP BY cluster, k)"


def _stats(spark, sf):
    return mx.column_stats(S.bits(spark, sf))


@query("M4_block_sse", sql("bits", f"WITH {_BLOCKS} SELECT round(sum(s - s * s / n), 6) AS sse FROM b"))
def m4(spark, sf):
    return mx.sse(mx.block_stats(_stats(spark, sf), eighths(spark))).select(F.round("sse", 6).alias("sse"))


_ACROSS = f"""WITH {_MEANS}, k AS (SELECT cluster, k, count(*) AS nk, avg(mean) AS mk FROM m GROUP BY 1, 2), r AS (SELECT cluster, count(*) AS nc, avg(mean) AS mr, var_pop(mean) AS v FROM m GROUP BY 1),
 a AS (SELECT cluster, sum(nk / CAST(nc AS DOUBLE) * (mk - mr) * (mk - mr)) AS across FROM k JOIN r USING (cluster) GROUP BY cluster)"""


@query("M5_variance_shares", sql("bits", _ACROSS + " SELECT cluster, round(v, 9) AS var, round(across, 9) AS across, round(100 * v / sum(v) OVER (ORDER BY cluster ROWS UNBOUNDED PRECEDING), 6) AS running_share FROM r JOIN a USING (cluster)"))
def m5(spark, sf):
    v = st.variance_shares(_stats(spark, sf), eighths(spark))
    return v.select("cluster", F.round("var", 9).alias("var"), F.round("across", 9).alias("across"), F.round("running_share", 6).alias("running_share"))


def _retained_sql(value: str, more: str = "") -> str:
    return sql("bits", f"WITH {_BLOCKS}{more}, t AS (SELECT m.cluster, m.mean, {value} AS value FROM m JOIN {'w' if more else 'b'} x ON x.cluster = m.cluster AND x.k = m.k), l AS (SELECT cluster, avg((mean - value) * (mean - value)) AS lost, var_pop(mean) AS v FROM t GROUP BY cluster) SELECT round(100 * (1 - sum(lost) / sum(v)), 6) AS retained FROM l")


_TWO = """, o AS (SELECT *, row_number() OVER u AS i, sum(mean) OVER f AS s1, sum(mean * mean) OVER f AS q1, count(*) OVER p AS nn, sum(mean) OVER p AS st, sum(mean * mean) OVER p AS qt, max(mean) OVER p > min(mean) OVER p AS spread FROM b WINDOW p AS (PARTITION BY cluster), u AS (PARTITION BY cluster ORDER BY mean, k), f AS (PARTITION BY cluster ORDER BY mean, k ROWS UNBOUNDED PRECEDING)),
 e AS (SELECT *, CASE WHEN i < nn THEN round(q1 - s1 * s1 / i + (qt - q1) - (st - s1) * (st - s1) / (nn - i), 9) END AS err FROM o),
 c AS (SELECT cluster, arg_min(i, struct_pack(err := err, i := i)) AS cut FROM e WHERE err IS NOT NULL GROUP BY cluster),
 y AS (SELECT e.*, CASE WHEN spread THEN CAST(i > cut AS INTEGER) ELSE CAST(st / nn > 0.5 AS INTEGER) END AS on_ FROM e JOIN c USING (cluster)),
 w AS (SELECT cluster, k, mean, avg(CASE WHEN on_ = 0 THEN mean END) OVER (PARTITION BY cluster) AS low, avg(CASE WHEN on_ = 1 THEN mean END) OVER (PARTITION BY cluster) AS high, on_ FROM y)"""
_LEVEL = "CASE WHEN low > 0.8 THEN 1.0 WHEN high < 0.2 THEN 0.0 ELSE CAST(on_ AS DOUBLE) END"


@query("M6_retained_means", _retained_sql("x.mean"))
def m6(spark, sf):
    s = _stats(spark, sf)
    blocks = mx.block_means(s, eighths(spark)).withColumnRenamed("mean", "value")
    return st.retained(s, eighths(spark), blocks).select(F.round("retained", 6).alias("retained"))


@query("M7_retained_two_means", _retained_sql("CASE WHEN on_ = 1 THEN high ELSE low END", _TWO))
def m7(spark, sf):
    s = _stats(spark, sf)
    two = st.two_centres(mx.block_means(s, eighths(spark)))
    return st.retained(s, eighths(spark), two).select(F.round("retained", 6).alias("retained"))


def _binary(two):
    return two.withColumn("value", st.binary_levels(F.col("low"), F.col("high"), F.col("value")))


@query("M8_retained_binary", _retained_sql(_LEVEL, _TWO))
def m8(spark, sf):
    s = _stats(spark, sf)
    return st.retained(s, eighths(spark), _binary(st.two_centres(mx.block_means(s, eighths(spark))))).select(F.round("retained", 6).alias("retained"))


@query(
    "M9_full_decomposition",
    sql("bits", f"WITH {_BLOCKS}, r AS (SELECT cluster, sum(n) AS n, sum(s) AS s, sum(s - s * s / n) AS wr, sum(s * s / n) AS cols FROM m GROUP BY cluster), g AS (SELECT cluster, sum(s * s / n) AS blocks FROM b GROUP BY cluster) SELECT cluster, round(s / n * (1 - s / n), 9) AS var, round(blocks / n - (s / n) * (s / n), 9) AS cc, round((cols - blocks) / n, 9) AS wc, round(wr / n, 9) AS wr, round(1.0::DOUBLE, 6) AS \"check\" FROM r JOIN g USING (cluster)"),
)
def m9(spark, sf):
    d = st.full_decomposition(_stats(spark, sf), eighths(spark))
    return d.select("cluster", *(F.round(c, 9).alias(c) for c in ("var", "cc", "wc", "wr")), F.round("check", 6).alias("check"))


@query("M10_measures", " UNION ALL ".join(f"SELECT '{n}' AS measure, retained FROM ({q})" for n, q in (("means", _retained_sql("x.mean")), ("two_means", _retained_sql("CASE WHEN on_ = 1 THEN high ELSE low END", _TWO)), ("binary", _retained_sql(_LEVEL, _TWO)))))
def m10(spark, sf):
    """The three measures side by side, from the same functions as M6 to M8."""
    named = lambda n, q: q(spark, sf).select(F.lit(n).alias("measure"), "retained")
    return named("means", m6).unionByName(named("two_means", m7)).unionByName(named("binary", m8))


def nation_tree(spark, sf) -> cl.Tree:
    rows = sorted((r.v, -1 if r.parent is None else r.parent) for r in S.tree(spark, sf).collect())
    return cl.Tree([p for _, p in rows])


def nation_table(spark, sf) -> cl.Table:
    c = S.cells(spark, sf).withColumn("cluster", (F.col("row_id") % 3).cast("int"))
    return cl.Table.collect(mx.column_stats(c))


@query("M11_k_sweep")
def m11(spark, sf):
    """(method, k, residual) of tree, hierarchical and k-means clusters for K = 2..12."""
    tree, table = nation_tree(spark, sf), nation_table(spark, sf)
    ks = KS
    starts = cl.random_starts(spark, tree, table, ks, STARTS).unionByName(cl.smart_starts(spark, tree, table, ks, STARTS))
    rows = [("tree", r.k, float(r.residual)) for r in cl.best_fits(cl.fits(starts, tree, table)).collect()]
    gram = cl.gram_matrix(S.cells(spark, sf), S.N_COLS)
    for k in ks:
        h = cl.complete_linkage(gram, k)
        rows.append(("hierarchical", k, table.sse(h)))
        rows.append(("kmeans", k, cl.scalar_kmeans(table, h)[1]))
    return spark.createDataFrame(rows, "method string, k int, residual double")


@query("M12_mean_map", sql("bits", f"WITH {_BLOCKS} SELECT m.cluster, m.col_id, round(b.mean, 6) AS value FROM m JOIN b ON b.cluster = m.cluster AND b.k = m.k"))
def m12(spark, sf):
    blocks = mx.block_means(_stats(spark, sf), eighths(spark))
    return mx.spread_means(S.bits(spark, sf), blocks, eighths(spark), F.round("mean", 6)).select("cluster", "col_id", "value")


@query("M13_binary_map", sql("bits", f"WITH {_BLOCKS}{_TWO} SELECT m.cluster, m.col_id, {_LEVEL} AS value, round(CASE WHEN on_ = 1 THEN high ELSE low END, 6) AS two_mean FROM m JOIN w ON w.cluster = m.cluster AND w.k = m.k"))
def m13(spark, sf):
    two = st.two_centres(mx.block_means(_stats(spark, sf), eighths(spark))).withColumn("two_mean", F.round("value", 6))
    both = F.struct(st.binary_levels(F.col("low"), F.col("high"), F.col("value")).alias("value"), "two_mean")
    out = mx.spread_means(S.bits(spark, sf), two, eighths(spark), both)
    return out.select("cluster", "col_id", "value.value", "value.two_mean")


@query("M14_heatmap_table", sql("bits", "SELECT cluster, col_id, round(avg(x), 6) AS freq FROM bits WHERE cluster IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 45) GROUP BY 1, 2"))
def m14(spark, sf):
    size = read_table(spark, sf, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n")).where("n > 45").select("cluster")
    return mx.column_means(S.bits(spark, sf).join(size, "cluster", "left_semi")).withColumn("freq", F.round("freq", 6))


@query("M15_on_off_split", sql("bits", f"WITH m AS (SELECT cluster, col_id AS k, CAST(avg(x) AS DOUBLE) AS mean FROM bits GROUP BY 1, 2), b AS (SELECT * FROM m){_TWO} SELECT cluster, CAST(k AS INTEGER) AS col_id, on_ AS \"on\" FROM w"))
def m15(spark, sf):
    return mx.on_off_split(mx.column_means(S.bits(spark, sf)), ["cluster"], "freq", ["col_id"]).select("cluster", "col_id", "on")


#: Motifs: which documents hold a word; loci: labelled documents, good ones the response.
MOTIFS = ["the", "and", "with", "from", "que", "der"]


def _hits(spark, sf):
    lab = read_table(spark, sf, "labels")
    d = read_table(spark, sf, "documents").join(lab, "doc_id")
    has = F.array_compact(F.array(*(F.when(F.lower("text").rlike(f"(^|[^a-z]){m}([^a-z]|$)"), F.lit(m)) for m in MOTIFS)))
    hits = d.select(F.col("doc_id").alias("row_id"), F.explode(has).alias("tf"))
    x = d.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("grp"), (F.col("n_chars") % 7).alias("w"))
    return hits, x


_HITS = "x AS (SELECT doc_id AS row_id, quality AS grp, n_chars % 7 AS w, lower(text) AS t FROM documents JOIN labels USING (doc_id)), h AS (SELECT x.row_id, v.tf FROM x JOIN (VALUES ('the'), ('and'), ('with'), ('from'), ('que'), ('der')) v(tf) ON regexp_matches(x.t, '(^|[^a-z])' || v.tf || '([^a-z]|$)'))"
_Z = f"WITH {_HITS}, n AS (SELECT sum(CASE WHEN grp = 1 THEN w ELSE 0 END)::DOUBLE AS rn, sum(CASE WHEN grp = 0 THEN w ELSE 0 END)::DOUBLE AS cn FROM x), y AS (SELECT tf, sum(CASE WHEN grp = 1 THEN w ELSE 0 END)::DOUBLE AS r, sum(CASE WHEN grp = 0 THEN w ELSE 0 END)::DOUBLE AS c FROM h JOIN x USING (row_id) GROUP BY tf), z AS (SELECT tf, r / rn AS r_frac, c / cn AS c_frac, (r + c) / (rn + cn) AS t_frac FROM y, n)"


@query("M16_enrichment_z", _Z + " SELECT tf, round(r_frac, 6) AS r_frac, round(c_frac, 6) AS c_frac, round((r_frac - c_frac) / t_frac, 6) AS z FROM z")
def m16(spark, sf):
    e = st.enrichment(*_hits(spark, sf))
    return e.select("tf", *(F.round(c, 6).alias(c) for c in ("r_frac", "c_frac", "z")))


_NULL = (
    ", p AS (SELECT row_id, w, perm, row_number() OVER (PARTITION BY perm ORDER BY substr(md5(row_id || '_' || perm || '_3'), 1, 15), row_id) AS rk FROM x, (SELECT unnest(range(1, 51)) AS perm))"
    ", dealt AS (SELECT row_id, w, perm, rk <= (SELECT count(*) FILTER (WHERE grp = 1) FROM x) AS resp FROM p)"
    ", t AS (SELECT perm, CAST(sum(w) FILTER (WHERE resp) AS DOUBLE) AS pn, CAST(sum(w) FILTER (WHERE NOT resp) AS DOUBLE) AS qn FROM dealt GROUP BY perm)"
    ", q AS (SELECT perm, tf, CAST(sum(CASE WHEN resp THEN w ELSE 0 END) AS DOUBLE) AS r, CAST(sum(CASE WHEN resp THEN 0 ELSE w END) AS DOUBLE) AS c FROM h JOIN dealt USING (row_id) GROUP BY perm, tf)"
    ", m AS (SELECT tf, max((r / pn - c / qn) / t_frac) AS null_max FROM q JOIN t USING (perm) JOIN z USING (tf) GROUP BY tf)"
)


@query("M17_permutation_null", _Z + _NULL + " SELECT tf, round((r_frac - c_frac) / t_frac, 6) AS z, round(null_max, 6) AS null_max, (r_frac - c_frac) / t_frac > null_max AS sig FROM z JOIN m USING (tf)")
def m17(spark, sf):
    hits, x = _hits(spark, sf)
    both = st.enrichment(hits, x).select("tf", "z").join(st.permutation_max(hits, x, 50, 3), "tf").withColumn("sig", F.col("z") > F.col("null_max"))
    return both.select("tf", F.round("z", 6).alias("z"), F.round("null_max", 6).alias("null_max"), "sig")


_Z_LANG = f"WITH {_HITS.replace('lower(text) AS t', 'lower(text) AS t, lang')}, n AS (SELECT lang, sum(CASE WHEN grp = 1 THEN w ELSE 0 END)::DOUBLE AS rn, sum(CASE WHEN grp = 0 THEN w ELSE 0 END)::DOUBLE AS cn FROM x GROUP BY lang), y AS (SELECT lang, tf, sum(CASE WHEN grp = 1 THEN w ELSE 0 END)::DOUBLE AS r, sum(CASE WHEN grp = 0 THEN w ELSE 0 END)::DOUBLE AS c FROM h JOIN x USING (row_id) GROUP BY ALL)"


@query("M18_z_by_cluster", _Z_LANG + " SELECT lang, tf, round((r / rn - c / cn) / ((r + c) / (rn + cn)), 6) AS z FROM y JOIN n USING (lang) WHERE rn > 0 AND cn > 0 AND r + c > 0")
def m18(spark, sf):
    hits, x = _hits(spark, sf)
    langs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    by = lambda g, c: F.sum(F.when(F.col("grp") == g, F.col(c)).otherwise(0)).cast("double")
    n = x.join(langs, "row_id").groupBy("lang").agg(by(1, "w").alias("rn"), by(0, "w").alias("cn"))
    y = hits.join(x, "row_id").join(langs, "row_id").groupBy("lang", "tf").agg(by(1, "w").alias("r"), by(0, "w").alias("c"))
    z = (F.col("r") / F.col("rn") - F.col("c") / F.col("cn")) / ((F.col("r") + F.col("c")) / (F.col("rn") + F.col("cn")))
    return y.join(n, "lang").where("rn > 0 and cn > 0 and r + c > 0").select("lang", "tf", F.round(z, 6).alias("z"))


@query("M19_scores_wide", "WITH e AS (SELECT user_id % 6 AS cluster, event_type AS tf, round(avg(value), 6) AS across FROM events GROUP BY 1, 2) SELECT cluster, " + ", ".join(f"coalesce(max(CASE WHEN tf = '{t}' AND across > 0.25 THEN across END), 0) AS {t}" for t in ("click", "error", "signup")) + " FROM e GROUP BY cluster")
def m19(spark, sf):
    e = read_table(spark, sf, "events").groupBy((F.col("user_id") % 6).alias("cluster"), F.col("event_type").alias("tf")).agg(F.round(F.avg("value"), 6).alias("across"))
    e = e.withColumn("across", F.when(F.col("across") > 0.25, F.col("across")))
    return e.groupBy("cluster").pivot("tf", ["click", "error", "signup"]).agg(F.first("across")).na.fill(0.0)


@query("M20_pivot_changes", "SELECT l_suppkey AS gene, " + ", ".join(f"round(max(CASE WHEN l_returnflag = '{f}' THEN l_discount END), 6) AS {f}" for f in "ANR") + " FROM lineitem WHERE abs(l_tax - 0.04) > 0.02 GROUP BY l_suppkey")
def m20(spark, sf):
    li = read_table(spark, sf, "lineitem").where(F.abs(F.col("l_tax") - 0.04) > 0.02)
    return li.groupBy(F.col("l_suppkey").alias("gene")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.max("l_discount"), 6))


@query("M21_separation", "SELECT l_suppkey AS gene, round(quantile_cont(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DOUBLE) END, 0.25) - quantile_cont(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DOUBLE) END, 0.75), 6) AS sep FROM lineitem GROUP BY l_suppkey")
def m21(spark, sf):
    v = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gene"), (F.col("l_linestatus") == "O").cast("int").alias("grp"), F.col("l_extendedprice").alias("v"))
    return st.separation(v).withColumn("sep", F.round("sep", 6))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("M22_binomial_enrichment", "WITH p AS (SELECT o_custkey AS gene, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS a, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS b FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT a, count(DISTINCT gene) AS ng FROM p GROUP BY a), n AS (SELECT b, count(*) AS nb FROM p GROUP BY b), c AS (SELECT a, b, count(*) AS s FROM p GROUP BY a, b), t AS (SELECT c.a, c.b, c.s, n.nb, g.ng / CAST((SELECT sum(ng) FROM g) AS DOUBLE) AS pr FROM c JOIN g USING (a) JOIN n USING (b)) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, s AS successes, nb AS trials, round(list_sum(list_transform(range(s, nb + 1), lambda i: exp(lgamma(nb + 1) - lgamma(i + 1) - lgamma(nb - i + 1) + i * ln(pr) + (nb - i) * ln(1 - pr)))), 6) AS pval FROM t")
def m22(spark, sf):
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    seg = F.array_position(F.array(*map(F.lit, _SEG)), F.col("c_mktsegment")) - 1
    pairs = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("gene"), seg.cast("int").alias("a"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("b"))
    t = st.binomial_table(pairs, 5, 5)
    return t.where("successes > 0").select("a", "b", "successes", "trials", F.round("pval", 6).alias("pval"))


@query("M23_large_averages")
def m23(spark, sf):
    return cl.large_averages(S.bits(spark, sf), 2, RESTARTS)


#: How far the background of each of 50 runs is moved within its bin.
SHIFTS = [1 + int(md5(f"shift_{i}".encode()).hexdigest()[:6], 16) for i in range(50)]

_DEVIATIONS = f"""
WITH total AS (SELECT row_id, CAST(sum(n) AS BIGINT) AS s FROM counts GROUP BY row_id),
share AS (SELECT col_id, sum(n) / CAST((SELECT sum(n) FROM counts) AS DOUBLE) AS share FROM counts GROUP BY col_id),
binned AS (SELECT row_id, s, CAST(least(floor(p_size / 51.0 * 10), 9) * 100 + floor(log2(1 + s)) AS BIGINT) AS bin FROM total JOIN part ON p_partkey = row_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY substr(md5(row_id || '_9'), 1, 15), row_id) - 1 AS place, count(*) OVER (PARTITION BY bin) AS size FROM binned),
hit AS (SELECT DISTINCT p_partkey AS row_id, unnest(string_split(p_type, ' ')) AS tf FROM part),
runs AS (SELECT * FROM (VALUES {", ".join(f"({i}, {o})" for i, o in enumerate([0, *SHIFTS]))}) v(run, off)),
found AS (SELECT run, tf, b.row_id, b.s FROM hit JOIN placed a USING (row_id) CROSS JOIN runs JOIN placed b ON b.bin = a.bin AND b.place = (a.place + off) % a.size),
seen AS (SELECT run, tf, col_id, sum(n) AS y FROM found JOIN counts USING (row_id) GROUP BY ALL),
held AS (SELECT run, tf, sum(s) AS held FROM found GROUP BY ALL),
raw AS (SELECT held.run, held.tf, share.col_id, (coalesce(y, 0) - share * held) / (share * held) AS d FROM held CROSS JOIN share LEFT JOIN seen ON seen.run = held.run AND seen.tf = held.tf AND seen.col_id = share.col_id),
b AS (SELECT tf, col_id, max(d) FILTER (WHERE run = 0) AS own, avg(d) FILTER (WHERE run > 0) AS mean, stddev_samp(d) FILTER (WHERE run > 0) AS sd FROM raw GROUP BY ALL)
SELECT tf, col_id AS sample, round(own - mean, 6) AS deviation, round((own - mean) / sd, 6) AS z FROM b
"""


@query("M24_deviations", sql("counts", _DEVIATIONS))
def m24(spark, sf):
    """Words of a part's type stand for motifs, its size for the GC share, nations for samples."""
    p = read_table(spark, sf, "part")
    hits = p.select(F.col("p_partkey").alias("peak"), F.explode(F.split("p_type", " ")).alias("tf"))
    gc = p.select(F.col("p_partkey").alias("peak"), (F.col("p_size") / 51.0).alias("gc"))
    counts = S.counts(spark, sf).select(F.col("row_id").alias("peak"), F.col("col_id").alias("sample"), "n")
    d = st.deviations(counts, hits, gc, SHIFTS, 9)
    return d.select("tf", "sample", F.round("deviation", 6).alias("deviation"), F.round("z", 6).alias("z"))


@query("M26_duplicates", sql("peaks", "SELECT 'r' || ord AS name, row_number() OVER (PARTITION BY chr, start // 5000, sample < 5 ORDER BY ord % 60 DESC, 'r' || ord) > 1 AS duplicate FROM peaks"))
def m26(spark, sf):
    """Pairs written as SAM and read back; those of both 5' ends and strands alike are one molecule.

    First reads begin at multiples of 5000, behind clips of lengths of their own; the half of
    the samples has its mates in turn.
    """
    path = shared_dir(spark, "sam")
    at = (F.floor(F.col("start") / 5000) * 5000).alias("at")
    p = S.peaks(spark, sf).select("ord", "chr", at, (F.col("ord") % 7).alias("clip"), (F.col("sample") < 5).alias("turned"))

    def line(bit, minus, pos, cigar):
        flag = F.lit(3 + bit) + F.lit(16 if minus else 32)
        return F.concat_ws("\t", F.concat(F.lit("r"), "ord"), flag, "chr", pos, F.col("ord") % 60, cigar, F.lit("="), F.lit(0), F.lit(0), F.lit("*"), F.lit("*")).alias("value")

    head, tail = F.concat(F.col("clip") + 1, F.lit("S40M")), F.concat(F.lit("30M"), F.col("clip") + 2, F.lit("S"))
    # The turned ones have their first mate on -, at the same places.
    for turned, (first, second) in ((False, (64, 128)), (True, (128, 64))):
        some = p.where(F.col("turned") == turned).withColumn("at", F.col("at") + (100 if turned else 0))
        some.select(line(first, False, F.col("at") + F.col("clip") + 2, head)).write.mode("append").text(path)
        some.select(line(second, True, F.col("at") + 471 - F.col("clip") - 2, tail)).write.mode("append").text(path)
    pairs = iv.pair_ends(readers.sequenced_ends(readers.read_sam(spark, path)))
    return iv.mark_duplicates(pairs, ["ends"], "quality", "name").select("name", "duplicate")


@query("M25_summary_counts", "SELECT 'lang' AS kind, lang AS name, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents JOIN labels USING (doc_id) WHERE n_chars <= 1000 AND toxic = 0 GROUP BY source UNION ALL SELECT 'share', 'all', CAST(round(100.0 * count(CASE WHEN n_chars <= 1000 THEN 1 END) / count(*)) AS BIGINT) FROM documents JOIN labels USING (doc_id)")
def m25(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(read_table(spark, sf, "labels"), "doc_id")
    by = d.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")).select(F.lit("lang").alias("kind"), "name", "n")
    local = d.where("n_chars <= 1000 and toxic = 0").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).select(F.lit("source").alias("kind"), "name", "n")
    share = d.agg(F.round(100 * F.avg((F.col("n_chars") <= 1000).cast("int"))).cast("long").alias("n")).select(F.lit("share").alias("kind"), F.lit("all").alias("name"), "n")
    return by.unionByName(local).unionByName(share)


@query("M22b_phred_table", "SELECT l_orderkey, l_linenumber, round(-10 * log10(1e-9 + l_tax / 10), 6) AS score FROM lineitem WHERE l_tax > 0")
def m22b(spark, sf):
    return read_table(spark, sf, "lineitem").where("l_tax > 0").select("l_orderkey", "l_linenumber", F.round(minus_log10(F.col("l_tax") / 10), 6).alias("score"))


@query("G9_louvain")
def g9(spark, sf):
    """Communities of the FDR edges between documents, by classes of documents of equal words."""
    edges, members = st.fdr_class_edges(mx.pack(word_bits(spark, sf), 64), 64, 0.001)
    return gr.louvain(edges, "w", members)
