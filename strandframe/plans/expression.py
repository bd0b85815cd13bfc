"""M24 and M26 over the test tables: expression, terms, peaks, replicates.

Genes are parts, samples nations, counts line items; responses are the nations of the
first two regions. Terms are brands, types and what they have in common: a part's term
lies below its brand and its type. Reads are events, in seconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import expression as ex
from strandframe.operators import peaks as pk
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table, written


def _counts(spark, sf):
    return S.counts(spark, sf).select(F.col("row_id").alias("gene"), F.col("col_id").alias("sample"), "n")


def _groups(spark, sf):
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("sample"), (F.col("n_regionkey") < 2).cast("int").alias("grp"))


def differential(spark, sf):
    size = read_table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), "p_size")
    values = _counts(spark, sf).join(size, "gene").select("gene", "sample", F.log2(1 + F.col("n") * F.col("p_size")).alias("v"))
    return ex.moderated_test(values, _groups(spark, sf))


_UP = 12


def _digamma(x: str) -> str:
    y = f"({x} + {_UP})"
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - list_sum(list_transform(range({_UP}), lambda k: 1 / ({x} + k))))"


def _trigamma(x: str) -> str:
    y = f"({x} + {_UP})"
    return f"(1 / {y} + 0.5 / {y} ** 2 + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) + list_sum(list_transform(range({_UP}), lambda k: 1 / ({x} + k) ** 2)))"


def _step_up(table: str, p: str = "p") -> str:
    """Rows of ``table`` with ``adj``."""
    ranked = f"SELECT *, count({p}) OVER (ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS rk, count({p}) OVER () AS m FROM {table}"
    return f"SELECT *, CASE WHEN {p} IS NOT NULL THEN least(min({p} * m / rk) OVER (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING), 1.0) END AS adj FROM ({ranked}) WHERE {p} IS NOT NULL"


# The tail of t is 1 less twice the integral of its density from 0 to t, by Simpson's rule.
_DIFFERENTIAL = f"""WITH s AS (SELECT n_nationkey AS sample, CAST(n_regionkey < 2 AS INTEGER) AS grp FROM nation),
 v AS (SELECT g.row_id AS gene, s.grp, coalesce(log2(1 + c.n * g.p_size), 0.0) AS v FROM (SELECT DISTINCT row_id, p_size FROM counts JOIN part ON p_partkey = row_id) g CROSS JOIN s LEFT JOIN counts c ON c.row_id = g.row_id AND c.col_id = s.sample),
 st AS (SELECT gene, avg(v) FILTER (WHERE grp = 1) - avg(v) FILTER (WHERE grp = 0) AS lfc, avg(v) AS av, count(*) FILTER (WHERE grp = 1) AS n1, count(*) FILTER (WHERE grp = 0) AS n0,
   (var_pop(v) FILTER (WHERE grp = 1) * count(*) FILTER (WHERE grp = 1) + var_pop(v) FILTER (WHERE grp = 0) * count(*) FILTER (WHERE grp = 0)) / (count(*) - 2) AS s2, CAST(count(*) - 2 AS DOUBLE) AS df FROM v GROUP BY gene),
 e AS (SELECT avg(ln(s2)) AS m, var_samp(ln(s2)) AS x, any_value(df) AS df FROM st WHERE s2 > 0),
 e2 AS (SELECT m - {_digamma('df / 2')} + ln(df / 2) AS m, x - {_trigamma('df / 2')} AS x FROM e),
 it AS (SELECT 0 AS i, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi UNION ALL SELECT i + 1, CASE WHEN tri > x THEN mid ELSE lo END, CASE WHEN tri > x THEN hi ELSE mid END
   FROM (SELECT i, lo, hi, mid, x, {_trigamma('exp(mid)')} AS tri FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, e2.x FROM it, e2 WHERE i < 200))),
 d AS (SELECT CASE WHEN x > 0 THEN 2 * exp((lo + hi) / 2) END AS d0, m FROM it, e2 WHERE i = 200),
 pr AS (SELECT d0, CASE WHEN d0 IS NULL THEN exp(m) ELSE exp(m + {_digamma('d0 / 2')} - ln(d0 / 2)) END AS s0, (SELECT sum(df) FROM st) AS pooled FROM d),
 t AS (SELECT gene, lfc, av, least(coalesce(df + d0, pooled), pooled) AS df, lfc / sqrt((CASE WHEN d0 IS NULL THEN s0 ELSE (d0 * s0 + df * s2) / (d0 + df) END) * (1.0 / n1 + 1.0 / n0)) AS t FROM st, pr),
 p AS (SELECT *, 1 - 2 * exp(lgamma(df / 2 + 0.5) - lgamma(df / 2)) / sqrt(df * pi()) * abs(t) / 1500 * list_sum(list_transform(range(501), lambda i: (CASE WHEN i IN (0, 500) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (t * i / 500) ** 2 / df) ** (-(df + 1) / 2))) AS p FROM t)
 SELECT gene, round(lfc, 6) AS "logFC", round(av, 6) AS avg, round(t, 5) AS t, round(df, 4) AS df, round(p, 6) AS p, round(adj, 6) AS adj FROM ({_step_up('p')})"""


@query("M24_differential", sql("counts", "WITH RECURSIVE " + _DIFFERENTIAL[5:]))
def m24_differential(spark, sf):
    d = differential(spark, sf)
    return d.select("gene", F.round("logFC", 6).alias("logFC"), F.round("avg", 6).alias("avg"), F.round("t", 5).alias("t"), F.round("df", 4).alias("df"), F.round("p", 6).alias("p"), F.round("adj", 6).alias("adj"))


@query("P16_significant_genes", sql("counts", "WITH RECURSIVE " + _DIFFERENTIAL[5:].rpartition(" SELECT gene, round(lfc")[0] + f" SELECT gene FROM ({_step_up('p')}) WHERE abs(lfc) > 0.5 AND p < 0.05"))
def p16_genes(spark, sf):
    """The reference's filter of a test's table: great enough changes of small enough p."""
    return differential(spark, sf).where((F.abs("logFC") > 0.5) & (F.col("p") < 0.05)).select("gene")


_SIZED = """WITH z AS (SELECT n_nationkey AS col_id, coalesce(sum(n), 0) AS size FROM nation LEFT JOIN counts ON col_id = n_nationkey GROUP BY 1),
 g AS (SELECT row_id, n_nationkey AS col_id FROM (SELECT DISTINCT row_id FROM counts), nation),
 x AS (SELECT g.row_id, g.col_id, coalesce(n * (SELECT avg(size) FROM z) / size, 0.0) AS x FROM g LEFT JOIN counts c ON c.row_id = g.row_id AND c.col_id = g.col_id LEFT JOIN z ON z.col_id = g.col_id)"""


@query("M24_stabilised", sql("counts", _SIZED + " SELECT row_id AS gene, col_id AS sample, round(2 / ln(2) * asinh(sqrt((x + 0.375) / (1 / 0.1 - 0.75))), 6) AS y FROM x"))
def m24_stabilised(spark, sf):
    """At a given dispersion."""
    return ex.stabilise(_counts(spark, sf), _groups(spark, sf), 0.1).select("gene", "sample", F.round("y", 6).alias("y"))


@query("M24_found_dispersion")
def m24_dispersion(spark, sf):
    """At the dispersion that the counts themselves lead to; tests hold it against a search in numpy."""
    counts, samples = _counts(spark, sf), _groups(spark, sf)
    d = ex.find_dispersion(counts, samples)
    return ex.stabilise(counts, samples, d).select("gene", "sample", "y", F.lit(d).alias("dispersion"))


_TERMS = """a AS (SELECT p_partkey AS gene, p_brand || '/' || p_type AS term FROM part),
 e AS (SELECT DISTINCT p_brand || '/' || p_type AS term, unnest([p_brand, p_type]) AS parent FROM part UNION SELECT p_brand, unnest(['maker ' || substr(p_brand, 7, 1), 'line ' || substr(p_brand, 8, 1)]) FROM part
   UNION SELECT p_type, 'any' FROM part UNION SELECT unnest(['maker ' || substr(p_brand, 7, 1), 'line ' || substr(p_brand, 8, 1)]), 'any' FROM part),
 up AS (SELECT term, term AS above FROM a UNION SELECT up.term, e.parent FROM up JOIN e ON e.term = up.above),
 h AS (SELECT DISTINCT gene, above AS term FROM a JOIN up USING (term)),
 q AS (SELECT DISTINCT p_partkey AS gene FROM part WHERE p_size >= 40),
 z AS (SELECT (SELECT count(DISTINCT gene) FROM h) AS n, (SELECT count(*) FROM q) AS d),
 t AS (SELECT term, count(*) AS term_size, count(q.gene) AS k FROM h LEFT JOIN q USING (gene) GROUP BY term HAVING count(*) >= 2 AND count(q.gene) > 0),
 p AS (SELECT *, list_sum(list_transform(range(k, least(term_size, d) + 1), lambda i: CASE WHEN d - i <= n - term_size THEN exp(lgamma(term_size + 1) - lgamma(i + 1) - lgamma(term_size - i + 1) + lgamma(n - term_size + 1) - lgamma(d - i + 1) - lgamma(n - term_size - d + i + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)) ELSE 0 END)) AS p FROM t, z)"""


@query("M24_terms", f"WITH RECURSIVE {_TERMS} SELECT term, k AS intersection_size, term_size, d AS query_size, n AS universe, round(k / CAST(term_size AS DOUBLE), 6) AS recall, round(p, 6) AS p, round(adj, 6) AS adj FROM ({_step_up('p')})")
def m24_terms(spark, sf):
    part = read_table(spark, sf, "part")
    leaf = F.concat("p_brand", F.lit("/"), "p_type")
    maker, line = F.concat(F.lit("maker "), F.substring("p_brand", 7, 1)), F.concat(F.lit("line "), F.substring("p_brand", 8, 1))
    links = ((leaf, F.col("p_brand")), (leaf, F.col("p_type")), (F.col("p_brand"), maker), (F.col("p_brand"), line), *((c, F.lit("any")) for c in (F.col("p_type"), maker, line)))
    edges = part.select(F.explode(F.array(*(F.struct(t.alias("term"), p.alias("parent")) for t, p in links))).alias("e")).select("e.*")
    chosen = part.where("p_size >= 40").select(F.col("p_partkey").alias("gene"))
    found = ex.over_representation(chosen, part.select(F.col("p_partkey").alias("gene"), leaf.alias("term")), edges)
    return found.select("term", "intersection_size", "term_size", "query_size", "universe", *(F.round(c, 6).alias(c) for c in ("recall", "p", "adj")))


#: Of calls over events: fragments, their shift, all places (a month of five kinds of event), windows, gaps.
EXTENT, SHIFT, GENOME, WINDOWS, GAP = 1800, 75, 5 * 30 * 86400, (14_400, 86_400), 600


def _reads(spark, sf):
    return S.peaks(spark, sf).select("ord", "chr", "start", "stop", F.when(F.col("ord") % 2 == 0, "+").otherwise("-").alias("strand"), "sample")


def _called(reads, least_score: float, least_length: int = EXTENT // 6):
    return pk.call_peaks(reads, EXTENT, GENOME, least_score, SHIFT, WINDOWS, GAP, least_length)


_SPANS = ", ".join(f"(f + {EXTENT // 2 - w // 2}, f + {EXTENT // 2 - w // 2 + w}, {i + 1})" for i, w in enumerate(WINDOWS))
_NEAR = ", ".join(f"sum(CASE WHEN i = {i} THEN by_ ELSE 0 END) AS c{i}" for i in range(len(WINDOWS) + 1))
_RUNS = ", ".join(f"sum(c{i}) OVER w AS c{i}" for i in range(len(WINDOWS) + 1))
_RATE = f"greatest({', '.join([f'(SELECT count(*) FROM peaks) * CAST({EXTENT / GENOME!r} AS DOUBLE)', *(f'c{i + 1} * CAST({EXTENT / w!r} AS DOUBLE)' for i, w in enumerate(WINDOWS))])})"
_PEAKS = f"""WITH f AS (SELECT chr, CASE WHEN ord % 2 = 0 THEN start + {SHIFT} ELSE stop - {SHIFT + EXTENT} END AS f FROM peaks),
 r AS (SELECT chr, a, b, i FROM f, LATERAL (VALUES (f, f + {EXTENT}, 0), {_SPANS}) v(a, b, i)),
 e AS (SELECT chr, greatest(a, 0) AS pos, i, 1 AS by_ FROM r UNION ALL SELECT chr, greatest(b, 0), i, -1 FROM r),
 s AS (SELECT chr, pos, {_NEAR} FROM e GROUP BY chr, pos),
 c AS (SELECT chr, pos AS start, lead(pos) OVER w AS stop, {_RUNS} FROM s WINDOW w AS (PARTITION BY chr ORDER BY pos)),
 l AS (SELECT *, {_RATE} AS rate FROM c WHERE c0 > 0),
 p AS (SELECT chr, start, stop, c0 AS depth, rate, -log10(list_sum(list_transform(range(CAST(c0 AS BIGINT), CAST(c0 + 200 AS BIGINT)), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1))))) AS score FROM l),
 k AS (SELECT *, CASE WHEN start > max(stop + {GAP}) OVER (PARTITION BY chr ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM p WHERE score >= 1.0),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM k),
 o AS (SELECT chr, min(start) AS start, max(stop) AS stop, arg_max(struct_pack(a := start, b := stop, d := depth, r := rate, s := score), struct_pack(d := depth, n := -start)) AS top FROM n GROUP BY chr, island)"""


@query("M26_peaks", sql("peaks", _PEAKS + f" SELECT chr, start, stop, (top.a + top.b) // 2 AS summit, CAST(top.d AS BIGINT) AS depth, round(top.s, 6) AS score, round((top.d + 1) / (top.r + 1), 6) AS fold FROM o WHERE stop - start >= {EXTENT // 6}"))
def m26_peaks(spark, sf):
    return _called(_reads(spark, sf), 1.0).select("chr", "start", "stop", "summit", "depth", F.round("score", 6).alias("score"), F.round("fold", 6).alias("fold"))


@query("M26_reproducible")
def m26_reproducible(spark, sf):
    """Peaks called in two halves of the samples, met in the peaks of all of them, with their rates."""
    reads = _reads(spark, sf)
    pooled = written(_called(reads, 0.5, 0).withColumn("peak", F.concat_ws(":", "chr", "start")), "peaks")
    found = pk.matched(pooled, _called(reads.where("sample < 5"), 0.2, 0), _called(reads.where("sample >= 5"), 0.2, 0), "peak")
    return pk.irreproducible_rate(found, "peak")
