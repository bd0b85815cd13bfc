"""F: scalar functions on strings, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import scalar as sc
from strandframe.functions import sequence as sq
from strandframe.operators import matrix as mx
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table

_FREQ = ", ".join(f"round(len(regexp_extract_all(seq, '{w}')) / CAST(length(seq) AS DOUBLE), 6) AS {w}" for w in sq.NUCLEOTIDES)


@query("F1_nucleotide_frequency", sql("dna", f"SELECT row_id, {_FREQ} FROM dna WHERE length(seq) > 0"))
def f1(spark, sf):
    t = sq.frequencies(S.dna(spark, sf).where("length(seq) > 0"))
    return t.select("row_id", *(F.round(w, 6).alias(w) for w in sq.NUCLEOTIDES))


@query("F2_reverse_complement", sql("dna", "SELECT row_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM dna"))
def f2(spark, sf):
    return S.dna(spark, sf).select("row_id", sq.reverse_complement(F.col("seq")).alias("rc"))


_FAMILY = "SELECT DISTINCT substr(b, 1, i - 1) || c || substr(b, i + 1) AS motif FROM (SELECT 'TTTCNNTTTC' AS b), (SELECT unnest([1, 2, 3, 4, 7, 8, 9, 10]) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS c)"


@query("F3_substitution_family", _FAMILY)
def f3(spark, sf):
    return sq.substitution_family(spark, "TTTCNNTTTC", fixed=(5, 6))


_WORDS = f"SELECT motif, substr(motif, 1, 4) || a || b || substr(motif, 7) AS word FROM ({_FAMILY}), (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b)"


@query("F4_wildcards", _WORDS)
def f4(spark, sf):
    return sq.expand_wildcards(sq.substitution_family(spark, "TTTCNNTTTC", fixed=(5, 6)), [5, 6])


@query("F5_motif_scan", sql("dna", "WITH w AS (SELECT 'ACGTA' AS word UNION ALL SELECT 'TTACC' UNION ALL SELECT 'AACAA'), k AS (SELECT word, word AS kmer, '+' AS strand FROM w UNION ALL SELECT word, reverse(translate(word, 'ACGT', 'TGCA')), '-' FROM w), s AS (SELECT row_id, i AS start, substr(seq, CAST(i + 1 AS BIGINT), 5) AS kmer FROM (SELECT row_id, seq, unnest(range(length(seq) - 4)) AS i FROM dna WHERE length(seq) >= 5)) SELECT row_id, start, start + 5 AS stop, word, strand FROM s JOIN k USING (kmer)"))
def f5(spark, sf):
    words = spark.createDataFrame([("ACGTA",), ("TTACC",), ("AACAA",)], "word string")
    return sq.scan(S.dna(spark, sf), words, 5)


@query("F6_kmers", sql("dna", "SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(i + 1 AS BIGINT), 34) AS kmer FROM (SELECT seq, unnest(range(length(seq) - 33)) AS i FROM dna WHERE length(seq) >= 34)) GROUP BY kmer"))
def f6(spark, sf):
    # Texts hold a few more characters than letters; they need not be folded to be counted.
    letters = read_table(spark, sf, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return sq.kmer_counts(S.dna(spark, sf), 34, letters)


@query("F7_centre_window", sql("dna", "SELECT row_id, substr(seq, CAST(round_even(length(seq) / 2, 0) AS BIGINT) - 10, 21) AS mid FROM dna WHERE length(seq) >= 40"))
def f7(spark, sf):
    return S.dna(spark, sf).where("length(seq) >= 40").select("row_id", sq.centre(F.col("seq"), 10).alias("mid"))


@query("F8_shuffle", sql("dna", "WITH l AS (SELECT row_id, i, substr(seq, i, 1) AS c FROM (SELECT row_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM dna)), s AS (SELECT row_id, string_agg(c, '' ORDER BY md5(row_id || '_' || i || '_5'), i) AS mixed FROM l GROUP BY row_id) SELECT row_id, coalesce(mixed, seq) AS seq FROM dna LEFT JOIN s USING (row_id)"))
def f8(spark, sf):
    return S.dna(spark, sf).select("row_id", sq.shuffled(F.col("row_id"), F.col("seq"), 5).alias("seq"))


#: A made-up matrix of six places; each favours one letter.
PWM = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.4, 0.1, 0.1, 0.4], [0.1, 0.1, 0.1, 0.7], [0.25, 0.25, 0.25, 0.25]]


def _pwm_sql() -> str:
    plus = sq.log_odds(PWM)
    minus = [{"ACGT"["TGCA".index(b)]: v for b, v in row.items()} for row in reversed(plus)]
    case = lambda j, row: f"CASE c{j} " + " ".join(f"WHEN '{b}' THEN CAST({v!r} AS DOUBLE)" for b, v in row.items()) + " END"
    one, two = (" + ".join(case(j, row) for j, row in enumerate(m)) for m in (plus, minus))
    # Each string is split once; the letters of a window are the next rows.
    next_ones = ", ".join(f"lead(c, {j}) OVER w AS c{j}" for j in range(len(PWM)))
    return f"WITH l AS (SELECT row_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS i FROM dna WHERE length(seq) >= 6), s AS (SELECT row_id, {next_ones} FROM l WINDOW w AS (PARTITION BY row_id ORDER BY i)), w AS (SELECT row_id, greatest({one}, {two}) AS score FROM s WHERE c5 IS NOT NULL)"


@query("F9_pwm_best_score", sql("dna", _pwm_sql() + " SELECT row_id, round(max(score), 6) AS score FROM w WHERE score IS NOT NULL GROUP BY row_id"))
def f9(spark, sf):
    return sq.pwm_best(S.dna(spark, sf), PWM).where("score is not null").select("row_id", F.round("score", 6).alias("score"))


@query("F10_motif_present", sql("dna", _pwm_sql() + f" SELECT row_id, max(score) >= {sq.pwm_threshold(PWM, 0.002)!r} - 1e-2 AS present FROM w WHERE score IS NOT NULL GROUP BY row_id"))
def f10(spark, sf):
    least = sq.pwm_threshold(PWM, 0.002) - 1e-2
    return sq.pwm_best(S.dna(spark, sf), PWM).where("score is not null").select("row_id", (F.col("score") >= least).alias("present"))


@query("F11_motif_names", "SELECT n_nationkey, replace(split_part(upper('m1_' || n_name || '::x_' || n_regionkey), '_', 2), '::', '_') AS tf FROM nation")
def f11(spark, sf):
    n = read_table(spark, sf, "nation")
    return n.select("n_nationkey", sq.motif_name(F.concat(F.lit("m1_"), "n_name", F.lit("::x_"), "n_regionkey")).alias("tf"))


@query("F12_upper_prefix", "SELECT p_partkey, upper(p_name) AS gene, 'chr' || p_size AS chr FROM part")
def f12(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("gene"), F.concat(F.lit("chr"), "p_size").alias("chr"))


@query("F13_alias_names", "SELECT n.n_nationkey, coalesce(CASE WHEN n.n_regionkey = 0 THEN 'ALIAS' END, n.n_name) AS cell FROM nation n WHERE n.n_regionkey < 3")
def f13(spark, sf):
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.concat("n_name", F.lit("#1")).alias("raw"))
    known = read_table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "ALIAS").alias("alias"))
    named = n.withColumn("name", sq.strip_suffix(F.col("raw"), 2)).join(known, "name")
    return named.select("n_nationkey", F.coalesce("alias", "name").alias("cell"))


@query("F14_log_transforms", "SELECT l_orderkey, l_linenumber, round(log2(1 + l_quantity), 6) AS l2, round(pow(2, l_discount), 6) AS p2, round(-10 * log10(1e-9 + l_discount), 6) AS phred FROM lineitem")
def f14(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(sc.log2p1("l_quantity"), 6).alias("l2"), F.round(F.pow(F.lit(2.0), "l_discount"), 6).alias("p2"), F.round(sc.minus_log10("l_discount"), 6).alias("phred"))


@query("F15_signed_log", "SELECT event_id, round(sign(z) * ln(1 + abs(z)), 6) AS v FROM (SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM events)")
def f15(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "value")
    one = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = e.crossJoin(F.broadcast(one)).select("event_id", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    return z.select("event_id", F.round(sc.signed_log("z"), 6).alias("v"))


@query("F16_hamming", sql("bits", "WITH r AS (SELECT row_id, list(x ORDER BY col_id) AS v FROM bits GROUP BY row_id) SELECT a.row_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]))) AS BIGINT) AS d FROM r a, r b WHERE b.row_id = 0"))
def f16(spark, sf):
    p = mx.pack(S.bits(spark, sf), 64)
    first = p.where("row_id = 0").select(F.col("bits").alias("b0"))
    return p.crossJoin(F.broadcast(first)).select("row_id", sc.hamming("bits", "b0").cast("long").alias("d"))


@query("F17_tags", "SELECT n_nationkey, 'idr_' || n_nationkey || '_' || n_regionkey || '/clusters.csv' AS path FROM nation")
def f17(spark, sf):
    n = read_table(spark, sf, "nation")
    return n.select("n_nationkey", F.concat(F.lit(sc.tag("idr", "")), "n_nationkey", F.lit("_"), "n_regionkey", F.lit("/clusters.csv")).alias("path"))


@query("F18_log_choose", "SELECT a.n, b.k, round(lgamma(a.n + 1) - lgamma(b.k + 1) - lgamma(a.n - b.k + 1), 6) AS v FROM (SELECT unnest(range(41)) AS n) a JOIN (SELECT unnest(range(41)) AS k) b ON b.k <= a.n")
def f18(spark, sf):
    from strandframe.operators.stats import log_factorials

    lf = log_factorials(spark, 40)
    n = lf.select(F.col("i").cast("long").alias("n"), F.col("lf").alias("fn"))
    pairs = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "n"))).withColumn("r", F.col("n") - F.col("k"))
    fk, fr = lf.select(F.col("i").alias("k"), F.col("lf").alias("fk")), lf.select(F.col("i").alias("r"), F.col("lf").alias("fr"))
    return pairs.join(fk, "k").join(fr, "r").select("n", "k", F.round(F.col("fn") - F.col("fk") - F.col("fr"), 6).alias("v"))
