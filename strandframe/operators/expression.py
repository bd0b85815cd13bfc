"""Expression tables: moderated tests, variance stabilising, over-represented terms.

Tables are long and may be sparse: a (gene, sample) that is not there is a zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import tails
from strandframe.operators.stats import standing
from strandframe.runtime import fresh_names, shared_dir, ship, written


def step_up(values: DataFrame, p: str, name: str) -> DataFrame:
    """``values`` with ``name``: p adjusted for the false discovery rate, the least p * m / rank
    over this and all greater p (at most 1). A null p is no test and stays null.

    It is worked out once for each distinct p, so a p that very many rows have is one row.
    """
    after, least, total = fresh_names(values, "_after", "_least", "_m")
    at = written(standing(values, p), "standing")
    m = at.agg(F.max("upto").alias(total))
    raw = at.crossJoin(F.broadcast(m)).select(p, "bucket", (F.col(p) * F.col(total) / F.col("upto")).alias("raw"))  # m is one row
    by_bucket = raw.groupBy("bucket").agg(F.min("raw").alias(least))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select("bucket", F.min(least).over(later).alias(after))  # one row a bucket
    # In falling order, as a frame that ends at the last row is worked out anew for each row.
    within = Window.partitionBy("bucket").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = raw.withColumn(least, F.min("raw").over(within)).join(by_bucket, "bucket")
    adjusted = adjusted.select(F.col(p).alias(after), F.least(least, after, F.lit(1.0)).alias(name))
    return values.join(adjusted, F.col(p) == F.col(after), "left").drop(after)


def two_groups(values: DataFrame, samples: DataFrame) -> DataFrame:
    """(gene, logFC, avg, s2, df, n1, n0): means of two groups of samples and their pooled variance.

    values (gene, sample, v), samples (sample, grp: 1 response, 0 control). Sums of squares
    are put together from the variances of what is there, so no digits cancel.
    """
    sizes = samples.groupBy().agg(F.count_if(F.col("grp") == 1).alias("n1"), F.count_if(F.col("grp") == 0).alias("n0"))
    of = lambda f, g: f(F.when(F.col("grp") == g, F.col("v")))
    per = values.join(samples, "sample").groupBy("gene")
    per = per.agg(*(of(f, g).alias(f"{name}{g}") for g in (1, 0) for name, f in (("k", F.count), ("m", F.avg), ("q", F.var_pop))))
    per = per.crossJoin(F.broadcast(sizes))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean = {g: F.when(F.col(f"n{g}") > 0, zero(f"m{g}") * F.col(f"k{g}") / F.col(f"n{g}")) for g in (1, 0)}
    ss = {g: F.col(f"k{g}") * (zero(f"q{g}") + zero(f"m{g}") * zero(f"m{g}") * (F.col(f"n{g}") - F.col(f"k{g}")) / F.greatest(f"n{g}", F.lit(1))) for g in (1, 0)}
    df = (F.col("n1") + F.col("n0") - 2).cast("double")
    return per.select(
        "gene",
        (mean[1] - mean[0]).alias("logFC"),
        ((mean[1] * F.col("n1") + mean[0] * F.col("n0")) / (F.col("n1") + F.col("n0"))).alias("avg"),
        F.when(df > 0, (ss[1] + ss[0]) / df).alias("s2"),
        df.alias("df"),
        "n1",
        "n0",
    )


def variance_prior(genes: DataFrame) -> tuple[float, float]:
    """(d0, s0 squared): degrees of freedom and scale of the distribution that the genes'
    variances (s2, of df degrees) are drawn from, by the mean and variance of their logarithms.

    Genes without a variance, or of variance 0, say nothing of it. d0 is infinite where the
    variances differ no more than chance makes them.
    """
    used = genes.where("s2 > 0").groupBy("df").agg(F.count("*").alias("n"), F.avg(F.ln("s2")).alias("m"), F.var_pop(F.ln("s2")).alias("v"))
    # A row for each number of degrees of freedom: as many as there are sizes of groups.
    rows = [(r["n"], r["m"] - tails.digamma(r["df"] / 2) + math.log(r["df"] / 2), r["v"], tails.trigamma(r["df"] / 2)) for r in used.collect()]
    n = sum(r[0] for r in rows)
    if not n:
        return math.inf, math.nan
    mean = sum(k * e for k, e, _, _ in rows) / n
    spread = sum(k * (v + (e - mean) ** 2) for k, e, v, _ in rows) / (n - 1) if n > 1 else 0.0
    excess = spread - sum(k * t for k, _, _, t in rows) / n
    if excess <= 0:
        return math.inf, math.exp(mean)
    d0 = 2 * tails.trigamma_inverse(excess)
    return d0, math.exp(mean + tails.digamma(d0 / 2) - math.log(d0 / 2))


def moderated_test(values: DataFrame, samples: DataFrame) -> DataFrame:
    """(gene, logFC, avg, t, df, p, adj): two-sided moderated t tests of response against control.

    Each gene's variance is drawn towards the prior of all genes (``variance_prior``) and
    gains its degrees of freedom, up to those of all genes together. A gene whose variance
    can't be told (fewer than three samples) has null t and p; an empty group gives nulls.
    """
    ship(values.sparkSession)
    genes = written(two_groups(values, samples), "expression")
    d0, s0 = variance_prior(genes)
    pooled = genes.where("s2 is not null").agg(F.sum("df").alias("d")).first()["d"] or 0.0
    s2, df = F.col("s2"), F.col("df")
    post = F.when(s2.isNotNull(), F.lit(s0) if math.isinf(d0) else (F.lit(d0) * F.lit(s0) + df * s2) / (F.lit(d0) + df))
    error = F.sqrt(post * (1 / F.col("n1") + 1 / F.col("n0")))
    tested = genes.select(
        "gene",
        "logFC",
        "avg",
        F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (error > 0), F.col("logFC") / error).alias("t"),
        F.when(s2.isNotNull(), F.least(df + F.lit(d0), F.lit(pooled))).alias("df"),
    )
    return step_up(written(tested.withColumn("p", tails.t_tail("t", "df")), "expression"), "p", "adj")


# Variance stabilising -------------------------------------------------------------

#: Dispersions that are looked at: the transform needs them below 4 / 3.
LEAST_DISPERSION, MOST_DISPERSION = 1e-4, 1.0


def stabilised(x, dispersion: float):
    """Anscombe's transform of negative binomial counts, as base 2 logarithms for large x; a column or an array."""
    c = 0.375
    lib = np if isinstance(x, np.ndarray) else F
    inner = lib.sqrt((x + c) / (1 / dispersion - 2 * c))
    return 2 / math.log(2) * (lib.arcsinh(inner) if lib is np else F.asinh(inner))


def _scaled(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """(gene, sample, x): counts over their sample's size, relative to the mean size of all samples."""
    total = samples.select("sample").join(counts.groupBy("sample").agg(F.sum("n").alias("size")), "sample", "left").na.fill(0, ["size"])
    total = total.crossJoin(F.broadcast(total.agg(F.avg("size").alias("mean"))))  # one row
    return counts.join(total, "sample").select("gene", "sample", (F.col("n") * F.col("mean") / F.col("size")).alias("x"))


def _coefficients(dispersions: list[float], n_samples: int):
    """(i, n, s, q) of a task's genes: their number, and the sums of the residual deviations
    at each dispersion and of their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            rows = ([], [], [], [])
            for i, d in enumerate(dispersions):
                zero = float(stabilised(np.zeros(1), d)[0])
                y = stabilised(flat, d) - zero  # relative to a zero, of which there are n_samples - size
                mean = np.add.reduceat(y, at) / n_samples
                square = np.add.reduceat((y - np.repeat(mean, sizes)) ** 2, at) + (n_samples - sizes) * mean**2
                sd = np.sqrt(square / max(n_samples - 1, 1))
                for c, v in zip(rows, (i, len(sd), float(sd.sum()), float((sd * sd).sum())), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), pa.array(rows[3])], ["i", "n", "s", "q"])

    return run


def find_dispersion(counts: DataFrame, samples: DataFrame, points: int = 12, rounds: int = 6) -> float:
    """The dispersion at which the genes' residual deviations, once transformed, vary least
    (their standard deviation over their mean), so that they least depend on the mean.

    counts (gene, sample, n > 0), samples (sample). A gene's counts are gathered once (as
    many as there are samples); each round looks at ``points`` dispersions in one pass
    without a shuffle and goes on between the neighbours of the best one. Counts of genes
    that are zero throughout don't matter. An empty table gives the least dispersion.
    """
    ship(counts.sparkSession)
    n = samples.count()
    rows = written(_scaled(counts, samples).groupBy("gene").agg(F.collect_list("x").alias("x")).select("x"), "expression")
    low, high, best = math.log(LEAST_DISPERSION), math.log(MOST_DISPERSION), math.log(LEAST_DISPERSION)
    for _ in range(rounds):
        logs = [low + (high - low) * i / (points - 1) for i in range(points)]
        sums = rows.mapInArrow(_coefficients([math.exp(v) for v in logs], n), "i int, n long, s double, q double")
        score = {}
        for r in sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
            if r["s"] > 0:
                mean = r["s"] / r["n"]
                score[r["i"]] = max(r["q"] / r["n"] - mean * mean, 0.0) ** 0.5 / mean
        if not score:
            break
        i = min(score, key=lambda j: (score[j], j))
        best, low, high = logs[i], logs[max(i - 1, 0)], logs[min(i + 1, points - 1)]
    return math.exp(best)


def stabilise(counts: DataFrame, samples: DataFrame, dispersion: float | None = None) -> DataFrame:
    """(gene, sample, y) of all genes with a count and all samples: stabilised counts.

    ``dispersion`` None looks for it. Samples of no counts have zeros.
    """
    d = find_dispersion(counts, samples) if dispersion is None else dispersion
    x = _scaled(counts, samples)
    # Samples are columns of the matrix: a row of their names goes with each gene.
    grid = counts.select("gene").distinct().crossJoin(F.broadcast(samples.select("sample")))
    filled = grid.join(x, ["gene", "sample"], "left")
    return filled.select("gene", "sample", stabilised(F.coalesce("x", F.lit(0.0)), d).alias("y"))


# Terms ------------------------------------------------------------------------


def ancestors(edges: DataFrame) -> DataFrame:
    """(term, above): each term of ``edges`` (term, parent) with itself and all that lies above it,
    once, by whatever ways; a cycle's terms lie above each other.

    Ways are doubled in each round, so as many rounds are made as the logarithm of the longest.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark, "terms")
    links = edges.where("term is not null and parent is not null").select("term", F.col("parent").alias("above")).distinct()
    every = links.select("term").unionByName(links.select(F.col("above").alias("term"))).distinct().select("term", F.col("term").alias("above"))
    known, n = links.unionByName(every).distinct().checkpoint(), -1
    while (now := known.count()) != n:
        n = now
        further = known.join(known.select(F.col("term").alias("above"), F.col("above").alias("top")), "above").select("term", F.col("top").alias("above"))
        known = further.distinct().checkpoint()
    return known


def over_representation(chosen: DataFrame, annotations: DataFrame, edges: DataFrame, least_term: int = 2) -> DataFrame:
    """(term, intersection_size, term_size, query_size, universe, recall, p, adj): how much more often
    the chosen genes have a term than as many genes dealt at random.

    chosen (gene), annotations (gene, term), edges (term, parent): a gene with a term has
    all terms above it too. The universe is the annotated genes; chosen ones outside of it
    don't count. Terms of fewer than ``least_term`` genes, or of none chosen, aren't tested.
    """
    # Genes of the same terms are counted together before the terms above them are laid out.
    direct = annotations.where("gene is not null and term is not null").groupBy("gene").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    marked = direct.join(chosen.select("gene").distinct().withColumn("hit", F.lit(1)), "gene", "left")
    classes = written(marked.groupBy("terms").agg(F.count("*").alias("n"), F.count("hit").alias("k")), "terms")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name)
    sizes = classes.agg(total("n", "universe"), total("k", "query_size"))  # one row
    above = ancestors(edges).groupBy("term").agg(F.collect_list("above").alias("above"))
    each = classes.select("terms", "n", "k", F.explode("terms").alias("term")).join(above, "term", "left")
    each = each.withColumn("above", F.coalesce("above", F.array("term")))  # terms that no edge names stay as they are
    every = each.groupBy("terms", "n", "k").agg(F.array_distinct(F.flatten(F.collect_list("above"))).alias("above"))
    terms = every.select("n", "k", F.explode("above").alias("term")).groupBy("term").agg(F.sum("n").alias("term_size"), F.sum("k").alias("intersection_size"))
    terms = terms.where((F.col("term_size") >= least_term) & (F.col("intersection_size") > 0)).crossJoin(F.broadcast(sizes))
    p = F.exp(tails.hypergeometric_ln_tail(F.col("intersection_size"), F.col("term_size"), F.col("query_size"), F.col("universe")))
    tested = terms.withColumn("recall", F.col("intersection_size") / F.col("term_size")).withColumn("p", p)
    out = step_up(written(tested, "terms"), "p", "adj")
    return out.select("term", "intersection_size", "term_size", "query_size", "universe", "recall", "p", "adj")
