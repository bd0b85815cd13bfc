"""Peaks of reads: coverage, calling against a local rate, and reproducibility of replicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.tails import poisson_ln_tail
from strandframe.operators.intervals import SEGMENT, islands, overlap_pairs
from strandframe.operators.stats import ranks, standing
from strandframe.runtime import ship, written


def swept(events: DataFrame, columns: list[str], segment: int = SEGMENT) -> DataFrame:
    """(chr, start, stop, columns): running sums of the changes (chr, pos, columns) along each chr.

    Rows go from one place of change to the next. Changes of one place are added up before
    they are sorted; sums run within stretches of ``segment`` places, and what earlier
    stretches hand on is a table of one row for each stretch. So no task holds a chromosome,
    or more than a stretch's places of change, however deep it is covered.
    """
    at = events.groupBy("chr", "pos").agg(*(F.sum(c).alias(c) for c in columns)).withColumn("_seg", F.floor(F.col("pos") / segment))
    stretches = Window.partitionBy("chr").orderBy("_seg")
    earlier = stretches.rowsBetween(Window.unboundedPreceding, -1)
    per = at.groupBy("chr", "_seg").agg(F.min("pos").alias("_first"), *(F.sum(c).alias(c) for c in columns))
    handed = per.select("chr", "_seg", F.lead("_first").over(stretches).alias("_next"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns))
    by = Window.partitionBy("chr", "_seg").orderBy("pos")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = at.join(handed, ["chr", "_seg"])
    rows = rows.select("chr", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(by), "_next").alias("stop"), *((F.sum(c).over(run) + F.col(f"_{c}")).alias(c) for c in columns))
    return rows.where("stop is not null")


def pileup(reads: DataFrame, extent: int, shift: int = 0, windows: tuple[int, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """(chr, start, stop, depth, near0, near1, ...) where anything is near.

    A read's fragment begins ``shift`` behind its 5' end (start on +, stop on any other
    strand) and is ``extent`` long; depth is the number of fragments over a place, near_i
    that of fragments with their middle within windows[i] / 2 of it. Nothing lies before 0.
    Reads with a null place are left out.
    """
    plus = F.col("strand").eqNullSafe("+")
    begin = F.when(plus, F.col("start") + shift).otherwise(F.col("stop") - shift - extent)
    fragments = reads.where("chr is not null and start is not null and stop is not null").select("chr", begin.alias("f"))
    names = ["depth", *(f"near{i}" for i in range(len(windows)))]
    middle = F.col("f") + extent // 2
    spans = [(F.col("f"), F.col("f") + extent), *((middle - w // 2, middle - w // 2 + w) for w in windows)]
    zero = F.lit(0).cast("long")

    def change(place: Column, i: int, by: int) -> Column:
        return F.struct(F.greatest(place, zero).cast("long").alias("pos"), *(F.lit(by if j == i else 0).cast("long").alias(n) for j, n in enumerate(names)))

    changes = F.array(*(change(p, i, by) for i, span in enumerate(spans) for p, by in zip(span, (1, -1), strict=True)))
    events = fragments.select("chr", F.inline(changes))
    return swept(events, names, segment).where(" or ".join(f"{n} > 0" for n in names))


def scored_pileup(reads: DataFrame, extent: int, genome: int, shift: int = 0, windows: tuple[int, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """(chr, start, stop, depth, rate, score) where a fragment lies.

    ``rate`` is the greatest of the mean depth over ``genome`` places and the mean depths
    that the windows lead to expect; score is -log10 of the chance of this depth or more.
    """
    total = reads.where("chr is not null and start is not null and stop is not null").agg(F.count("*").alias("total"))
    rows = pileup(reads, extent, shift, windows, segment).where("depth > 0").crossJoin(F.broadcast(total))  # one row
    expected = [F.col("total") * (extent / genome), *(F.col(f"near{i}") * (extent / w) for i, w in enumerate(windows))]
    rate = F.greatest(*expected) if windows else expected[0]
    ship(reads.sparkSession)
    rows = rows.select("chr", "start", "stop", "depth", rate.alias("rate"))
    return rows.withColumn("score", -poisson_ln_tail(F.col("depth"), F.col("rate")) / math.log(10))


def call_peaks(reads: DataFrame, extent: int, genome: int, least_score: float, shift: int = 0, windows: tuple[int, ...] = (), gap: int = 0, least_length: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(chr, start, stop, summit, depth, score, fold) of the peaks of ``reads`` (chr, start, stop, strand).

    Places of ``least_score`` or more form a peak, over gaps of up to ``gap`` places; peaks
    shorter than ``least_length`` go. The summit is the middle of the first of the deepest
    rows of a peak, and depth, score and fold ((depth + 1) / (rate + 1)) are those there.
    Duplicate reads all count. A peak is put together by partial aggregates.
    """
    # Scores are worked out once: windows and joins read their table.
    scored = written(scored_pileup(reads, extent, genome, shift, windows, segment), "peaks")
    found = scored.where(F.col("score") >= least_score)
    merged = islands(found.withColumn("stop", F.col("stop") + gap), [], segment)
    deepest = F.max_by(F.struct("start", "stop", "depth", "rate", "score"), F.struct("depth", (-F.col("start")).alias("first"))).alias("top")
    peaks = merged.groupBy("chr", "island").agg(F.min("start").alias("start"), (F.max("stop") - gap).alias("stop"), deepest)
    middle = F.floor((F.col("top.start") + F.col("top.stop") - gap) / 2).cast("long")
    fold = (F.col("top.depth") + 1) / (F.col("top.rate") + 1)
    return peaks.where(F.col("stop") - F.col("start") >= least_length).select("chr", "start", "stop", middle.alias("summit"), F.col("top.depth").alias("depth"), F.col("top.score").alias("score"), fold.alias("fold"))


# Reproducibility ------------------------------------------------------------------


def matched(pooled: DataFrame, first: DataFrame, second: DataFrame, pooled_id: str, width: int = 500) -> DataFrame:
    """(pooled_id, s1, s2): the best scores that overlap a pooled peak in each of two replicates.

    Peaks that one of them lacks are left out, as they have no rank there.
    """

    def best(peaks: DataFrame, name: str) -> DataFrame:
        named = written(peaks.select("chr", "start", "stop", "score", F.monotonically_increasing_id().alias("_peak")), "peaks")
        met = overlap_pairs(pooled, named, pooled_id, "_peak", width)
        return met.join(named.select("_peak", "score"), "_peak").groupBy(pooled_id).agg(F.max("score").alias(name))

    return best(first, "s1").join(best(second, "s2"), pooled_id).where("s1 is not null and s2 is not null")


#: Starting values of mean, deviation and correlation of what reproduces, and its share.
START = (2.6, 1.3, 0.8, 0.7)
#: Bounds that keep a step from leaving where the model is defined.
BOUNDS = ((0.0, 20.0), (0.2, 20.0), (0.0, 0.995), (0.001, 0.999))


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z.tolist()])


def marginal_table(theta: tuple[float, ...], points: int = 8001) -> tuple[np.ndarray, np.ndarray]:
    """Places and the distribution function there of one replicate's scores under the mixture."""
    mu, sigma, _, share = theta
    z = np.linspace(min(-8.0, mu - 8 * sigma), max(8.0, mu + 8 * sigma), points)
    return z, share * _normal_cdf((z - mu) / sigma) + (1 - share) * _normal_cdf(z)


def _reproducible(u1: np.ndarray, u2: np.ndarray, theta: tuple[float, ...], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores that the mixture gives the shares u1, u2, and the chance that a pair reproduces."""
    mu, sigma, rho, share = theta
    z, g = table
    z1, z2 = np.interp(u1, g, z), np.interp(u2, g, z)
    a, b = (z1 - mu) / sigma, (z2 - mu) / sigma
    signal = -(a * a - 2 * rho * a * b + b * b) / (2 * (1 - rho * rho)) - 2 * math.log(sigma) - 0.5 * math.log(1 - rho * rho)
    noise = -(z1 * z1 + z2 * z2) / 2
    w = 1 / (1 + (1 - share) / share * np.exp(np.clip(noise - signal, -700, 700)))
    return z1, z2, w


def _columns(b: pa.RecordBatch, *at: int) -> tuple[np.ndarray, ...]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False) for i in at)


def _statistics(theta: tuple[float, ...], table: tuple[np.ndarray, np.ndarray]):
    """A task's sums over (u1, u2): rows, w, w z1 + w z2, w z1**2 + w z2**2, w z1 z2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5)
        for b in batches:
            z1, z2, w = _reproducible(*_columns(b, 0, 1), theta, table)
            total += (len(w), w.sum(), (w * (z1 + z2)).sum(), (w * (z1 * z1 + z2 * z2)).sum(), (w * z1 * z2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.tolist()], ["n", "w", "s", "q", "c"])

    return run


def next_step(n: float, w: float, s: float, q: float, c: float) -> tuple[float, ...]:
    """The parameters that fit the sums best."""
    mu = s / (2 * w)
    variance = (q - 2 * mu * s + 2 * w * mu * mu) / (2 * w)
    rho = (c - mu * s + w * mu * mu) / (w * variance) if variance > 0 else 0.0
    return tuple(min(max(v, lo), hi) for v, (lo, hi) in zip((mu, math.sqrt(max(variance, 0.0)), rho, w / n), BOUNDS, strict=True))


def fit_reproducibility(shares: DataFrame, rounds: int = 200, close: float = 1e-3) -> tuple[float, ...]:
    """(mean, deviation, correlation, share) of the two-component copula mixture of (u1, u2).

    Each round is one pass over the table that brings five sums back; it ends when no
    parameter moves by more than ``close``.
    """
    theta = START
    for _ in range(rounds):
        sums = shares.select("u1", "u2").mapInArrow(_statistics(theta, marginal_table(theta)), "n double, w double, s double, q double, c double")
        r = sums.agg(*(F.sum(x).alias(x) for x in "nwsqc")).first()
        if not r["n"] or not r["w"]:
            break
        new = next_step(*(r[x] for x in "nwsqc"))
        moved = max(abs(a - b) for a, b in zip(new, theta, strict=True))
        theta = new
        if moved <= close:
            break
    return theta


def _local(theta: tuple[float, ...], names: list[str]):
    table = marginal_table(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _reproducible(*_columns(b, len(names), len(names) + 1), theta, table)[2]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(1 - w)], [*names, "local_idr"])

    return run


def irreproducible_rate(scores: DataFrame, id_col: str, **how) -> DataFrame:
    """(id, s1, s2, local_idr, idr) of peaks scored by two replicates.

    Scores count by their ranks only (ties: in order of the id). local_idr is the chance that
    a peak belongs to what doesn't reproduce; idr, its mean over all peaks of this
    local_idr or less, is the rate of those among them. An empty table gives no rows.
    """
    ship(scores.sparkSession)
    rows = scores.select(id_col, F.col("s1").cast("double").alias("s1"), F.col("s2").cast("double").alias("s2"), F.lit(0).alias("all"))
    for i in (1, 2):
        rows = ranks(rows, ["all"], f"s{i}", [id_col], f"r{i}")
    n = scores.agg(F.count("*").alias("n"))
    share = lambda i: (F.col(f"r{i}") / (F.col("n") + 1)).alias(f"u{i}")
    shares = written(rows.crossJoin(F.broadcast(n)).select(id_col, "s1", "s2", share(1), share(2)), "idr")  # one row
    theta = fit_reproducibility(shares, **how)
    names = [id_col, "s1", "s2"]
    fields = ", ".join(f"`{c}` {shares.schema[c].dataType.simpleString()}" for c in names)
    local = written(shares.mapInArrow(_local(theta, names), f"{fields}, local_idr double"), "idr")
    at = standing(local, "local_idr").select(F.col("local_idr").alias("_at"), (F.col("sum_upto") / F.col("upto")).alias("idr"))
    return local.join(at, F.col("local_idr") == F.col("_at")).drop("_at")
