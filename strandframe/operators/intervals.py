"""Half-open intervals (chr, start, stop): windows, overlap joins, nearest, greedy sets.

Overlap joins get an equi key: both sides are cut into bins of ``width``, so Spark
hashes (chr, bin) and checks the overlap on what meets there. A pair is kept in the
bin where its overlap begins, so it appears once without a distinct. Touching
intervals do not overlap in joins, but do in the greedy selections.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.runtime import fresh_names

#: Length of the stretches of a chromosome that windows are run over.
SEGMENT = 1 << 18


def _segments(rows: DataFrame, at: str, segment: int) -> DataFrame:
    return rows.withColumn("_seg", F.floor(F.col(at) / segment))


def summit_window(peaks: DataFrame, half: int) -> DataFrame:
    """[start + peak - half, start + peak + half)"""
    at = F.col("start") + F.col("peak")
    return peaks.withColumn("_at", at).withColumn("start", F.col("_at") - half).withColumn("stop", F.col("_at") + half).drop("_at")


def tss_window(tss: DataFrame, padding: int, keep: list[str]) -> DataFrame:
    """TSS +- padding, sorted; padding 0 gives the point [tss, tss + 1)."""
    stop = F.col("tss") + (padding if padding else 1)
    return tss.select(*keep, "chr", (F.col("tss") - padding).alias("start"), stop.alias("stop")).orderBy("chr", "start", "stop", *keep)


def tagalign(pairs: DataFrame, keep: list[str], plus: int = 4, minus: int = 5) -> DataFrame:
    """Two reads of each pair, shifted at their 5' ends: + start by plus, - stop by minus."""
    two = pairs.select(*keep, F.expr("stack(2, chr1, start1, stop1, strand1, chr2, start2, stop2, strand2) as (chr, start, stop, strand)"))
    return two.select(*keep, "chr", F.when(F.col("strand") == "+", F.col("start") + plus).otherwise(F.col("start")).alias("start"), F.when(F.col("strand") == "-", F.col("stop") - minus).otherwise(F.col("stop")).alias("stop"), "strand")


def _bins(width: int) -> Column:
    last = F.greatest(F.col("stop") - 1, F.col("start"))
    return F.sequence(F.floor(F.col("start") / width), F.floor(last / width))


def overlap_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, width: int = 500) -> DataFrame:
    """(a_id, b_id) of overlapping intervals, each pair once."""
    x = a.select(F.col(a_id).alias("_a"), F.col("chr").alias("_c"), F.col("start").alias("_as"), F.col("stop").alias("_ae"), F.explode(_bins(width)).alias("_bin"))
    y = b.select(F.col(b_id).alias("_b"), F.col("chr").alias("_c"), F.col("start").alias("_bs"), F.col("stop").alias("_be"), F.explode(_bins(width)).alias("_bin"))
    meet = x.join(y, ["_c", "_bin"]).where("_as < _be and _bs < _ae").where(F.floor(F.greatest("_as", "_bs") / width) == F.col("_bin"))
    return meet.select(F.col("_a").alias(a_id), F.col("_b").alias(b_id))


def overlap_semi(a: DataFrame, b: DataFrame, a_id: str, width: int = 500) -> DataFrame:
    """Rows of a that overlap any row of b, each once."""
    return a.join(_hits(a, b, a_id, width), a_id, "left_semi")


def overlap_anti(a: DataFrame, b: DataFrame, a_id: str, width: int = 500) -> DataFrame:
    """Rows of a that overlap no row of b (not an anti-join of bins, which would be wrong)."""
    return a.join(_hits(a, b, a_id, width), a_id, "left_anti")


def _hits(a: DataFrame, b: DataFrame, a_id: str, width: int) -> DataFrame:
    x = a.select(F.col(a_id), F.col("chr").alias("_c"), F.col("start").alias("_as"), F.col("stop").alias("_ae"), F.explode(_bins(width)).alias("_bin"))
    y = b.select(F.col("chr").alias("_d"), F.col("start").alias("_bs"), F.col("stop").alias("_be"), F.explode(_bins(width)).alias("_ybin"))
    on = (F.col("_c") == F.col("_d")) & (F.col("_bin") == F.col("_ybin")) & (F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae"))
    return x.join(y, on, "left_semi").select(a_id)


def overlap_count(a: DataFrame, b: DataFrame, a_id: str, b_id: str, width: int = 500) -> DataFrame:
    """Each row of a with its number of overlapping rows of b, zeros kept."""
    n = overlap_pairs(a, b, a_id, b_id, width).groupBy(a_id).agg(F.count("*").alias("n"))
    return a.join(n, a_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, segment: int = SEGMENT) -> DataFrame:
    """(a_id, b_id, distance): for each row of a one nearest row of b on its chr.

    Distance is 0 for overlap, 1 for touching, null (with b_id null) where b has
    nothing on the chr. Ties go to the b that comes first by (start, stop, id). Both
    tables are sorted together and swept by windows; nothing is multiplied. For
    overlap it is enough that the running latest stop of b exceeds a's start; which b
    comes first is then found by a second sweep.
    """
    cols = lambda d, i, side: d.select(F.col("chr"), F.col("start"), F.col("stop"), F.col(i).cast("long").alias("id"), F.lit(side).alias("side"))
    both = cols(a, a_id, 1).unionByName(cols(b, b_id, 0))
    # Left of a's stop: every b that starts before a ends; the one of latest stop decides.
    at = _segments(both.withColumn("at", F.when(F.col("side") == 1, F.col("stop")).otherwise(F.col("start"))), "at", segment)
    b_left = F.when(F.col("side") == 0, F.struct("stop", (-F.col("start")).alias("ns"), (-F.col("id")).alias("ni")))
    b_right = F.when(F.col("side") == 0, F.struct("start", "stop", "id"))
    ends = at.groupBy("chr", "_seg").agg(F.max(b_left).alias("_l"), F.min(b_right).alias("_r"))
    up, down = Window.partitionBy("chr").orderBy("_seg"), Window.partitionBy("chr").orderBy(F.desc("_seg"))
    ends = ends.select("chr", "_seg", F.max("_l").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_l"), F.min("_r").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_r"))
    # What follows is what goes before in falling order: Spark works out a frame that ends at
    # the last row anew for each row.
    stretch, run = Window.partitionBy("chr", "_seg"), (Window.unboundedPreceding, Window.currentRow)
    # greatest and least pass over nulls, as max and min do.
    left = F.greatest(F.max(b_left).over(stretch.orderBy("at", F.col("side").desc()).rowsBetween(*run)), F.col("_l"))
    right = F.least(F.min(b_right).over(stretch.orderBy(F.desc("at"), "side").rowsBetween(*run)), F.col("_r"))
    rows = at.join(ends, ["chr", "_seg"]).withColumn("l", left).withColumn("r", right).where("side = 1")
    over = F.col("l.stop") > F.col("start")
    gap_l = F.col("start") - F.col("l.stop") + 1
    gap_r = F.col("r.start") - F.col("stop") + 1
    pick_left = F.col("l").isNotNull() & (F.col("r").isNull() | (gap_l <= gap_r))
    dist = F.when(over, F.lit(0).cast("long")).when(pick_left, gap_l).when(F.col("r").isNotNull(), gap_r)
    found = rows.select("id", "chr", "start", "stop", over.alias("over"), dist.alias("distance"), F.when(pick_left, -F.col("l.ni")).otherwise(F.col("r.id")).alias("near"))
    first = _first_overlap(found.where("over").select("id", "chr", "start", "stop"), cols(b, b_id, 0), segment)
    return found.join(first, "id", "left").select(F.col("id").alias(a_id), F.coalesce("first", "near").alias(b_id), "distance")


def _first_overlap(a: DataFrame, b: DataFrame, segment: int) -> DataFrame:
    """(id, first): for rows of a that overlap some b, the b that comes first by (start, stop, id).

    Of all b that stop beyond a place, the first is one whose stop exceeds every stop
    before it; these records stop in the order in which they start. So a's answer is the
    next record by stop after a's start.
    """
    over = Window.partitionBy("chr").orderBy("_seg")
    cut = _segments(b, "start", segment)
    reach = cut.groupBy("chr", "_seg").agg(F.max("stop").alias("_r")).select("chr", "_seg", F.max("_r").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"))
    by = Window.partitionBy("chr", "_seg").orderBy("start", "stop", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.max("stop").over(by), F.col("_reach"))
    records = cut.join(reach, ["chr", "_seg"]).withColumn("_before", before).where("_before is null or stop > _before")
    both = records.select("chr", F.col("stop").alias("at"), F.lit(1).alias("side"), "id").unionByName(a.select("chr", F.col("start").alias("at"), F.lit(0).alias("side"), "id"))
    both = _segments(both, "at", segment)
    record = F.when(F.col("side") == 1, F.struct("at", "id"))
    down = Window.partitionBy("chr").orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    later = both.groupBy("chr", "_seg").agg(F.min(record).alias("_n")).select("chr", "_seg", F.min("_n").over(down).alias("_next"))
    here = Window.partitionBy("chr", "_seg").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.join(later, ["chr", "_seg"]).withColumn("_f", F.least(F.min(record).over(here), F.col("_next")))
    return found.where("side = 0").select("id", F.col("_f.id").alias("first"))


def islands(rows: DataFrame, order: list[str], segment: int = SEGMENT) -> DataFrame:
    """Rows with ``island``: no interval of one island touches one of another.

    A new island begins where a start lies beyond every stop before it. All greedy
    selections restart there, so islands can be worked on apart. Windows run within
    stretches of a chromosome; what earlier stretches hand on (the latest stop, the
    islands so far) comes from a table with one row for each stretch.
    """
    cut = _segments(rows, "start", segment)
    over_segments = Window.partitionBy("chr").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.groupBy("chr", "_seg").agg(F.max("stop").alias("_reach"))
    reach = reach.select("chr", "_seg", F.max("_reach").over(over_segments).alias("_reach"))
    by = Window.partitionBy("chr", "_seg").orderBy("start", "stop", *order)
    past = F.greatest(F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    fresh = cut.join(reach, ["chr", "_seg"]).withColumn("_new", F.when(past.isNull() | (F.col("start") > past), 1).otherwise(0))
    begun = fresh.groupBy("chr", "_seg").agg(F.sum("_new").alias("_begun"))
    begun = begun.select("chr", "_seg", F.coalesce(F.sum("_begun").over(over_segments), F.lit(0)).alias("_begun"))
    number = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_begun")
    return fresh.join(begun, ["chr", "_seg"]).withColumn("island", number).select(*rows.columns, "island")


class _Greedy:
    """A greedy rule over intervals that come in order of start; ``kept`` are the chosen ones.

    Only the rows from the anchor on that start before it stops are held.
    """

    def __init__(self, rule: str) -> None:
        self.rule = rule
        self.group: list[tuple] = []  # (start, stop, q, mark)
        self.until = None
        self.kept: list = []

    def _close(self) -> None:
        """Choose of the anchor's group and leave what the rule passes over."""
        at = 0 if self.rule == "first" else max(range(len(self.group)), key=lambda j: (self.group[j][2], -j))
        best = self.group[at]
        self.kept.append(best[3])
        rest = self.group[at + 1 :] if self.rule == "pick" else []
        self.group = []
        if self.rule == "pick":
            self.until = best[1]
            for row in rest:
                self.add(*row)

    def add(self, start: int, stop: int, q: float, mark) -> None:
        if self.until is not None:
            if start <= self.until:
                return
            self.until = None
        while self.group and start > self.group[0][1]:
            self._close()
            if self.until is not None and start <= self.until:
                return
            self.until = None
        self.group.append((start, stop, q, mark))

    def end(self) -> None:
        while self.group:
            self._close()
        self.until = None


def _walk(starts: list[int], stops: list[int], q: list[float], rule: str) -> list[int]:
    """Indices that a greedy rule keeps of intervals in order of start."""
    walk = _Greedy(rule)
    for i, row in enumerate(zip(starts, stops, q, strict=True)):
        walk.add(*row, i)
    walk.end()
    return walk.kept


def greedy(rows: DataFrame, rule: str, order: list[str]) -> DataFrame:
    """A selection of intervals, worked out island by island.

    From an anchor (the first row left) its group is every following row that starts
    no later than the anchor stops.
    "pick": keep the group's best q (first on ties); go on behind it. Disjoint.
    "group": keep the group's best q; go on behind the group. May overlap.
    "first": keep the anchor; go on behind the group. Disjoint.

    A task gets whole islands, sorted, and walks over all of them in one pass; it holds
    an anchor's group, however long the island is.
    """
    if rule not in ("pick", "group", "first"):
        raise ValueError(f"rule {rule!r}")
    marked = islands(rows, order)
    alone = Window.partitionBy("chr", "island")
    marked = marked.withColumn("_size", F.count("*").over(alone))
    names = rows.columns
    place = {c: i for i, c in enumerate([*names, "island"])}

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now, held = _Greedy(rule), None, {}
        for n, b in enumerate(batches):
            held[n] = b
            cols = (b.column(place[c]).to_pylist() for c in ("chr", "island", "start", "stop", "q"))
            for i, (c, island, start, stop, q) in enumerate(zip(*cols, strict=True)):
                if (c, island) != now:
                    walk.end()
                    now = (c, island)
                walk.add(start, stop, float("-inf") if q is None else q, (n, i))
            yield from chosen(walk, held, n)
        walk.end()
        yield from chosen(walk, held, None)

    def chosen(walk: _Greedy, held: dict[int, pa.RecordBatch], last: int | None) -> Iterator[pa.RecordBatch]:
        """What is kept so far; batches that no open group has rows of are let go."""
        by: dict[int, list[int]] = {}
        for n, i in walk.kept:
            by.setdefault(n, []).append(i)
        walk.kept = []
        for n, at in by.items():
            yield held[n].select(names).take(pa.array(at))
        first = min([x[3][0] for x in walk.group], default=last)
        for n in [n for n in held if first is not None and n < first]:
            del held[n]

    # Rows that nothing touches need no Python.
    single = marked.where("_size = 1").select(*names)
    several = marked.where("_size > 1").select(*names, "island").repartition("chr", "island").sortWithinPartitions("chr", "island", "start", "stop", *order)
    return single.unionByName(several.mapInArrow(select, rows.schema))


def mark_duplicates(reads: DataFrame, key: list[str], quality: str, read_id: str) -> DataFrame:
    """``reads`` with ``duplicate``: whether a read of the same key is better (ties: of lesser id).

    The best of each key is a partial minimum, so a key of very many reads is never sorted.
    A null quality is worse than any; ids are of any type that can be ordered. A read with a
    null in its key has no place to share: it stays and is a duplicate of none. Rows of the
    best read's id are not duplicates of each other.
    """
    (best,) = fresh_names(reads, "_best")
    names = fresh_names(reads, *(f"_key{i}" for i in range(len(key))))
    rank = F.struct(-F.coalesce(F.col(quality).cast("double"), F.lit(float("-inf"))), F.col(read_id).isNull(), F.col(read_id).alias("id"))
    first = reads.groupBy(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).agg(F.min(rank).alias(best))
    met = reads.join(first, [F.col(k) == F.col(n) for k, n in zip(key, names, strict=True)], "left")
    same = F.col(read_id).eqNullSafe(F.col(f"{best}.id"))
    return met.select(*reads.columns, (F.col(best).isNotNull() & ~same).alias("duplicate"))


def pair_ends(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chr, five, strand of reads 1 and 2) with ``ends``: both 5' ends and strands, the lesser
    first, so that it doesn't matter which mate was read first. Null if a part is null."""
    one, two = (F.struct(F.col(f"chr{n}").alias("chr"), F.col(f"five{n}").alias("five"), F.col(f"strand{n}").alias("strand")) for n in (1, 2))
    known = F.lit(True)
    for n in (1, 2):
        for c in ("chr", "five", "strand"):
            known = known & F.col(f"{c}{n}").isNotNull()
    return pairs.withColumn("ends", F.when(known, F.array_sort(F.array(one, two))))


def presence(windows: DataFrame, peaks: DataFrame, window_id: str, samples: list, width: int = 500) -> DataFrame:
    """One row for each window, one 0/1 column for each sample that has a peak there.

    Equal places meet once: windows by place, peaks by place with the samples seen there.
    """
    at = F.struct("chr", "start", "stop")
    places = windows.select("chr", "start", "stop").distinct().withColumn("_w", at)
    held = peaks.groupBy("chr", "start", "stop").agg(F.collect_set("sample").alias("_p"))
    there = lambda s: F.max(F.array_contains("_p", s).cast("int")).alias(f"s{s}")
    seen = overlap_pairs(places, held, "_w", "_p", width).groupBy("_w").agg(*map(there, samples))
    seen = seen.select(*(F.col(f"_w.{c}").alias(c) for c in ("chr", "start", "stop")), *(f"s{s}" for s in samples))
    out = windows.select(window_id, "chr", "start", "stop").join(seen, ["chr", "start", "stop"], "left")
    return out.select(window_id, *(F.coalesce(f"s{s}", F.lit(0)).alias(f"s{s}") for s in samples))


def blacklist_union(*parts: DataFrame) -> DataFrame:
    """All intervals of all lists, neither merged nor made distinct, sorted."""
    out = parts[0].select("chr", "start", "stop")
    for p in parts[1:]:
        out = out.unionByName(p.select("chr", "start", "stop"))
    return out.orderBy("chr", "start", "stop")
