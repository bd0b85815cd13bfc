"""Binary matrices in long form (row_id, col_id, x), never wider than a row of bits.

Rows are identified by ``row_id``; there are no positions. Column statistics of row
clusters (n, sum) are all that later searches need: for 0/1 cells sum(x*x) = sum(x).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row_id").agg(F.sum("x").cast("long").alias("ones"))


def drop_zero_rows(cells: DataFrame) -> DataFrame:
    """(row_id, ones) of rows with any 1; ids stay what they were."""
    return row_sums(cells).where("ones > 0")


def to_wide(cells: DataFrame, columns: list, prefix: str = "") -> DataFrame:
    """One column for each of ``columns``, which are given, so no pass looks for them."""
    wide = cells.groupBy("row_id").pivot("col_id", columns).agg(F.first("x"))
    return wide.select("row_id", *(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns))


def to_long(wide: DataFrame, id_cols: list[str], columns: list[str]) -> DataFrame:
    return wide.unpivot(id_cols, columns, "col_id", "x")


def align_columns(wide: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Select ``keep`` and then ``order``; all missing names are told at once."""
    missing = [c for c in order if c not in wide.columns]
    if missing:
        raise ValueError(f"columns not in the matrix: {missing}")
    return wide.select(*keep, *order)


def pack(cells: DataFrame, n_cols: int) -> DataFrame:
    """(row_id, ones, bits): rows as arrays of longs, 63 columns in each (no sign bit)."""
    words = -(-n_cols // 63)
    word = lambda w: F.sum(F.when((F.col("col_id") >= 63 * w) & (F.col("col_id") < 63 * (w + 1)) & (F.col("x") == 1), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("col_id") - 63 * w).cast("int"))).otherwise(F.lit(0).cast("long")))
    return cells.groupBy("row_id").agg(F.sum("x").cast("int").alias("ones"), F.array(*(word(w) for w in range(words))).alias("bits"))


def slice_rows(cells: DataFrame, clusters: DataFrame, cluster: int) -> DataFrame:
    """Cells of the rows that ``clusters`` (row_id, cluster) puts into ``cluster``."""
    return cells.join(clusters.where(F.col("cluster") == cluster), "row_id")


def complement_rows(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return rows.join(taken, key, "left_anti")


def default_assign(rows: DataFrame, values: DataFrame, key: str, column: str, default: int) -> DataFrame:
    """Every row with its value, or the default."""
    return rows.join(values, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def column_means(cells: DataFrame) -> DataFrame:
    """(cluster, col_id, freq)"""
    return cells.groupBy("cluster", "col_id").agg(F.avg("x").alias("freq"))


def column_stats(cells: DataFrame) -> DataFrame:
    """The sufficient statistics: (cluster, col_id, n, s)."""
    return cells.groupBy("cluster", "col_id").agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("s"))


def block_stats(stats: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster, k, n, s): statistics of blocks of row cluster and column cluster."""
    return stats.join(assignment, "col_id").groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def block_means(stats: DataFrame, assignment: DataFrame) -> DataFrame:
    return block_stats(stats, assignment).select("cluster", "k", "n", (F.col("s") / F.col("n")).alias("mean"))


def sse(blocks: DataFrame) -> DataFrame:
    """Residual of a 0/1 matrix around its block means: sum of s - s*s/n."""
    return blocks.agg(F.sum(F.col("s") - F.col("s") * F.col("s") / F.col("n")).alias("sse"))


def on_off_split(values: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Exact 2-means in one dimension: label 1 for the upper side of the best split.

    Sorted values and their prefix sums give every split's squared error; the first of
    the best splits is taken. A group of equal values is all 1 if its mean is over
    one half, else all 0; there is no random start.
    """
    by = Window.partitionBy(*group)
    up = by.orderBy(value, *order)
    run = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(value)
    t = values.withColumn("_i", F.row_number().over(up)).withColumn("_s", F.sum(v).over(run)).withColumn("_q", F.sum(v * v).over(run))
    t = t.withColumn("_n", F.count("*").over(by)).withColumn("_sum", F.sum(v).over(by)).withColumn("_sumsq", F.sum(v * v).over(by))
    left = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_i")
    rest = F.col("_n") - F.col("_i")
    right = (F.col("_sumsq") - F.col("_q")) - (F.col("_sum") - F.col("_s")) * (F.col("_sum") - F.col("_s")) / rest
    t = t.withColumn("_e", F.when(rest > 0, F.round(left + right, 9)))
    cut = F.min(F.when(F.col("_e").isNotNull(), F.struct("_e", "_i"))).over(by)
    t = t.withColumn("_cut", cut["_i"])
    spread = F.max(v).over(by) > F.min(v).over(by)
    label = F.when(spread, (F.col("_i") > F.col("_cut")).cast("int")).otherwise((F.col("_sum") / F.col("_n") > 0.5).cast("int"))
    return t.withColumn("on", label).select(*values.columns, "on")


def majority(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """1 where more than half of a group's values are 1; a tie is 0."""
    return values.groupBy(*group).agg((F.avg(value) > 0.5).cast("int").alias("vote"))


def spread_means(cells: DataFrame, blocks: DataFrame, assignment: DataFrame, value: Column) -> DataFrame:
    """Each (cluster, col_id) with a value of its block: maps for display."""
    return cells.select("cluster", "col_id").distinct().join(assignment, "col_id").join(blocks.select("cluster", "k", value.alias("value")), ["cluster", "k"])


def dense_ids(values: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """Distinct values with n = 0, 1, ... in their order.

    Values are ranged into buckets by sampled quantiles; ranks within buckets plus the
    rows of earlier buckets give the number, so no task sorts them all.
    """
    probs = [i / buckets for i in range(1, buckets)]
    q = values.agg(F.percentile_approx(column, F.lit(probs), F.lit(10_000)).alias("q")).first().q or []
    cuts = sorted(set(q))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column)))
    held = values.withColumn("_b", bucket)
    sizes = held.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return held.join(F.broadcast(sizes), "_b").withColumn("n", rank + F.col("_before")).select(*values.columns, "n")


def densify(cells: DataFrame, rows: DataFrame, n_cols: int) -> DataFrame:
    """Every cell of the given rows (row_id); those not in ``cells`` are 0."""
    on = cells.where("x = 1").groupBy("row_id").agg(F.collect_set("col_id").alias("_on"))
    held = rows.join(on, "row_id", "left").withColumn("_on", F.coalesce("_on", F.array().cast("array<int>")))
    every = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda c: F.struct(c.alias("col_id"), F.array_contains("_on", c).cast("int").alias("x")))
    return held.select("row_id", F.inline(every))
