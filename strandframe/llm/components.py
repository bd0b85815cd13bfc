"""Connected components of a link table, distributed.

Local spanning forests first (each task drops links that its others imply), then
rounds of large-star and small-star until nothing changes. A hub's links are met by
a partial minimum and a join that AQE may split, never gathered. Each round is cut
off by ``checkpoint()`` in the folder all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.runtime import shared_dir


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def forest(batches: Iterator[pa.RecordBatch], flush: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task reduced to (node, least node it is linked with here)."""
    parent: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        nodes = [x for x in parent if _find(parent, x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = _find(parent, a), _find(parent, b)
            lo, hi = (x, y) if x < y else (y, x)
            parent.setdefault(lo, lo)
            parent[hi] = lo
        if len(parent) > flush:
            yield out()
            parent.clear()
    if parent:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the least node of its component. ``links``: a, b (longs).

    Nodes without links are not listed. Repeated links and loops do no harm; an empty
    table gives an empty result.
    """
    spark = links.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared_dir(spark, "components")
    edges = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(forest, "a long, b long").distinct()
    edges = edges.checkpoint()
    before = None
    while True:
        # Large-star: every greater neighbour of a node goes to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small-star: a node and its lesser neighbours go to the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a")), F.struct(F.col("b").alias("a")))).alias("s"), "m")
        edges = small.select(F.col("s.a").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now


def as_numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
