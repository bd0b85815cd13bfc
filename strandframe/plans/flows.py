"""E: whole workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.plans import standins as S
from strandframe.plans.orders import greedy_sql
from strandframe.plans.registry import query
from strandframe.plans.standins import VIEWS
from strandframe.plans.statistics import nation_tree
from strandframe.plans.workflow import Workflow, master_presence
from strandframe.runtime import read_table, shared_dir
from strandframe.streaming.incremental import process_new


_PRESENT = ", ".join(f"CAST(coalesce(max(CASE WHEN p.sample = {s} THEN 1 END), 0) AS INTEGER) AS s{s}" for s in range(10))


@query("E1_master_presence", f"SELECT w.ord, {_PRESENT} FROM ({greedy_sql('pick')}) w LEFT JOIN ({VIEWS['peaks']}) p ON p.chr = w.chr AND p.start < w.stop AND w.start < p.stop GROUP BY w.ord")
def e1(spark, sf):
    return master_presence(spark, sf)


@query("E2_biclusters")
def e2(spark, sf):
    """Edges, row clusters, column clusters: (k, residual, assignment)."""
    from strandframe.operators import cluster as cl

    flow = Workflow(spark, shared_dir(spark, "workflow"), S.cells(spark, sf), nation_tree(spark, sf), fdr=0.2, min_size=2)
    flow.starting_points()
    return cl.best_fits(flow.fits())


@query("E3_incremental", "SELECT c_custkey, c_nationkey * 2 AS twice FROM customer")
def e3(spark, sf):
    """Customers arrive in two loads, the second with old ones again."""
    root = shared_dir(spark, "incremental")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    work = lambda d: d.select("c_custkey", (F.col("c_nationkey") * 2).alias("twice"))
    for part in (c.where("c_custkey % 2 = 0"), c):
        part.write.mode("append").parquet(f"{root}/in")
        process_new(spark, f"{root}/in", c.schema, "c_custkey", work, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")
