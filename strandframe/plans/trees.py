"""G and C: trees, and searches for clusters of their vertices. L: pipeline control."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandframe.operators import cluster as cl
from strandframe.operators import control
from strandframe.operators import graph as gr
from strandframe.operators import matrix as mx
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.plans.statistics import KS, STARTS, nation_table, nation_tree
from strandframe.runtime import read_table, shared_dir

_EDGES = "e AS (SELECT parent, v AS child FROM tree WHERE parent IS NOT NULL)"
_CLOSED = _EDGES + ", c AS (SELECT v AS ancestor, v, 0 AS depth FROM tree UNION ALL SELECT c.ancestor, e.child, c.depth + 1 FROM c JOIN e ON e.parent = c.v)"


def _edges(spark, sf):
    return S.tree(spark, sf).where("parent is not null").select("parent", F.col("v").alias("child"))


@query("G1_descendants", sql("tree", f"WITH RECURSIVE {_CLOSED} SELECT v, CAST(depth AS INTEGER) AS depth FROM c WHERE ancestor = 1"))
def g1(spark, sf):
    return gr.descendants(spark, _edges(spark, sf), 1)


@query("G1b_closure", sql("tree", f"WITH RECURSIVE {_CLOSED} SELECT ancestor, v, CAST(depth AS INTEGER) AS depth FROM c"))
def g1b(spark, sf):
    return gr.closure(spark, _edges(spark, sf))


@query("G2_induced", sql("tree", f"WITH {_EDGES} SELECT parent, child FROM e WHERE parent % 3 <> 1 AND child % 3 <> 1"))
def g2(spark, sf):
    return gr.induced(_edges(spark, sf), S.tree(spark, sf).where("v % 3 <> 1").select("v"))


@query("G3_root", sql("tree", "SELECT v FROM tree WHERE parent IS NULL"))
def g3(spark, sf):
    return gr.roots(_edges(spark, sf))


@query("G4_tree_info", sql("tree", f"WITH RECURSIVE {_CLOSED} SELECT c.ancestor AS v, count(*) AS n_descendants, (SELECT count(*) FROM e WHERE e.parent = c.ancestor) AS n_children, NOT EXISTS (SELECT 1 FROM e WHERE e.parent = c.ancestor) AS is_leaf FROM c GROUP BY c.ancestor"))
def g4(spark, sf):
    e = _edges(spark, sf)
    return gr.tree_info(e, gr.closure(spark, e)).select("v", "n_descendants", "n_children", "is_leaf")


_CUTS = [(0, 3), (1, 9), (1, 10), (2, 5)]


@query("G5_components", sql("tree", f"WITH RECURSIVE {_CLOSED}, k(grp, child) AS (VALUES {', '.join(map(str, _CUTS))}), g AS (SELECT c.v, arg_min(k.grp, c.depth) AS grp FROM c JOIN k ON k.child = c.ancestor GROUP BY c.v), m AS (SELECT tree.v, coalesce(g.grp, -1) AS grp FROM tree LEFT JOIN g USING (v)), f AS (SELECT grp, row_number() OVER (ORDER BY min(v)) - 1 AS component FROM m GROUP BY grp) SELECT m.v, CAST(f.component AS INTEGER) AS component FROM m JOIN f USING (grp)"))
def g5(spark, sf):
    cuts = spark.createDataFrame(_CUTS, "grp int, child int")
    return gr.components_under_cuts(gr.closure(spark, _edges(spark, sf)), cuts, S.tree(spark, sf))


@query("G6_cut_edges", sql("tree", f"WITH {_EDGES} SELECT CAST(child % 4 AS INTEGER) AS cluster, parent, child FROM e WHERE child % 4 >= 1 AND child % 4 <> parent % 4"))
def g6(spark, sf):
    return gr.cut_edges(_edges(spark, sf), S.tree(spark, sf).select("v", (F.col("v") % 4).alias("cluster")))


_QUALIFIED = f"{_CLOSED}, d AS (SELECT ancestor AS v, count(*) - 1 AS below FROM c GROUP BY 1), q AS (SELECT d.v FROM d LEFT JOIN e ON e.child = d.v WHERE e.parent IS NULL OR (d.below > 1 AND (SELECT count(*) FROM e f WHERE f.parent = e.parent) > 1))"


@query("G7_qualified", sql("tree", f"WITH RECURSIVE {_QUALIFIED} SELECT v FROM q"))
def g7(spark, sf):
    e = _edges(spark, sf)
    return gr.qualified(e, gr.closure(spark, e))


@query("G8_cut_choices", sql("tree", f"WITH RECURSIVE {_QUALIFIED}, w AS (SELECT v FROM q WHERE v > 0) SELECT a.v AS a, b.v AS b, c2.v AS c FROM w a JOIN w b ON a.v < b.v JOIN w c2 ON b.v < c2.v"))
def g8(spark, sf):
    found = cl.scored_cuts(spark, nation_tree(spark, sf), nation_table(spark, sf), 4)
    return found.select(F.array_sort("combo").alias("x")).select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))


@query("G10_neighbours", sql("tree", f"WITH {_EDGES} SELECT t.v, coalesce(t.parent, -1) AS before, count(e.child) AS after FROM tree t LEFT JOIN e ON e.parent = t.v GROUP BY t.v, t.parent"))
def g10(spark, sf):
    t = S.tree(spark, sf)
    kids = _edges(spark, sf).groupBy(F.col("parent").alias("v")).agg(F.count("*").alias("after"))
    return t.join(kids, "v", "left").select("v", F.coalesce("parent", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("C1_random_starts")
def c1(spark, sf):
    return cl.random_starts(spark, nation_tree(spark, sf), nation_table(spark, sf), KS, STARTS)


@query("C2_C5_local_search")
def c5(spark, sf):
    """Regrouping, carrying, first improvement and descent, from each random start."""
    tree, table = nation_tree(spark, sf), nation_table(spark, sf)
    return cl.fits(cl.random_starts(spark, tree, table, KS, STARTS), tree, table)


@query(
    "C6_scored_cuts",
    sql("cells tree", f"WITH RECURSIVE {_QUALIFIED}, t AS (SELECT row_id % 3 AS cluster, col_id, count(*) AS n, sum(x) AS s FROM cells GROUP BY 1, 2), l AS (SELECT q.v AS cut, t.cluster, c.ancestor IS NOT NULL AS inside, sum(t.n) AS n, sum(t.s) AS s FROM q CROSS JOIN t LEFT JOIN c ON c.ancestor = q.v AND c.v = t.col_id WHERE q.v > 0 GROUP BY ALL) SELECT CAST(cut AS INTEGER) AS cut, round(CAST(sum(s - s * s / CAST(n AS DOUBLE)) AS DOUBLE), 4) AS residual FROM l GROUP BY cut"),
)
def c6(spark, sf):
    found = cl.scored_cuts(spark, nation_tree(spark, sf), nation_table(spark, sf), 2)
    return found.select(F.col("combo")[0].alias("cut"), F.round("residual", 4).alias("residual"))


@query("C6_diverse_starts")
def c6_diverse(spark, sf):
    return cl.smart_starts(spark, nation_tree(spark, sf), nation_table(spark, sf), KS, STARTS)


@query("C7_parallel_restarts")
def c7(spark, sf):
    tree, table = nation_tree(spark, sf), nation_table(spark, sf)
    starts = cl.random_starts(spark, tree, table, KS, STARTS).unionByName(cl.smart_starts(spark, tree, table, KS, STARTS))
    return cl.fits(starts, tree, table)


@query("C8_column_gram", sql("cells", "SELECT a.col_id AS c1, b.col_id AS c2, count(*) AS n FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.x = 1 AND b.x = 1 GROUP BY 1, 2"))
def c8(spark, sf):
    return cl.gram_table(S.cells(spark, sf))


def _linked(spark, sf, k: int) -> np.ndarray:
    return cl.complete_linkage(cl.gram_matrix(S.cells(spark, sf), S.N_COLS), k)


@query("C8b_hierarchical")
def c8b(spark, sf):
    return spark.createDataFrame(list(enumerate(map(int, _linked(spark, sf, 5)))), "col_id int, k int")


@query("C9_scalar_kmeans")
def c9(spark, sf):
    labels, _ = cl.scalar_kmeans(nation_table(spark, sf), _linked(spark, sf, 5))
    return spark.createDataFrame(list(enumerate(map(int, labels))), "col_id int, k int")


@query("C10_k_sweep")
def c10(spark, sf):
    tree, table = nation_tree(spark, sf), nation_table(spark, sf)
    starts = cl.random_starts(spark, tree, table, KS, STARTS).unionByName(cl.smart_starts(spark, tree, table, KS, STARTS))
    return cl.fits(starts, tree, table)


@query("C11_best_fit")
def c11(spark, sf):
    tree, table = nation_tree(spark, sf), nation_table(spark, sf)
    return cl.best_fits(cl.fits(cl.random_starts(spark, tree, table, KS, STARTS), tree, table))


@query("L1_memoised_stage", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def l1(spark, sf):
    stages = control.Stages(spark, shared_dir(spark, "stages"))
    make = lambda: read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    stages.stage("counts", make)
    again = stages.stage("counts", make)
    if stages.made != ["counts"]:
        raise RuntimeError("the stage was made twice")
    return again


@query("L2_skip_finished", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def l2(spark, sf):
    return control.pending(read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id")


@query("L3_scatter_gather", "SELECT n_nationkey AS id, length(n_name) AS size FROM nation")
def l3(spark, sf):
    def work(batches):
        for b in batches:
            yield b.assign(size=b["n_name"].str.len())[["id", "size"]]

    items = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return control.scatter(items, 4, work, "id int, size long")


@query("L4_branch_on_replicates", "SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN 'pseudo' ELSE 'pooled' END AS mode FROM conversations")
def l4(spark, sf):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("conv_id"))
    return read_table(spark, sf, "conversations").select("conv_id", "turn", F.when(n == 1, "pseudo").otherwise("pooled").alias("mode"))


@query("L5_workflow_grid", sql("cells", "SELECT g AS least, count(*) AS rows_kept FROM (SELECT unnest([2, 6, 10]) AS g) JOIN (SELECT row_id, sum(x) AS ones FROM cells GROUP BY row_id) ON ones >= g GROUP BY g"))
def l5(spark, sf):
    o = mx.row_sums(S.cells(spark, sf)).withColumn("least", F.explode(F.array(*map(F.lit, (2, 6, 10)))))
    return o.where("ones >= least").groupBy("least").agg(F.count("*").alias("rows_kept"))


@query("L6_guards", "SELECT count(*) AS n FROM orders WHERE o_totalprice >= 0")
def l6(spark, sf):
    o = read_table(spark, sf, "orders")
    return control.require(o, F.col("o_totalprice") >= 0, "a negative price").agg(F.count("*").alias("n"))
