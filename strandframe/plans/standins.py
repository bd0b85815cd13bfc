"""Genomic tables read off the star-schema test tables, in Spark and in SQL.

peaks   events: chr = event_type, 500 wide windows around the second of ts, q = value
cells   part x nation of the ordering customer: x = 1 where more than one line item
bits    embeddings: x = 1 where a component is positive; row cluster = label
tree    heap tree on the nations: parent(v) = (v - 1) div 2
dna     documents' letters, folded onto ACGT, whole
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.runtime import read_table, tasks_for

N_COLS = 25
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(F.col("event_id").alias("ord"), F.col("event_type").alias("chr"), (at - 250).alias("start"), (at + 250).alias("stop"), F.col("value").alias("q"), (F.col("user_id") % 10).alias("sample"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, col_id, n): line items of a part by nation of the customer; only n > 0.

    Line items meet orders, and are counted, in as many tasks as they need: most pairs of part
    and nation are seen once in a task, so a task's table of counts grows with its rows.
    Customers are small beside orders; nothing is broadcast by hand, so Spark's size
    threshold decides.
    """
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    tasks = tasks_for(spark, li.count())
    nation = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey").repartition(tasks, "o_orderkey")
    met = li.repartition(tasks, "l_orderkey").join(nation, li.l_orderkey == nation.o_orderkey)
    named = met.select(F.col("l_partkey").alias("row_id"), F.col("c_nationkey").alias("col_id")).repartition(tasks, "row_id", "col_id")
    return named.groupBy("row_id", "col_id").agg(F.count("*").alias("n"))


def ones(spark: SparkSession, sf: str) -> DataFrame:
    """The 1 cells of ``cells``, sparse: (row_id, col_id)."""
    return counts(spark, sf).where("n > 1").select("row_id", "col_id")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The whole matrix in long form: (row_id, col_id, x). One shuffle by row."""
    held = counts(spark, sf).groupBy("row_id").agg(F.collect_list(F.when(F.col("n") > 1, F.col("col_id"))).alias("on"))
    every = F.transform(F.sequence(F.lit(0), F.lit(N_COLS - 1)), lambda c: F.struct(c.alias("col_id"), F.array_contains("on", c).cast("int").alias("x")))
    return held.select("row_id", F.inline(every))


def bits(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, col_id, x, cluster) of the embeddings' signs."""
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster"), F.posexplode("embedding").alias("col_id", "v")).select("row_id", "col_id", (F.col("v") > 0).cast("int").alias("x"), "cluster")


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """(v, parent, name); the root's parent is null."""
    n = read_table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("v"), F.when(F.col("n_nationkey") > 0, F.expr("(n_nationkey - 1) div 2")).cast("int").alias("parent"), F.col("n_name").alias("name"))


def dna(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, seq)"""
    d = read_table(spark, sf, "documents")
    folded = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES)
    return d.select(F.col("doc_id").alias("row_id"), folded.alias("seq"))


#: The same tables in SQL.
VIEWS = {
    "peaks": "SELECT event_id AS ord, event_type AS chr, CAST(floor(epoch(ts)) AS BIGINT) - 250 AS start, CAST(floor(epoch(ts)) AS BIGINT) + 250 AS stop, value AS q, user_id % 10 AS sample FROM events",
    "counts": "SELECT l_partkey AS row_id, c_nationkey AS col_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "cells": "SELECT r.row_id, CAST(k.col_id AS INTEGER) AS col_id, CAST(coalesce(c.n, 0) > 1 AS INTEGER) AS x FROM (SELECT DISTINCT row_id FROM counts) r CROSS JOIN (SELECT unnest(range(25)) AS col_id) k LEFT JOIN counts c ON c.row_id = r.row_id AND c.col_id = k.col_id",
    "bits": "SELECT row_id, CAST(i AS INTEGER) AS col_id, CAST(embedding[i + 1] > 0 AS INTEGER) AS x, cluster FROM (SELECT vec_id AS row_id, label AS cluster, embedding, unnest(range(64)) AS i FROM embeddings)",
    "tree": "SELECT n_nationkey AS v, CASE WHEN n_nationkey > 0 THEN CAST((n_nationkey - 1) // 2 AS INTEGER) END AS parent, n_name AS name FROM nation",
    "dna": f"SELECT doc_id AS row_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents",
}
_NEEDS = {"cells": ["counts"]}


def sql(views: str, body: str) -> str:
    """``body`` with the named stand-ins (and what they need) in front of it."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    body = body.strip()
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
