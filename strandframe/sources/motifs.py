"""Motif files: position matrices as text blocks, parsed with Spark expressions.

A motif is (name, consensus, score, nsites, m) with m one row of four numbers a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = r"^[ \t]*[0-9.eE+-]+([ \t]+[0-9.eE+-]+){3}[ \t]*$"


def _rows(lines: Column) -> Column:
    keep = F.filter(lines, lambda x: x.rlike(ROW))
    return F.transform(keep, lambda x: F.transform(F.split(F.trim(x), r"[ \t]+"), lambda v: v.cast("double")))


def consensus(m: Column) -> Column:
    """The likeliest letter of each place (first on ties)."""
    return F.array_join(F.transform(m, lambda r: F.element_at(F.array(*map(F.lit, "ACGT")), F.array_position(r, F.array_max(r)).cast("int"))), "")


def read_homer(spark: SparkSession, path: str) -> DataFrame:
    """Blocks '>consensus TAB name TAB score' and one line of four numbers a place."""
    block = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    head = F.split(F.get(lines, F.lit(0)), "\t")
    m = _rows(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    return block.select(F.get(head, F.lit(1)).alias("name"), F.get(head, F.lit(0)).alias("consensus"), F.get(head, F.lit(2)).cast("double").alias("score"), F.lit(None).cast("int").alias("nsites"), m.alias("m"))


def homer_text(motifs: DataFrame) -> DataFrame:
    """(value): the block of each motif, without its '>'."""
    rows = F.array_join(F.transform("m", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), "\t")), "\n")
    return motifs.select(F.concat(F.lit(">"), "consensus", F.lit("\t"), "name", F.lit("\t"), F.coalesce(F.col("score").cast("string"), F.lit("0.0")), F.lit("\n"), rows).alias("value"))


def write_homer(motifs: DataFrame, path: str) -> None:
    homer_text(motifs).write.text(path)


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """Blocks 'MOTIF name ...' with a 'letter-probability matrix: ... nsites= n' line."""
    block = spark.read.option("lineSep", "MOTIF ").text(path).where(F.col("value").contains("letter-probability matrix"))
    lines = F.split("value", "\r?\n")
    m = _rows(lines)
    return block.select(
        F.get(F.split(F.trim(F.get(lines, F.lit(0))), r"\s+"), F.lit(0)).alias("name"),
        consensus(m).alias("consensus"),
        F.lit(None).cast("double").alias("score"),
        F.regexp_extract("value", r"nsites= *(\d+)", 1).try_cast("int").alias("nsites"),
        m.alias("m"),
    )


def meme_to_homer(motifs: DataFrame, least_sites: int, score: float) -> DataFrame:
    """Motifs of at least so many sites, with the score that scanning shall use."""
    return motifs.where(F.col("nsites") >= least_sites).withColumn("score", F.lit(score))
