"""Pipeline control: memoised stages, pending work, batches, guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class Stages:
    """Stages kept as Parquet: one with its _SUCCESS marker is read, not made again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.made = spark, root.rstrip("/"), []

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def finished_names(files: DataFrame, pattern: str) -> DataFrame:
    """(item): the exact keys that file names carry; other files are ignored."""
    return files.select(F.regexp_extract("name", pattern, 1).alias("item")).where("item <> ''").distinct()


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done, key, "left_anti")


def batches(items: DataFrame, size: int, key: str) -> DataFrame:
    """Items with ``batch``: runs of ``size`` in order of key."""
    from strandframe.operators.matrix import dense_ids

    return dense_ids(items, key).withColumn("batch", F.floor(F.col("n") / size)).drop("n")


def scatter(items: DataFrame, shards: int, work: Callable, schema: str) -> DataFrame:
    """One shard for each task, gathered as one table."""
    return items.repartition(shards).mapInPandas(work, schema)


def same_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, differ): rows of both by position i, and how many positions differ in v."""
    both = a.select("i", F.col("v").alias("x"), F.lit(1).alias("in_a")).join(b.select("i", F.col("v").alias("y"), F.lit(1).alias("in_b")), "i", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y")) | F.col("in_a").isNull() | F.col("in_b").isNull()).alias("differ"))


def guard_equal_counts(a: DataFrame, b: DataFrame, what: str) -> None:
    """Raise where two tables that must have as many rows do not."""
    x, y = a.count(), b.count()
    if x != y:
        raise ValueError(f"{what}: {x} and {y} rows")


def require(df: DataFrame, condition, message: str) -> DataFrame:
    """Rows pass; the job fails at the first that does not meet the condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
