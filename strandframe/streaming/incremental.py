"""Incremental runs: process what has arrived and is not yet done.

A file-source stream hands over new files in micro-batches; each batch is cleared of
finished keys, worked on, and appended together with its keys. The checkpoint and the
anti-join make a rerun harmless: a batch that failed half-way is done again, its keys
that were written are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.operators.control import exists, pending


def process_new(spark: SparkSession, source: str, schema: T.StructType, key: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 100) -> int:
    """Run ``work`` over rows below ``source`` whose key is not in ``sink``; the batches run."""
    ran = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal ran
        others = [c for c in rows.columns if c != key]
        # Of rows with one key the least stays, whatever the order of arrival.
        todo = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, *(F.col(f"_r.`{c}`").alias(c) for c in others)).select(*rows.columns) if others else rows.distinct()
        if exists(spark, f"{sink}/_SUCCESS"):
            done = spark.read.parquet(sink).select(key).distinct()
            todo = pending(todo, done, key)
        work(todo).write.mode("append").parquet(sink)
        ran += 1

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return ran
