"""Session-level helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows that a task gets at most where a step holds all of its task's rows (sorts, hash tables).
TASK_ROWS = 1 << 20
#: Settings of Arrow batches: key, Spark's default, ours.
ARROW = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")]
#: Spark removes an execution's shuffle files when it ends, if this is set.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that all executors of this cluster share.

    The folder is what the session names in ``spark.checkpoint.dir``; only where
    that is unset and the master is this machine (tests) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandframe-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions within remove their shuffle files when they end; the setting is put back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, its shuffle files go."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark, purpose)
    with shuffles_removed(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of so many rows: some TASK_ROWS in each, however many there are; the
    session's number of partitions for fewer rows, and less for very few."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(usual, -(-16 * rows // TASK_ROWS)))


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a written table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fixed_order(df: DataFrame, purpose: str) -> DataFrame:
    """``df``, or a written copy where its plan has a shuffle.

    A task that runs again after a loss then sees the same rows in the same order.
    """
    return written(df, purpose) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Each name, or with underscores before it as far as ``df`` has a column of that name."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application.

    The sources (some 200 KB) go through Spark's own file server, so executors
    that join later or replace lost ones get them as well. Batches of text are kept
    small unless the session says otherwise: two workers share an executor's memory.
    """
    for key, default, ours in ARROW:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="strandframe-src-")) / f"strandframe_{os.getpid()}.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(where))
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the test data; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
