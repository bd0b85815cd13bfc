"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder in shared storage:

    data/<load>/_shard_arrival=<n>/part-*.parquet   shards as they arrived
    data/run-<id>/part-*.parquet                    merged runs, files of about target size
    manifest/v<k>.json                              the runs that version k consists of

Nothing that a manifest names is ever changed. A version becomes current by the
rename of a finished file to ``manifest/v<k>.json``; a reader sees version k or k-1
and never a mixture. Before that a writer claims the version with a token of its own.
A job that dies leaves files that no manifest names (``vacuum`` removes them once they
are older than its grace time) and at most a claim, which the next writer takes over
once it is older than ``lease_seconds``; so the job can simply run again.

Sizes are logical (UTF-8 bytes of the payload), so that layout does not depend on
a compressor. A run of s bytes lies in tier 0 below ``base_bytes`` and in tier k
up to ``base_bytes * fanout**k``. A merge takes ``fanout`` runs next to each other
(in order of arrival) of one tier; the rest of a tier waits. Merges go up tier by
tier until no tier holds ``fanout`` runs; as a merge only feeds a tier above, one
sweep upwards ends. Each row is rewritten at most once a tier: log_fanout(N) times.

Only DataFrame operations touch rows: a merge reads its runs, packs splits to
target size without a shuffle, and writes. What the driver holds is the manifest,
one row a run, of which there are at most ``fanout - 1`` for each tier and the
arrivals of one load. Null payloads count 0 bytes; empty arrivals make no shard;
an empty store has an empty manifest; repeated rows stay; columns are kept as
they are (``_shard_arrival`` is the store's own and refused). ``read`` adds columns on
runs; where rows have a column of such a name, its own gets underscores before it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.runtime import fresh_names

#: Up to so many bytes of manifest ``read`` broadcasts it, beyond that it is joined.
BROADCAST_BYTES = 8 << 20
ARRIVAL = "_shard_arrival"
MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("first_arrival", T.LongType()),
        T.StructField("last_arrival", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Run:
    run_id: str
    first_arrival: int
    last_arrival: int
    tier: int
    n_rows: int
    n_bytes: int
    path: str


class CommitConflict(RuntimeError):
    """Another writer made this version first; read the new one and try again."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, base_bytes: int = 256 << 20, fanout: int = 4, target_bytes: int = 1 << 30, size_col: str = "text", lease_seconds: float = 600) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.root, self.base, self.fanout, self.target, self.size_col, self.lease = spark, root.rstrip("/"), base_bytes, fanout, target_bytes, size_col, lease_seconds
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # --- manifest -----------------------------------------------------------------

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json") and n[1:-5].isdigit())])

    def runs(self, version: int | None = None) -> list[Run]:
        v = self.version() if version is None else version
        if v == 0:
            return []
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/v{v}.json").collect()
        return sorted((Run(**r.asDict()) for r in rows), key=lambda r: (r.first_arrival, r.run_id))

    def commit(self, runs: list[Run], seen: int) -> int:
        """Make ``runs`` version seen + 1, or raise CommitConflict and change nothing."""
        token = uuid.uuid4().hex
        manifest, name = f"{self.root}/manifest", f"v{seen + 1}.json"
        claim, target, staged = (self._path(f"{manifest}/{n}") for n in (f"claim-{seen + 1}", name, f"staged-{token}"))
        self._fs.mkdirs(self._path(manifest))
        self._claim(claim, target, token)
        self._put(staged, "".join(json.dumps(asdict(r)) + "\n" for r in runs), False)
        # Where a claim was taken over from a writer that lives on, the token tells whose turn it
        # is, and the rename, which does not replace a file on a cluster's file system, has the last word.
        if self._fs.exists(target) or self._said(claim) != token or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise CommitConflict(f"version {seen + 1} was made by another writer")
        self._fs.delete(claim, False)
        return seen + 1

    def _claim(self, claim, target, token: str) -> None:
        """Put ``token`` into the claim, which must be new or older than the lease."""
        if not self._fs.exists(target):
            if not self._fs.exists(claim):
                try:
                    return self._put(claim, token, False)
                except Exception:  # FileAlreadyExistsException of the file system at hand
                    if not self._fs.exists(claim):
                        raise
            elif time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 >= self.lease:
                return self._put(claim, token, True)
        raise CommitConflict(f"{target.getName()} exists or is being made")

    def _put(self, path, text: str, replace: bool) -> None:
        out = self._fs.create(path, replace)
        out.write(bytearray(text.encode()))
        out.close()

    def _said(self, path) -> str | None:
        if not self._fs.exists(path):
            return None
        held = self._fs.open(path)
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    # --- writes -------------------------------------------------------------------

    def tier(self, n_bytes: int) -> int:
        k, bound = 0, self.base
        while n_bytes >= bound:
            k, bound = k + 1, bound * self.fanout
        return k

    def append(self, rows: DataFrame, arrival_col: str | None = None) -> int:
        """Write arrivals as shards, in one pass, and commit them; the new version.

        ``arrival_col`` numbers the arrivals within ``rows`` (null: arrival 0); without
        it all rows are one arrival. Numbers go on after those already in the store.
        """
        seen = self.version()
        held = self.runs(seen)
        offset = 1 + max((r.last_arrival for r in held), default=-1)
        load = f"{self.root}/data/load-{uuid.uuid4().hex}"
        number = F.coalesce(F.col(arrival_col).cast("long"), F.lit(0)) if arrival_col else F.lit(0)
        kept = rows.drop(arrival_col) if arrival_col else rows
        if ARRIVAL in (c.lower() for c in kept.columns):
            raise ValueError(f"{ARRIVAL} is a column of the store's own")
        kept = rows.select(*kept.columns, (number.cast("long") + offset).alias(ARRIVAL))
        kept.write.partitionBy(ARRIVAL).parquet(load)
        return self.commit(held + self._new(load, kept.schema), seen)

    def _new(self, path: str, schema: T.StructType, by_arrival: bool = True, first: int = 0, last: int = 0) -> list[Run]:
        """The shards or the run below a written folder, with rows and bytes as read back."""
        written = self.spark.read.schema(schema).parquet(path)
        size = F.coalesce(F.sum(F.octet_length(self.size_col)).cast("long"), F.lit(0))
        if not by_arrival:
            r = written.agg(F.count("*").alias("n"), size.alias("b")).first()
            return [Run(path.rpartition("/")[2], first, last, self.tier(r.b), r.n, r.b, path)]
        found = written.groupBy(F.col(ARRIVAL).cast("long").alias("a")).agg(F.count("*").alias("n"), size.alias("b")).collect()
        return [Run(f"shard-{r.a}", r.a, r.a, self.tier(r.b), r.n, r.b, f"{path}/{ARRIVAL}={r.a}") for r in found]

    def plan(self, runs: list[Run]) -> list[list[Run]]:
        """The merges of the lowest tier that has any: lists of ``fanout`` runs."""
        for k in sorted({r.tier for r in runs}):
            level = sorted((r for r in runs if r.tier == k), key=lambda r: r.first_arrival)
            if len(level) >= self.fanout:
                return [level[i : i + self.fanout] for i in range(0, len(level) - self.fanout + 1, self.fanout)]
        return []

    def compact(self) -> int:
        """Merge until every tier holds fewer than ``fanout`` runs; the last version.

        The merges of one tier are planned together and committed as one version.
        Runs that later merges would take again at once are planned on the manifest
        first, so a row is written once for each compaction, not once for each tier.
        """
        seen = self.version()
        runs = self.runs(seen)
        parts: dict[str, list[Run]] = {r.run_id: [r] for r in runs}
        while merges := self.plan(runs):
            for group in merges:
                members = [m for r in group for m in parts.pop(r.run_id)]
                first, last = min(r.first_arrival for r in group), max(r.last_arrival for r in group)
                total = sum(r.n_bytes for r in group)
                made = Run(f"run-{first}-{last}-{uuid.uuid4().hex[:8]}", first, last, max(self.tier(total), group[0].tier + 1), sum(r.n_rows for r in group), total, "")
                parts[made.run_id] = members
                runs = [r for r in runs if r not in group] + [made]
        done = []
        for r in runs:
            done.append(r if r.path else self._merge(r, parts[r.run_id]))
        return seen if all(r.path for r in runs) else self.commit(done, seen)

    def _merge(self, run: Run, members: list[Run]) -> Run:
        path = f"{self.root}/data/{run.run_id}"
        files = -(-run.n_bytes // self.target) or 1
        rows = self.spark.read.parquet(*(m.path for m in members))
        rows.coalesce(files).write.parquet(path)
        got = self._new(path, rows.schema, False, run.first_arrival, run.last_arrival)[0]
        if (got.n_rows, got.n_bytes) != (run.n_rows, run.n_bytes):
            raise RuntimeError(f"{path}: {got.n_rows} rows where {run.n_rows} were merged")
        return Run(run.run_id, run.first_arrival, run.last_arrival, run.tier, run.n_rows, run.n_bytes, path)

    # --- reads --------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version with run_id, tier and arrival span; None if it has none."""
        runs = self.runs(version)
        if not runs:
            return None
        rows = self.spark.read.parquet(*(r.path for r in runs))
        folder, run_id, *others = fresh_names(rows, "_folder", "run_id", "first_arrival", "last_arrival", "tier", "n_rows", "n_bytes")
        rows = rows.withColumn(folder, F.regexp_extract(F.col("_metadata.file_path"), rf"/data/(?:load-[^/]+/{ARRIVAL}=(\d+)|(run-[^/]+))/", 0))
        named = F.regexp_extract(folder, rf"{ARRIVAL}=(\d+)", 1)
        rows = rows.withColumn(run_id, F.when(named != "", F.concat(F.lit("shard-"), named)).otherwise(F.regexp_extract(folder, r"(run-[^/]+)/", 1)))
        # The manifest is a few rows for each tier: see the class comment.
        kinds = ("string", "long", "long", "int", "long", "long")
        listed = self.spark.createDataFrame([(r.run_id, r.first_arrival, r.last_arrival, r.tier, r.n_rows, r.n_bytes) for r in runs], ", ".join(f"`{c}` {k}" for c, k in zip((run_id, *others), kinds, strict=True)))
        if sum(len(r.run_id) + 64 for r in runs) <= BROADCAST_BYTES:
            listed = F.broadcast(listed)
        return rows.drop(folder).join(listed, run_id)

    def vacuum(self, keep: int = 1, grace_seconds: float = 7 * 86400) -> int:
        """Delete data folders that none of the last ``keep`` versions names; how many.

        Folders changed within ``grace_seconds`` stay, as a writer may be about to commit
        them: the time must be longer than any write takes.
        """
        v = self.version()
        named = {r.path.rpartition("/data/")[2] for k in range(max(1, v - keep + 1), v + 1) for r in self.runs(k)}
        before = (time.time() - grace_seconds) * 1000
        gone = 0
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = s.getPath().getName()
            inner = [(f"{name}/{x.getPath().getName()}", x) for x in self._fs.listStatus(s.getPath()) if x.isDirectory()] if name.startswith("load-") else [(name, s)]
            for folder, status in inner:
                if folder not in named and max(status.getModificationTime(), s.getModificationTime()) <= before:
                    gone += self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
        return gone
