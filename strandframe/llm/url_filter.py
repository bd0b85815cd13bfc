"""URL filter: a broadcast trie of allow and block rules, longest match first.

A rule is ``host/path``. It fits its host and all subdomains when the url's path
starts with the rule's path (as a string, so ``org/en/1`` fits ``/en/123``).
Of several fitting rules the longest (host and path together) wins, of equally long
ones that of the longer host; the same rule in both lists blocks. Urls that no rule fits get
the default verdict (``allow``: a filter list only takes away what it names).

Null urls and urls without ``://`` have empty host and path and fit no rule.
Repeated rows are judged each for itself; an empty table gives an empty result.
Extra columns are not read. Very long urls cost time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.runtime import ship

#: Above so many rule bytes the rules are joined instead of broadcast.
BROADCAST_BYTES = 64 << 20

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_LOWER), slash + path


class RuleTrie:
    """Nodes are dicts: host labels from the right, then whole path segments.

    A path node may hold, by length, the rule endings that stop inside a segment.
    """

    def __init__(self) -> None:
        self.root: dict = {"next": {}, "path": None}

    def add(self, rule: str, verdict: str) -> None:
        host, path = split_rule(rule)
        node = self.root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}, "path": None})
        if node["path"] is None:
            node["path"] = {"next": {}, "ends": {}}
        at = node["path"]
        *whole, last = path.split("/")
        for segment in whole:
            at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
        held = at["ends"].setdefault(len(last), {})
        if held.get(last, ("", ""))[1] != "block":
            held[last] = (rule, verdict)

    @staticmethod
    def _below(at: dict, path: str) -> tuple[str, str] | None:
        found = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            # What is left of the path from here on; an ending never holds a slash.
            for n in sorted(at["ends"]):
                if n <= len(segment) and (hit := at["ends"][n].get(segment[:n])):
                    found = hit
            if i + 1 == len(segments) or (at := at["next"].get(segment)) is None:
                break
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and verdict of the longest match, or None."""
        if not host:
            return None
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            # The longest of one host; deeper hosts come later and win ties.
            if node["path"] is not None and (hit := self._below(node["path"], path)) and (found is None or len(hit[0]) >= len(found[0])):
                found = hit
        return found


def url_parts(url):
    """Host (A-Z lower-cased) and path columns of a url column."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.expr("substring(_url, locate('://', _url) + 3)"), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.locate("/", rest) > 0, F.substring(rest, F.locate("/", rest), F.length(rest))).otherwise(F.lit(""))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Judge every url: id, host, path, rule (null if none fits), verdict.

    ``rules`` are (rule, "allow" | "block"). The trie is broadcast while the rules
    are within ``broadcast_bytes``; beyond that the urls' host suffixes and path
    prefixes are joined with the rules, with the same result.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = url_parts(F.col("_url"))
    base = base.select("_id", host.alias("host"), path.alias("path"))
    if sum(len(r) for r, _ in rules) > broadcast_bytes:
        return _joined(base, rules, default).withColumnRenamed("_id", id_col)
    ship(spark)
    trie = RuleTrie()
    for rule, verdict in rules:
        trie.add(rule, verdict)
    sent = spark.sparkContext.broadcast(trie)
    id_type = base.schema["_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = sent.value.match
        for b in batches:
            got = [match(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            rule = pa.array([g and g[0] for g in got], pa.string())
            verdict = pa.array([g[1] if g else default for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], ["_id", "host", "path", "rule", "verdict"])

    out = base.mapInArrow(judge, f"_id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("_id", id_col)


def _joined(base: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """The same judgement by equi-joins, for rule lists too large to broadcast."""
    spark: SparkSession = base.sparkSession
    rows = [(*split_rule(r), r, v) for r, v in rules]
    table = spark.createDataFrame(rows, "_rh string, _rp string, rule string, verdict string")
    table = table.groupBy("_rh", "_rp").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.when(F.col("verdict") == "block", 1).otherwise(0), "rule")).alias("_r"))
    urls = base.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    tried = urls.where("host <> ''").select("host", "path", F.explode(suffixes).alias("_rh"))
    lengths = F.sequence(F.lit(0), F.length("path"))
    tried = tried.join(table.select("_rh").distinct(), "_rh", "left_semi")
    tried = tried.withColumn("_rp", F.explode(F.transform(lengths, lambda k: F.substring(F.col("path"), F.lit(1), k))))
    best = tried.join(table, ["_rh", "_rp"]).groupBy("host", "path").agg(F.max_by("_r", F.struct(F.length("_rh") + F.length("_rp"), F.length("_rh"))).alias("_r"))
    out = base.join(best, ["host", "path"], "left")
    return out.select("_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.lit(default)).alias("verdict"))
