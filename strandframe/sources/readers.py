"""Readers and writers of the text formats, on Spark's own sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line, by a declared schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.option("header", header).option("sep", sep).csv(path)


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType, keep: int | None = None) -> DataFrame:
    """Headerless tab-separated text; ``keep`` takes the first columns only."""
    df = spark.read.schema(schema).option("sep", "\t").csv(path)
    return df.select(df.columns[:keep]) if keep else df


def read_bed(spark: SparkSession, path: str, schema: T.StructType = schemas.BED) -> DataFrame:
    return read_tsv(spark, path, schema)


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.NARROW_PEAK)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The alignments of SAM text (header lines and optional fields left out), by schemas.SAM,
    with ``stop``: where the alignment ends, 0-based and exclusive like BED."""
    part = F.split("value", "\t")
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '@')")
    df = lines.select(*(F.get(part, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.SAM)))
    # M, D, N, = and X take up places of the reference.
    taken = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    return df.withColumn("stop", F.col("pos") - 1 + taken)


def read_pairs(sam: DataFrame, require: int = 2, exclude: int = 1804, quality: int = 30) -> DataFrame:
    """BEDPE rows (name, chr1, start1, stop1, strand1, chr2, ...) of the pairs whose two reads pass."""
    good = sam.where(F.col("flag").bitwiseAND(require) == require).where(F.col("flag").bitwiseAND(exclude) == 0).where(F.col("mapq") >= quality)
    end = F.struct(F.col("rname").alias("chr"), (F.col("pos") - 1).alias("start"), "stop", F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"))
    both = good.groupBy(F.col("qname").alias("name")).agg(*(F.min(F.when(F.col("flag").bitwiseAND(bit) > 0, end)).alias(f"r{n}") for n, bit in ((1, 64), (2, 128))))
    return both.where("r1 is not null and r2 is not null").select("name", *(F.col(f"r{n}.{c}").alias(f"{c}{n}") for n in (1, 2) for c in ("chr", "start", "stop", "strand")))


def sequenced_ends(sam: DataFrame, exclude: int = 2828) -> DataFrame:
    """(name, chr1, five1, strand1, chr2, ..., quality) of all pairs, also poor or marked ones.

    ``five`` is the 5' end that the read would have if what was clipped off it had aligned
    too: 0-based on +, exclusive on -. ``quality`` is the sum of both mapping qualities. Reads
    with a flag of ``exclude`` (unmapped, mate unmapped, secondary, poor, supplementary) are
    left out, and so are pairs that lack one.
    """
    clipped = lambda at: F.coalesce(F.try_element_at(F.regexp_extract_all("cigar", F.lit(at), F.lit(1)), F.lit(1)).cast("long"), F.lit(0))
    clip = {"+": clipped(r"^(?:\d+H)?(\d+)S"), "-": clipped(r"(\d+)S(?:\d+H)?$")}
    hard = {"+": clipped(r"^(\d+)H"), "-": clipped(r"(\d+)H$")}
    minus = F.col("flag").bitwiseAND(16) > 0
    five = F.when(minus, F.col("stop") + clip["-"] + hard["-"]).otherwise(F.col("pos") - 1 - clip["+"] - hard["+"])
    end = F.struct(F.col("rname").alias("chr"), five.alias("five"), F.when(minus, "-").otherwise("+").alias("strand"), F.col("mapq").alias("q"))
    good = sam.where(F.col("flag").bitwiseAND(exclude) == 0)
    both = good.groupBy(F.col("qname").alias("name")).agg(*(F.min(F.when(F.col("flag").bitwiseAND(bit) > 0, end)).alias(f"r{n}") for n, bit in ((1, 64), (2, 128))))
    parts = (F.col(f"r{n}.{c}").alias(f"{c}{n}") for n in (1, 2) for c in ("chr", "five", "strand"))
    return both.where("r1 is not null and r2 is not null").select("name", *parts, (F.col("r1.q") + F.col("r2.q")).alias("quality"))


def read_matrix(spark: SparkSession, path: str, names: dict[str, str] | None = None, sep: str = " ") -> DataFrame:
    """A 0/1 matrix whose header names samples as ``<sample>.bed``; names may be mapped.

    Only the header line is read ahead; all columns are integers.
    """
    header = spark.read.text(path).limit(1).first()
    if header is None:
        raise ValueError(f"{path}: no header")
    cols = header.value.split(sep)
    new = [(names or {}).get(c := re.sub(r"\.bed$", "", x), c) for x in cols]
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in cols])
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path).toDF(*new)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of an edge list with blank rows, CRLF ends and loops that only
    name single vertices."""
    e = spark.read.schema(schemas.EDGES).option("header", True).option("lineSep", "\n").csv(path)
    clean = lambda c: F.regexp_replace(F.trim(c), r"\r$", "")
    e = e.select(clean("node1").alias("parent"), clean("node2").alias("child"))
    return e.where("parent is not null and child is not null and parent <> '' and child <> ''")


def read_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files below a folder as one table, with the file's name as ``sample``."""
    df = spark.read.schema(schema).option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    return df.withColumn("sample", F.regexp_extract(F.col("_metadata.file_path"), r"/sample=([^/]+)/[^/]*$", 1))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, length) of the files below a path of any store Spark reads."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def copy_files(spark: SparkSession, names: list[str], source: str, target: str) -> None:
    """Copy named files between folders of any stores that Spark reads; what is there already stays."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    to = path(target).getFileSystem(conf)
    to.mkdirs(path(target))
    for name in names:
        a, b = path(f"{source}/{name}"), path(f"{target}/{name}")
        if not to.exists(b):
            jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, to, b, False, conf)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of FASTA files: one record for each '>' line."""
    df = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    return df.select(F.trim(F.get(lines, F.lit(0))).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def sequences(intervals: DataFrame, chromosomes: DataFrame, id_col: str) -> DataFrame:
    """(id, seq): the letters of half-open intervals. chromosomes (name, seq).

    A chromosome is cut into pieces of PIECE letters joined by (chr, piece), so that
    no row but the source's holds a whole chromosome.
    """
    piece = 1 << 16
    n = F.ceil(F.length("seq") / piece).cast("int")
    cut = chromosomes.select(F.col("name").alias("chr"), "seq", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("_p"))
    cut = cut.select("chr", "_p", F.substring("seq", F.col("_p") * piece + 1, F.lit(piece)).alias("_s"))
    wide = intervals.select(id_col, "chr", F.greatest("start", F.lit(0)).alias("start"), "stop")
    wide = wide.withColumn("_p", F.explode(F.sequence(F.floor(F.col("start") / piece).cast("int"), F.floor(F.greatest(F.col("stop") - 1, F.col("start")) / piece).cast("int"))))
    part = wide.join(cut, ["chr", "_p"])
    lo = F.greatest(F.col("start") - F.col("_p") * piece, F.lit(0))
    hi = F.least(F.col("stop") - F.col("_p") * piece, F.lit(piece))
    part = part.select(id_col, F.struct("_p", F.substring("_s", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("s")).alias("x"))
    return part.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("seq"))


def write_sheets(df: DataFrame, path: str, by: str = "bicluster") -> None:
    """One folder for each value of ``by``, in place of a workbook's sheets."""
    df.write.partitionBy(by).parquet(path)


def latex_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line): rows of a LaTeX table in order; the caller adds head and foot."""
    cells = F.concat_ws(" & ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    return df.orderBy(*order).select(F.concat(cells, F.lit(" \\\\")).alias("line"))


def read_annotation(spark: SparkSession, cache: str, fetch=None) -> DataFrame:
    """The TSS table from its cached CSV; ``fetch`` (returning rows of schemas.TSS) is
    called once to fill the cache where a service can be reached."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if fetch is None:
            raise FileNotFoundError(f"{cache}: no cached annotation, and no service to ask")
        write_csv(spark.createDataFrame(fetch(), schemas.TSS), cache)
    return read_csv(spark, cache, schemas.TSS)
