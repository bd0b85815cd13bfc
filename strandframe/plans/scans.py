"""S: sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.operators.graph import descendants, induced
from strandframe.plans import standins as S
from strandframe.plans.registry import query
from strandframe.plans.standins import sql
from strandframe.runtime import read_table, shared_dir
from strandframe.sources import motifs, readers, schemas


@query("S1_csv_scan", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s1(spark, sf):
    t = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = shared_dir(spark, "csv")
    readers.write_csv(t, path)
    return readers.read_csv(spark, path, t.schema)


@query("S2_bed_scan", sql("peaks", "SELECT chr, start, stop FROM peaks"))
def s2(spark, sf):
    path = shared_dir(spark, "bed")
    readers.write_csv(S.peaks(spark, sf).select("chr", "start", "stop", "q"), path, "\t", header=False)
    return readers.read_tsv(spark, path, schemas.MASTER, keep=3)


@query("S3_narrow_peak_scan", sql("peaks", "SELECT chr, start, stop, 'p' || ord AS name, CAST(ord % 1000 AS INTEGER) AS score, '.' AS strand, q AS signal, q AS p, q, CAST(250 AS BIGINT) AS peak FROM peaks"))
def s3(spark, sf):
    path = shared_dir(spark, "narrowpeak")
    p = S.peaks(spark, sf)
    rows = p.select("chr", "start", "stop", F.concat(F.lit("p"), "ord").alias("name"), (F.col("ord") % 1000).alias("score"), F.lit(".").alias("strand"), F.col("q").alias("signal"), F.col("q").alias("p"), "q", F.lit(250).alias("peak"))
    readers.write_csv(rows, path, "\t", header=False)
    return readers.read_narrow_peak(spark, path)


@query("S4_matrix_scan", "SELECT CAST(n_nationkey % 2 AS INTEGER) AS afr, CAST(n_regionkey % 2 AS INTEGER) AS b, CAST((n_nationkey + n_regionkey) % 2 AS INTEGER) AS c FROM nation")
def s4(spark, sf):
    path = shared_dir(spark, "matrix")
    n = read_table(spark, sf, "nation")
    m = n.select((F.col("n_nationkey") % 2).alias("a.bed"), (F.col("n_regionkey") % 2).alias("b.bed"), ((F.col("n_nationkey") + F.col("n_regionkey")) % 2).alias("c.bed"))
    readers.write_csv(m.coalesce(1), path, " ")
    return readers.read_matrix(spark, path, {"a": "afr"})


def _edge_file(spark, sf) -> str:
    """An edge list with a blank row and a loop."""
    path = shared_dir(spark, "edges")
    t = S.tree(spark, sf)
    names = t.select(F.col("v").alias("parent"), F.col("name").alias("node1"))
    e = t.join(names, "parent").select("node1", F.col("name").alias("node2"))
    more = spark.createDataFrame([(None, None), ("ALONE", "ALONE")], "node1 string, node2 string")
    readers.write_csv(e.unionByName(more).coalesce(1), path)
    return path


_EDGES = "SELECT p.name AS parent, t.name AS child FROM tree t JOIN tree p ON t.parent = p.v"


@query("S5_edge_list_scan", sql("tree", _EDGES + " UNION ALL SELECT 'ALONE', 'ALONE'"))
def s5(spark, sf):
    return readers.read_edges(spark, _edge_file(spark, sf))


@query("S6_rooted_graph", sql("tree", f"SELECT * FROM ({_EDGES}) WHERE parent IN (SELECT name FROM tree WHERE v IN (1, 3, 4, 7, 8, 9, 10, 15, 16, 17, 18, 19, 20, 21, 22)) AND child IN (SELECT name FROM tree)"))
def s6(spark, sf):
    e = readers.read_edges(spark, _edge_file(spark, sf))
    root = S.tree(spark, sf).where("v = 1").first().name
    return induced(e, descendants(spark, e, root).select("v"))


@query("S7_annotation_cache", "SELECT 'G' || s_suppkey AS gene_id, 'T' || s_suppkey AS transcript_id, 'R' || s_suppkey AS refseq_id, 'chr' || s_nationkey AS chr, CAST(s_suppkey * 1000 AS BIGINT) AS TSS, CAST(1 AS INTEGER) AS strand, CAST(1 AS INTEGER) AS transcript_count, s_name AS gene_name, 'protein_coding' AS transcript_type FROM supplier")
def s7(spark, sf):
    path = shared_dir(spark, "annotation")
    s = read_table(spark, sf, "supplier")
    named = lambda p: F.concat(F.lit(p), "s_suppkey")
    readers.write_csv(s.select(named("G").alias("gene_id"), named("T").alias("transcript_id"), named("R").alias("refseq_id"), F.concat(F.lit("chr"), "s_nationkey").alias("chr"), (F.col("s_suppkey") * 1000).alias("TSS"), F.lit(1).alias("strand"), F.lit(1).alias("transcript_count"), F.col("s_name").alias("gene_name"), F.lit("protein_coding").alias("transcript_type")), path)
    return readers.read_annotation(spark, path)


@query("S8_interval_sequences", sql("dna", "SELECT row_id AS id, substr(seq, 11, 30) AS seq FROM dna WHERE length(seq) > 10"))
def s8(spark, sf):
    d = S.dna(spark, sf)
    chrom = d.select(F.col("row_id").cast("string").alias("name"), "seq")
    at = d.where(F.length("seq") > 10).select(F.col("row_id").alias("id"), F.col("row_id").cast("string").alias("chr"), F.lit(10).alias("start"), F.lit(40).alias("stop"))
    return readers.sequences(at, chrom, "id")


@query("S9_object_listing", "SELECT 'region_' || r_regionkey || '.txt' AS name FROM region")
def s9(spark, sf):
    path = shared_dir(spark, "objects")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(5):
        out = fs.create(fs_path(f"{path}/region_{k}.txt"))
        out.write(bytearray(b"x"))
        out.close()
    names = [r.name for r in readers.list_files(spark, path, "*.txt").select("name").collect()]  # five files
    copy = shared_dir(spark, "objects-copy")
    for _ in range(2):  # the second time nothing is left to copy
        readers.copy_files(spark, names, path, copy)
    return readers.list_files(spark, copy, "*.txt").where("length = 1").select("name")


@query("S10_folder_union", sql("peaks", "SELECT chr, start, stop, q, CAST(sample AS VARCHAR) AS sample FROM peaks"))
def s10(spark, sf):
    path = shared_dir(spark, "folder")
    S.peaks(spark, sf).select("chr", "start", "stop", "q", "sample").write.partitionBy("sample").option("sep", "\t").csv(path)
    return readers.read_folder(spark, path, schemas.MASTER)


@query("S11_sheet_per_bicluster", sql("bits", "SELECT row_id, col_id, x, cluster AS bicluster FROM bits"))
def s11(spark, sf):
    path = shared_dir(spark, "sheets")
    b = S.bits(spark, sf).withColumnRenamed("cluster", "bicluster")
    readers.write_sheets(b, path)
    return spark.read.schema(b.schema).parquet(path)


@query("S12_text_sinks", "SELECT r_regionkey || ' & ' || r_name || ' \\\\' AS line FROM region")
def s12(spark, sf):
    path = shared_dir(spark, "latex")
    readers.latex_lines(read_table(spark, sf, "region").select("r_regionkey", "r_name"), ["r_regionkey"]).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _motif_rows(spark, sf):
    n = read_table(spark, sf, "nation")
    top = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(F.col("n_nationkey") + i * (F.col("n_regionkey") + 1), F.lit(4)))
    m = F.transform(top, lambda t: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.when(b == t, 0.7).otherwise(0.1)))
    return n.select(F.col("n_name").alias("name"), m.alias("m"), F.col("n_nationkey").alias("k"))


_CONSENSUS = " || ".join(f"substr('ACGT', CAST((n_nationkey + {i} * (n_regionkey + 1)) % 4 AS INTEGER) + 1, 1)" for i in range(6))


@query("S13_homer_motifs", f"SELECT n_name AS name, {_CONSENSUS} AS consensus, CAST(n_nationkey / 2.0 AS DOUBLE) AS score, CAST(6 AS INTEGER) AS width FROM nation")
def s13(spark, sf):
    path = shared_dir(spark, "homer")
    rows = _motif_rows(spark, sf)
    motifs.write_homer(rows.select("name", motifs.consensus(F.col("m")).alias("consensus"), (F.col("k") / 2).alias("score"), "m"), path)
    return motifs.read_homer(spark, path).select("name", "consensus", "score", F.size("m").alias("width"))


@query("S14_meme_motifs", f"SELECT n_name AS name, {_CONSENSUS} AS consensus, CAST(n_nationkey * 5 AS INTEGER) AS nsites, CAST(6.5 AS DOUBLE) AS score, CAST(6 AS INTEGER) AS width FROM nation WHERE n_nationkey * 5 >= 20")
def s14(spark, sf):
    path = shared_dir(spark, "meme")
    lines = F.array_join(F.transform("m", lambda r: F.concat(F.lit(" "), F.array_join(F.transform(r, lambda v: v.cast("string")), "  "))), "\n")
    text = F.concat(F.lit("MOTIF "), "name", F.lit(" x\n\nletter-probability matrix: alength= 4 w= 6 nsites= "), (F.col("k") * 5).cast("string"), F.lit(" E= 0\n"), lines, F.lit("\n"))
    _motif_rows(spark, sf).select(text.alias("value")).coalesce(1).write.text(path)
    return motifs.meme_to_homer(motifs.read_meme(spark, path), 20, 6.5).select("name", "consensus", "nsites", "score", F.size("m").alias("width"))


_SAM = "SELECT 'r' || ord AS name, chr, start, CASE ord % 3 WHEN 0 THEN 50 WHEN 1 THEN 50 ELSE 40 END AS len FROM peaks WHERE ord % 10 <> 0 AND ord % 60 >= 30"


@query("S16_sam_pairs", sql("peaks", f"WITH s AS ({_SAM}) SELECT name, chr, start + 4 AS start, start + len AS stop, '+' AS strand FROM s UNION ALL SELECT name, chr, start + 450, start + 495, '-' FROM s"))
def s16(spark, sf):
    """Read pairs written as SAM, with duplicates, poor ones and other alignments' lengths, to shifted reads."""
    path = shared_dir(spark, "sam")
    p = S.peaks(spark, sf).select("ord", "chr", "start")
    cigar = F.element_at(F.array(F.lit("50M"), F.lit("20M5D25M"), F.lit("10S40M2I")), (F.col("ord") % 3 + 1).cast("int"))
    line = lambda flag, shift, c: F.concat_ws("\t", F.concat(F.lit("r"), "ord"), F.lit(flag) + F.when(F.col("ord") % 10 == 0, 1024).otherwise(0), "chr", F.col("start") + 1 + shift, F.col("ord") % 60, c, F.lit("="), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.lit("NM:i:0")).alias("value")
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:click\tLN:9",)], "value string")
    head.unionByName(p.select(line(99, 0, cigar))).unionByName(p.select(line(147, 450, F.lit("50M")))).write.text(path)
    return iv.tagalign(readers.read_pairs(readers.read_sam(spark, path)), keep=["name"])


@query("S17_plot_tables", sql("bits", "SELECT cluster, col_id, round(avg(x), 6) AS freq FROM bits GROUP BY cluster, col_id"))
def s17(spark, sf):
    return S.bits(spark, sf).groupBy("cluster", "col_id").agg(F.round(F.avg("x"), 6).alias("freq"))


