import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.operators import control
from strandframe.operators import matrix as mx
from strandframe.runtime import shared_dir
from strandframe.sources import motifs, readers


def test_scan_finds_overlapping_occurrences_on_both_strands(spark):
    seqs = spark.createDataFrame([(1, "AAAAA"), (2, "ACG"), (3, "TTTTT"), (4, "ACGTN")], "row_id long, seq string")
    words = spark.createDataFrame([("AAAA",), ("ACGT",)], "word string")
    got = sorted(tuple(r) for r in sq.scan(seqs, words, 4).collect())
    assert got == [(1, 0, 4, "AAAA", "+"), (1, 1, 5, "AAAA", "+"), (3, 0, 4, "AAAA", "-"), (3, 1, 5, "AAAA", "-"), (4, 0, 4, "ACGT", "+"), (4, 0, 4, "ACGT", "-")]


def test_family_has_25_motifs_and_400_words(spark):
    fam = sq.substitution_family(spark, "TTTCNNTTTC", fixed=(5, 6))
    assert fam.count() == 25
    assert sq.expand_wildcards(fam, [5, 6]).select("word").distinct().count() == 400


def test_kmers_have_no_missing_end(spark):
    seqs = spark.createDataFrame([(1, "A" * 16299), (2, "A" * 33)], "row_id long, seq string")
    assert sq.kmers(seqs, 34).count() == 16266


def test_shuffle_keeps_letters_and_is_stable(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(60))) for i in range(20)] + [(99, "")]
    df = spark.createDataFrame(rows, "row_id long, seq string")
    one = {r.row_id: r.s for r in df.select("row_id", sq.shuffled(F.col("row_id"), F.col("seq"), 1).alias("s")).collect()}
    assert all(sorted(one[i]) == sorted(s) for i, s in rows) and sum(one[i] != s for i, s in rows) >= 19


def test_pwm_threshold_is_an_upper_tail(spark):
    m = [[0.7, 0.1, 0.1, 0.1]] * 4
    assert sq.pwm_threshold(m, 1 / 256) == pytest.approx(4 * 1.0296, abs=0.01)


def test_motif_files_round_trip(spark):
    rows = spark.createDataFrame([("m1", "AC", 1.5, [[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1]])], "name string, consensus string, score double, m array<array<double>>")
    path = shared_dir(spark, "motifs")
    motifs.write_homer(rows, path)
    back = motifs.read_homer(spark, path).first()
    assert (back.name, back.consensus, back.score, back.m) == ("m1", "AC", 1.5, rows.first().m)


def test_sequences_over_pieces_and_fasta(spark):
    path = shared_dir(spark, "fasta")
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(200_000))
    spark.createDataFrame([(f">c1\n{seq[:100000]}\n{seq[100000:]}\n>c2\nACGT",)], "value string").coalesce(1).write.text(path)
    chrom = readers.read_fasta(spark, path)
    at = spark.createDataFrame([(1, "c1", 65530, 131080), (2, "c1", 0, 4), (3, "c2", 1, 3)], "id long, chr string, start long, stop long")
    got = {r.id: r.seq for r in readers.sequences(at, chrom, "id").collect()}
    assert got == {1: seq[65530:131080], 2: seq[:4], 3: "CG"}


def test_edge_list_with_blank_rows_and_crlf(spark):
    path = shared_dir(spark, "edges")
    spark.createDataFrame([("node1,node2\r\na,b\r\n,\r\nc,c\r\n",)], "value string").coalesce(1).write.text(path)
    assert sorted(map(tuple, readers.read_edges(spark, path).collect())) == [("a", "b"), ("c", "c")]


def test_columns_missing_are_named(spark):
    with pytest.raises(ValueError, match="z"):
        mx.align_columns(spark.range(1), ["z"], ["id"])


def test_pack_and_wide_forms(spark):
    rnd = random.Random(3)
    cells = [(r, c, rnd.randint(0, 1)) for r in range(5) for c in range(70)]
    packed = mx.pack(spark.createDataFrame(cells, "row_id long, col_id int, x int"), 70).collect()
    for p in packed:
        on = {c for r, c, x in cells if r == p.row_id and x}
        assert p.ones == len(on) and {c for c in range(70) if p.bits[c // 63] >> (c % 63) & 1} == on


def test_stages_are_made_once_and_guards_raise(spark):
    stages = control.Stages(spark, shared_dir(spark, "stages"))
    for _ in range(2):
        stages.stage("a", lambda: spark.range(3))
    assert stages.made == ["a"]
    with pytest.raises(ValueError, match="3 and 2"):
        control.guard_equal_counts(spark.range(3), spark.range(2), "rows")
    with pytest.raises(Exception, match="negative"):
        control.require(spark.range(3), F.col("id") < 2, "negative").collect()
    assert control.batches(spark.range(11), 5, "id").groupBy("batch").count().count() == 3


def test_incremental_runs_skip_finished_keys(spark):
    from strandframe.streaming.incremental import process_new

    root = shared_dir(spark, "inc")
    df = spark.range(10)
    df.where("id < 5").write.parquet(f"{root}/in")
    go = lambda: process_new(spark, f"{root}/in", df.schema, "id", lambda d: d, f"{root}/out", f"{root}/cp")
    go()
    df.write.mode("append").parquet(f"{root}/in")
    go()
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == list(range(10))
