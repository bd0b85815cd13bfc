"""Duplicate marking with nulls, ties, string names and mates in either order."""

from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.sources import readers


def test_null_keys_stay_and_names_are_strings(spark):
    rows = [("b", "x", 5, 1.0), ("a", "x", 5, 1.0), ("c", "x", 5, 9.0), ("d", "x", 6, None), ("e", "x", 6, 0.0), ("f", None, 5, 3.0), ("g", None, 5, 4.0), ("h", "x", None, 1.0), (None, "y", 1, 1.0), ("c", "x", 5, 9.0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "name string, chr string, place long, q double, _best int")
    got = iv.mark_duplicates(df, ["chr", "place"], "q", "name")
    assert got.columns == [*df.columns, "duplicate"]
    by = [(r.name, r.duplicate) for r in got.collect()]
    assert sorted(by, key=str) == sorted([("b", True), ("a", True), ("c", False), ("c", False), ("d", True), ("e", False), ("f", False), ("g", False), ("h", False), (None, False)], key=str)
    tied = iv.mark_duplicates(df.where("name in ('a', 'b')"), ["chr", "place"], "q", "name").where(~F.col("duplicate")).collect()
    assert [r.name for r in tied] == ["a"]
    assert iv.mark_duplicates(df.where("false"), ["chr"], "q", "name").count() == 0


def sam(name, flag, pos, cigar, mapq=30, chrom="c1"):
    return "\t".join(map(str, (name, flag, chrom, pos, mapq, cigar, "=", 0, 0, "*", "*")))


def test_ends_count_what_was_clipped_on_either_mate(spark, tmp_path):
    lines = [
        "@HD\tVN:1.6",
        *(sam("p", 99, 101, "50M"), sam("p", 147, 301, "50M")),
        *(sam("q", 99, 106, "5S45M", 40), sam("q", 147, 301, "40M3D4M3S", 40)),  # the same ends, better
        *(sam("r", 163, 104, "2H1S47M"), sam("r", 83, 301, "50M")),  # the same ends, mates in turn
        *(sam("s", 99, 101, "50M"), sam("s", 147, 302, "50M")),  # another end
        *(sam("t", 99, 101, "50M", 60, "c2"), sam("t", 147, 301, "50M", 60, "c2")),
        *(sam("u", 67, 101, "50M"), sam("u", 131, 301, "50M")),  # both on +
        sam("v", 99, 101, "50M"),  # without a mate
        *(sam("w", 99 + 1024, 101, "50M"), sam("w", 147 + 2048, 301, "50M")),  # supplementary
    ]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    pairs = iv.pair_ends(readers.sequenced_ends(readers.read_sam(spark, str(tmp_path))))
    ends = {r.name: r.ends for r in pairs.collect()}
    assert set(ends) == set("pqrstu") and ends["p"] == ends["q"] == ends["r"] and len({str(e) for e in ends.values()}) == 4
    marked = {r.name: r.duplicate for r in iv.mark_duplicates(pairs, ["ends"], "quality", "name").collect()}
    assert marked == {"p": True, "q": False, "r": True, "s": False, "t": False, "u": False}
