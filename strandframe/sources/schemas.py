"""Declared schemas of the text formats; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BED = struct(chr=S, start=L, stop=L)
BED6 = struct(chr=S, start=L, stop=L, name=S, score=I, strand=S)
BLACKLIST = struct(chr=S, start=L, stop=L, reason=S)
MASTER = struct(chr=S, start=L, stop=L, q=D)
NARROW_PEAK = struct(chr=S, start=L, stop=L, name=S, score=I, strand=S, signal=D, p=D, q=D, peak=L)
MOTIF_BED = struct(chr=S, start=L, stop=L, name=S, score=I, strand=S, sequence=S, reverse=B)
#: Replicate-consistency output: 20 columns, of which chr, start, stop, q and summit are named.
IDR = T.StructType([T.StructField({0: "chr", 1: "start", 2: "stop", 8: "q", 9: "peak"}.get(i, f"c{i + 1}"), L if i in (1, 2, 9) else D if i == 8 else S) for i in range(20)])
EDGES = struct(node1=S, node2=S)
#: Read by position; the last two columns are other names of the sample and its cell type.
SAMPLES = struct(GEO=S, SRX=S, cell_type=S, cell_name=S, title=S, SRR=S, alias=S, alias_cell_type=S)
TSS = struct(gene_id=S, transcript_id=S, refseq_id=S, chr=S, TSS=L, strand=I, transcript_count=I, gene_name=S, transcript_type=S)
CLUSTERS = struct(row_id=L, cluster=I)
TF_LIST = struct(TF=S, Significant=B)
CHROM_SIZES = struct(chr=S, length=L)
#: The mandatory fields of an alignment.
SAM = struct(qname=S, flag=I, rname=S, pos=L, mapq=I, cigar=S, rnext=S, pnext=L, tlen=L, seq=S, qual=S)
