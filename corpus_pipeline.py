"""A corpus pipeline of five stages, each a step of ``documents`` towards packed ids.

Every stage but the last returns the columns of ``documents``; each works on all
rows that its predecessor kept. Null texts go with the first stage (no language);
an empty table stays empty; extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.decontamination import decontaminate
from strandframe.llm.jaccard_join import keep_one
from strandframe.llm.language_id import UNDETERMINED, identify, train
from strandframe.llm.packing import pack_sequences
from strandframe.llm.quality import fit, scored_texts, with_features
from strandframe.runtime import fresh_names, read_table, shared_dir, written

#: Documents whose language is less likely than LEAST_LANGUAGE - SLACK / sqrt(bytes) are
#: rejected: a probability worked out from few bytes is less sure. It asks for 0.38 of
#: 25 bytes, 0.55 of 256, 0.60 of 4096. Of texts in the learned languages 1 in 200 or fewer lie
#: lower at any length; texts in others lie at 0.48 to 0.71 from a few hundred bytes on.
LEAST_LANGUAGE, SLACK = 0.62, 1.2
#: Documents whose quality is less likely than this are rejected.
LEAST_QUALITY = 0.5


def least_language(text: str) -> Column:
    """What the language's probability must reach, by one rule for texts of all lengths."""
    return F.lit(LEAST_LANGUAGE) - SLACK / F.sqrt(F.greatest(F.octet_length(text), F.lit(1)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the documents that name one; rejects those without a clear one."""
    pred, score = fresh_names(docs, "_lang_pred", "_lang_score")
    found = identify(docs, train(docs), pred=pred, score_col=score)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least_language("text"))).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns quality from the labelled ones among the documents; rejects the rest's low end."""
    stats = with_features(docs.select("doc_id", "text")).select("doc_id", "_features")
    model = fit(written(stats, "quality"), read_table(spark, sf_dir, "labels"))
    (score,) = fresh_names(docs, "_score")
    return scored_texts(docs, model, score_col=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every document with a passage of the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
