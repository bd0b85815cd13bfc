"""Sequence queries over whole texts: against the SQL without its cut at 500 letters."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.plans import catalogue, functions
from strandframe.plans import standins as S
from test_oracles import SF, duck, rows  # noqa: F401

CUT = S.VIEWS["dna"]
WHOLE = CUT.replace("substr(translate(", "translate(").replace(", 1, 500) AS seq", " AS seq")
NAMES = [n for n in sorted(catalogue.oracle_sql()) if CUT in catalogue.oracle_sql()[n]]


@pytest.mark.skipif(not os.path.exists(f"{SF}/nation.parquet"), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_over_whole_texts(spark, duck, name):  # noqa: F811
    got = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name].replace(CUT, WHOLE))
    names = [d[0] for d in cur.description]
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(cur.fetchall(), names)
    assert sorted(got.columns) == sorted(names) and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1.1e-6) if any(isinstance(v, float) for v in x) else x == y


@pytest.mark.skipif(not os.path.exists(f"{SF}/nation.parquet"), reason="no test tables here")
def test_shuffle_query_has_every_letter(spark):
    n = {r.row_id: r.n for r in functions.f8(spark, SF).select("row_id", F.length("seq").alias("n")).collect()}
    folded = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    assert n == {r.doc_id: r.n for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.length(folded).alias("n")).collect()}
    assert max(n.values()) > 500


def test_best_score_over_pieces_equals_brute_force(spark):
    rnd = random.Random(4)
    seqs = [(i, "".join(rnd.choice("ACGTN" if i % 3 == 0 else "ACGT") for _ in range(n))) for i, n in enumerate([0, 5, 6, 7, 12, 13, 14, 15, 40, 333, 20000])]
    plus = sq.log_odds(functions.PWM)
    minus = [{"ACGT"["TGCA".index(b)]: v for b, v in row.items()} for row in reversed(plus)]

    def brute(s):
        wins = [s[i : i + 6] for i in range(len(s) - 5) if "N" not in s[i : i + 6]]
        return max((sum(r[c] for r, c in zip(m, w, strict=True)) for w in wins for m in (plus, minus)), default=None)

    df = spark.createDataFrame(seqs, "row_id long, seq string")
    for piece in (8, 4096):
        got = {r.row_id: r.score for r in sq.pwm_best(df, functions.PWM, piece).collect()}
        assert all(got[i] == (None if brute(s) is None else pytest.approx(brute(s))) for i, s in seqs)
