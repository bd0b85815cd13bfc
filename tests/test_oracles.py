"""Every query of the library's own operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from strandframe.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    if not os.path.exists(f"{SF}/nation.parquet"):
        pytest.skip("no test tables here")
    got = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(want, names)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6, rel=1e-9) if all(isinstance(v, float) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
