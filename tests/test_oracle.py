"""Every registered job against its DuckDB oracle on the smallest fixture
(tools/check_oracle.py runs the same comparison at sf0.01)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["doc_id", "label"]
    assert len(rows) > 0


def test_every_query_has_an_oracle():
    assert set(E._NAMES) <= set(E.queries())
    assert [name for name in E._NAMES if name not in E.oracle_sql()] == []


@pytest.mark.parametrize("name", sorted(n for n in E._NAMES if n in E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    a_cols, a = _canon(df.columns, df.collect())
    rel = con.execute(E.oracle_sql()[name])
    b_cols, b = _canon([d[0] for d in rel.description], rel.fetchall())
    assert a_cols == b_cols
    assert len(a) == len(b)
    assert a == b
