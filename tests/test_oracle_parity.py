"""Every registered query with an oracle: Spark result == DuckDB result on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from binlens.sources.tables import TABLES

from conftest import SF001

ORACLE = E.oracle_sql()      # the training-data queries' too, where they exist
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    assert _canon(rows, cols) == _canon(res.fetchall(), dcols)
