"""Every registered query agrees with its SQL on the smallest tables."""

import math
import os

import pytest

from quarryflow.plans import catalogue, extraction, lending, questions
from quarryflow.sources.files import TABLES

MODULES = (catalogue, lending, extraction, questions)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    want = sorted(str([plain(dict(zip(rel.columns, r))[c]) for c in sorted(rel.columns)]) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns) and got == want


def test_what_has_no_sql_has_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) == {"vector_index_search"}  # test_vector_index.py
