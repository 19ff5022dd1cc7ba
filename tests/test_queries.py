"""Every registered query of the library against its SQL twin, over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sparrowline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_is_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr([plain(dict(zip(columns, r))[c]) for c in order]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == want
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert all(KINDS.get(k, kinds[c]) == kinds[c] for c, k in df.dtypes)


def test_each_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
