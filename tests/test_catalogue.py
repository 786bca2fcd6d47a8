"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from treelace.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
DUCK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    types = {r[0]: DUCK.get(r[1], r[1]) for r in tables.execute(f"DESCRIBE {ORACLE_SQL[name]}").fetchall()}
    assert dict(df.dtypes) == types
    cols = sorted(types)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(tables.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall(), key=key)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "o_orderkey", "o_orderstatus", "o_totalprice"] and df.count() > 0
