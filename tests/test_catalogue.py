"""Every named query against its SQL on a small scale factor."""

import os

import duckdb
import pytest

import __spark_entry__
from ferrule.plans.catalogue import ORACLES, QUERIES
from ferrule.sources.tables import digest_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rounded(row, order):
    return tuple(round(row[i], 6) if isinstance(row[i], float) else row[i] for i in order)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((rounded(r, [names.index(c) for c in sorted(names)]) for r in cursor.fetchall()), key=repr)
    got = sorted((rounded(r, [df.columns.index(c) for c in sorted(names)]) for r in df.collect()), key=repr)
    assert got == want


def test_entry_has_rows_and_reruns_agree(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["round", "branch", "node", "weight"]
    assert digest_rows(df).first() == digest_rows(__spark_entry__.entry(spark)).first()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
