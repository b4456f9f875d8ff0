"""Every registered query of the engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from keyloom.plans.queries import oracle_sql, queries
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    found = queries()[name](spark, DATA)
    if name not in oracle_sql():
        assert found.columns
        found.count()
        return
    relation = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in found.columns]
    want = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
