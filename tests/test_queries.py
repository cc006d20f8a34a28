"""Every query of the engine gives the rows of its DuckDB SQL."""

import os

import duckdb
import pytest

from logloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES.split():
        if os.path.exists(f"{SF}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([_plain(v) for v in r] for r in df.select(columns).collect()), key=repr)
    answer = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(([_plain(r[names.index(c)]) for c in columns] for r in answer.fetchall()), key=repr)
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
