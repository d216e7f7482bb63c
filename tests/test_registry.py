"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math
import os

import duckdb
import pytest

from lectern import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(x):
    if isinstance(x, (list, tuple)):
        return [canon(y) for y in x]
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def tables_of(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return tables_of(SF)


@pytest.fixture(scope="module")
def larger():
    return tables_of("/root/testdata/sf0.01")


def compare(frame, duck, sql):
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    want = sorted((tuple(canon(r[names.index(n)]) for n in sorted(names)) for r in rel.fetchall()), key=repr)
    assert sorted(frame.columns) == sorted(names)
    got = sorted((tuple(canon(r[n]) for n in sorted(names)) for r in frame.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    frame = plans.queries()[name](spark, SF)
    if name in plans.oracle_sql():
        compare(frame, duck, plans.oracle_sql()[name])
    else:
        assert frame.count() > 0


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql_runs_on_larger_tables(larger, name):
    assert larger.execute(f"SELECT count(*) FROM ({plans.oracle_sql()[name]})").fetchone()[0] > 0


def test_every_sql_belongs_to_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_the_entry_point_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
