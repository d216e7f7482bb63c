"""The operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lectern import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equal_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.execute(llm.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in rel.fetchall()), key=repr)
    frame = llm.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in sorted(names)) for r in frame.collect()), key=repr) == want
