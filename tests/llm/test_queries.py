"""The subpackage's queries against their SQL on the smallest data."""

from pathlib import Path

import duckdb
import pytest

from inkstone.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    with duckdb.connect() as c:
        for p in Path(DATA).glob("*.parquet"):
            c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        r = c.sql(oracle.oracle_sql()[name])
        cols = sorted(r.columns)
        want = sorted(str([x[r.columns.index(k)] for k in cols]) for x in r.fetchall())
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == cols
    assert sorted(str([x[k] for k in cols]) for x in df.collect()) == want
