"""The operators that SQL can express give DuckDB's rows."""

import os
from pathlib import Path

import pytest

from millrace.llm import queries

DATA = Path(os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        p = DATA / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    rows = sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
    assert rows == sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in want.fetchall()) and rows
