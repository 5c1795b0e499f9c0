"""Every query with SQL against DuckDB on the smallest tables; the others for running and for their columns."""

from pathlib import Path

import duckdb
import pytest

from folioscan import queries_files  # noqa: F401  (registers its queries)
from folioscan.queries import QUERIES, SQL
from verify import norm

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((norm([r[c] for c in cols]) for r in df.collect()), key=repr)
    if name in SQL:
        r = con.sql(SQL[name])
        assert sorted(r.columns) == cols
        assert got == sorted((norm([row[r.columns.index(c)] for c in cols]) for row in r.fetchall()), key=repr)
