from pathlib import Path

import duckdb
import pytest

from phraseloom.llm import catalog
from tests.test_queries import canon


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.oracle_sql():
        rel = con.sql(catalog.oracle_sql()[name])
        got, want = canon(df.columns, rows), canon(list(rel.columns), rel.fetchall())
        assert got[0] == want[0] and got[2] == want[2]
    else:
        assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
