import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import canon  # noqa: E402
from phraseloom.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_twin(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    rel = con.sql(catalog.oracle_sql()[name])
    got, want = canon(df.columns, [tuple(r) for r in df.collect()]), canon(list(rel.columns), rel.fetchall())
    assert got[0] == want[0] and got[2] == want[2]
