"""Every registered query against its SQL oracle on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check import table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    found = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        relation = con.sql(sql)
        assert found == table(relation.columns, relation.fetchall())
