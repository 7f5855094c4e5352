"""Every query of the library that has SQL gives the same rows and columns as DuckDB."""

import os

import pytest

from glyphmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame, cols):
    return sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    assert [str(mine[c].dtype) for c in cols] == [str(theirs[c].dtype) for c in cols]
    assert rows(mine, cols) == rows(theirs, cols)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
