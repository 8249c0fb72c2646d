"""Every query of the library against its SQL twin on the smallest tables."""

import duckdb
import pytest

from vetloom.plans import catalogue

TABLES = ["customer", "supplier", "part", "orders", "lineitem", "documents", "conversations"]


def rounded(row):
    return tuple((x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small_dir, name):
    got = catalogue.QUERIES[name](spark, small_dir)
    rows = [rounded(r) for r in got.collect()]
    assert rows
    if name in catalogue.ORACLES:
        db = duckdb.connect()
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
        want = db.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        order = [got.columns.index(c) for c in columns]
        assert sorted(tuple(r[i] for i in order) for r in rows) == sorted(map(rounded, want.fetchall()))
