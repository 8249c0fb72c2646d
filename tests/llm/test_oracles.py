"""The corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from vetloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, small_dir, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    want = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, small_dir)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
