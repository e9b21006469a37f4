"""The parts of the operators' results that SQL can say, against DuckDB."""

import duckdb
import pytest
from tallystone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(r[c] for c in sorted(names)) for r in got.collect())
    assert rows == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())
