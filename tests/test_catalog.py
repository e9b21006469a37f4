"""Every registered ledger query against its oracle."""

import os

import duckdb
import pytest
from tallystone.plans import answers, catalog, lifecycle  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return db


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in catalog.ORACLES:
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
