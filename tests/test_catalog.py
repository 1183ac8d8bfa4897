"""Every registered query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from cuetide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Slow ones whose logic other tests hold.
SLOW = {"a03_low_information_runs", "tx07_information_kind"}


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES.split():
        found.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql())))
def test_matches_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple("" if r[c] is None else str(r[c]) for c in columns) for r in frame.collect())
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple("" if r[i] is None else str(r[i]) for i in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.FLAGSHIP in catalog.queries()
