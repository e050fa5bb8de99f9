"""Every registered query against its SQL, on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry
from oracles.compare import connect, differences

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_fitted_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "sf, rows, events, own_goals, bare",
    [("0.001", 14996, 13399, 34, 360), ("0.01", 70615, 54632, 292, 3231)],
)
def test_fixture_counts(spark, sf, rows, events, own_goals, bare):
    from touchline.operators.events import explode_qualifiers
    from touchline.sources import fixture

    raw = fixture.touches(spark, f"/root/testdata/sf{sf}")
    flat = explode_qualifiers(raw)
    assert flat.count() == rows
    assert raw.select("eventid").distinct().count() == events
    assert flat.filter("typeid = 16 AND type = 28").count() == own_goals
    assert flat.filter("type IS NULL").count() == bare
