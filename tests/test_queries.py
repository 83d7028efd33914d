"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    fn = entry_points.queries()[name]
    assert compare(spark, con, fn, entry_points.oracle_sql()[name], SF) is None


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    row = entry_points.entry(spark).collect()
    assert len(row) == 1 and row[0]["total"] > 0


def test_golden_candidates(spark):
    rows = entry_points.queries()["golden_candidates"](spark, SF).collect()
    ids = sorted(r["example_id"] for r in rows)
    assert ids == [f"gold_{i:04d}" for i in range(1, len(rows) + 1)]
    assert len({r["conversation_id"] for r in rows}) == len(rows) > 0
    assert all(r["human_intent"] is None for r in rows)
