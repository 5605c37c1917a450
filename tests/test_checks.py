"""Every query with an SQL form against that SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from starpath.plans.catalog import QUERIES
from tests.compare import connect, normal

FOLDER = os.environ.get("STARPATH_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns, rows = normal(df.columns, [tuple(row) for row in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    expected_columns, expected = normal([item[0] for item in result.description], result.fetchall())
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert [(a, b) for a, b in zip(rows, expected) if a != b][:3] == []
    assert len(rows) > 0


def test_only_model_training_has_no_sql():
    assert set(QUERIES) - set(entry.oracle_sql()) == {"als_recommend", "als_grid"}
