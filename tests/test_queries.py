"""Every registered query against its SQL counterpart, on whole tables."""

from __future__ import annotations

import os

import compare
import pytest

from __spark_entry__ import SMOKE_FOLDER, entry, oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", SMOKE_FOLDER)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    frame = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert frame.collect()
    else:
        assert compare.differences(frame, connection, sql) == []


def test_entry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
