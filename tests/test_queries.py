"""Every registered query with SQL gives the same rows as DuckDB."""

import os

import pytest

import __spark_entry__  # noqa: F401
import compare
from assaylake.plans.catalog import QUERIES

#: Queries without SQL; none at present.
NO_SQL: set[str] = set()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare.compare(spark, con, FOLDER, name, QUERIES[name])
    assert result["ok"] or name in NO_SQL, result.get("detail") or "no SQL"
