"""Every registered query against its SQL counterpart, at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, db, name):
    outcome, _ = compare(spark, db, SF_DIR, name)
    assert outcome.startswith("equal" if name in oracle_sql() else "no oracle"), outcome
    assert "types differ" not in outcome


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
