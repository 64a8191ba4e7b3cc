"""Queries that SQL can express, against their SQL."""
import pytest

import __spark_entry__ as entry
from rosterlake.llm import queries
from tests.compare import compare
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_matches_sql(spark, con, name):
    state, n, _, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok", note
    assert n > 0
