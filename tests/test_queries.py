"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, name):
    result, _ = compare(spark, folder, name, ORACLES.get(name))
    assert result.startswith(("ok", "rows")), result
    assert not result.endswith(" 0"), "an empty result checks nothing"


def test_entry_has_rows(spark, folder):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
