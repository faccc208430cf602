"""Every registered query against its SQL on the smallest tables."""
import pytest

from check import compare
from conftest import SF
from spatialscore.plans.catalogue import CHECKS, QUERIES

# Whole-table fits without SQL take longest and have their own tests.
ROWS_ONLY = sorted(set(QUERIES) - set(CHECKS))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, name):
    message, _ = compare(QUERIES[name](spark, SF), con, CHECKS[name])
    assert message is None, message


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
