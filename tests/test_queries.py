import pytest

from oracle import SF, compare
from tidegap.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE[name]) > 0


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLE)


def test_known_counts(spark):
    if not SF.endswith("sf0.01"):
        pytest.skip("counts are of sf0.01")
    counts = {"albums_auto_by_user": 691, "albums_auto_global": 461, "albums_session_window": 3292}
    for name, n in counts.items():
        assert QUERIES[name](spark, SF).count() == n
