"""Every registered query with an SQL twin agrees with it at the smallest scale."""

import pytest

from flowloom.plans.catalog import ORACLES, QUERIES
from flowloom.plans.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, duck, key):
    verdict = compare(spark, duck, QUERIES[key], ORACLES[key], SF)
    assert verdict.startswith("ok"), verdict


def test_every_query_is_checked_or_known_to_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"j1", "k5", "k6"}


@pytest.mark.parametrize("key", ["a16", "f14", "h13"])
def test_response_queries_match_where_targets_are_rejected(spark, key):
    """At the smallest scale no supplier lies outside the lab networks."""
    larger = "/root/testdata/sf0.01"
    con = connect(larger)
    try:
        taken = {r["actual_action"] for r in QUERIES["a16"](spark, larger).select("actual_action").distinct().collect()}
        assert taken == {"alerted", "would_block", "rejected"}
        verdict = compare(spark, con, QUERIES[key], ORACLES[key], larger)
    finally:
        con.close()
    assert verdict.startswith("ok"), verdict
