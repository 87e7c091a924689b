"""Queries keep the SQL they are checked with."""

from checks.oracle import ORACLE
from checks.queries import QUERIES


def test_stored_results_are_checked_like_fresh_ones():
    assert "stored_anomalies" in QUERIES and ORACLE["stored_anomalies"] == ORACLE["pseudo_cada"]
