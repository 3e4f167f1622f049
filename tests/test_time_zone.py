"""Answers do not move with the session's time zone."""

import pytest

import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["metric_stat", "live_claims", "tree_guard", "budget_alerts", "lifecycle_expiry"])
def test_query_in_another_zone(spark, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert oracle.compare(spark, oracle.connect(FOLDER), name, FOLDER)[0] == "ok"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
