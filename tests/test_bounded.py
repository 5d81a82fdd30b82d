"""Plans whose memory and shuffles don't grow by an estimate of Spark's."""

import pytest

from lorekeep.plans import QUERIES


@pytest.mark.parametrize("name", ["upsert_replace", "two_way_sync", "sync_missing", "scan_diff"])
def test_stores_are_dealt_not_broadcast(spark, sf, name):
    """F16, F17: a side whose file is small was broadcast, so that each task held all of it."""
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
