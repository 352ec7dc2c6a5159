"""Every registered query against its SQL on the smallest scale."""

import pytest
from compare import compare

from labelwright.plans import ORACLES, QUERIES

# Columns of these results that depend on more data than the smallest scale has.
EMPTY_AT_SMALL_SCALE = {"token_rejoin", "drift_metrics", "rollback_alerts", "complaints_page", "retrain_triggers", "retrain_gate", "stream_retrain"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    if name in EMPTY_AT_SMALL_SCALE and out == "FAIL no rows":
        return
    assert not out.startswith("FAIL"), out
    assert "types" not in out, out
