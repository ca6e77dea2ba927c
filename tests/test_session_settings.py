"""Results do not depend on session settings the driver may choose."""

import pytest

from tables import SF_SMALL
from compare import compare

SAMPLE = ["valuation_table", "portfolio_summary", "price_factor_direct", "bucket_share_history",
          "roll_matrix_share", "ledger_sequence"]


@pytest.mark.parametrize("conf", [
    {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"},
    {"spark.sql.caseSensitive": "true", "spark.sql.ansi.enabled": "false"},
    {"spark.sql.autoBroadcastJoinThreshold": "-1"},
])
def test_sample_matches_oracle_under_settings(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        res = compare(spark, SF_SMALL, SAMPLE)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert all(r["status"] == "ok" for r in res.values()), res
