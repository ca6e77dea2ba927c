
import re

import pytest

from tables import SF_SMALL
from loanroll.operators import ledger as L
from loanroll.operators import valuation as V
from loanroll.plans.registry import queries
from loanroll.session import scratch_dir
from loanroll.sources import readers
from loanroll.sources.fixtures import fixture_sources
from loanroll.sources.schemas import LEDGER_DAY, LEDGER_MONTH


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Fixture sources written as Parquet tables, the way a warehouse stores them."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    src = fixture_sources(spark, SF_SMALL)
    base = scratch_dir(spark, "plans")
    src.ledger_month.write.partitionBy("id_fecha").parquet(f"{base}/ledger_month")
    src.ledger_day.write.parquet(f"{base}/ledger_day")
    return {
        "ledger_month": readers.read_parquet_table(spark, f"{base}/ledger_month", LEDGER_MONTH),
        "ledger_day": readers.read_parquet_table(spark, f"{base}/ledger_day", LEDGER_DAY),
    }


def test_daily_snapshot_filters_reach_the_scan(stored):
    plan = _plan(V.daily_closing_snapshot(stored["ledger_day"], [20010701, 20010702]))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    for frag in ("tipo_producto", "saldo_capital", "id_fecha", "EqualTo(ind_cierre,1)"):
        assert frag in pushed, pushed
    assert "ReadSchema: struct<id_fecha:int,credito:bigint,tipo_producto:int,saldo_capital:double," \
           "valor_pago_ttl_canc:double,ind_cierre:int>" in plan


def _without_broadcast(spark, build):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(build())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rate_stage_is_one_scan_and_one_exchange(spark, stored):
    """The ledger is read once, in the profile's columns, and exchanged once by loan: numbering and aggregate share it."""
    plan = _without_broadcast(spark, lambda: L.adjusted_recovery_base(L.loan_profile(stored["ledger_month"], max_loan_rows=0)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "valor_garantia" not in plan and "SortAggregate" not in plan
    assert re.search(r"Exchange hashpartitioning\(credito", plan)


@pytest.mark.parametrize("key,scans", [("valuation_table", 1), ("price_factor_direct", 1), ("priced_portfolio_v1", 1),
                                       ("adjusted_capital_v1", 1), ("ledger_sequence", 1), ("zero_start_history", 2),
                                       ("exclude_loans", 2), ("collections_flag", 1), ("product_slice", 1)])
def test_ledger_scans_of_registered_queries(spark, key, scans):
    plan = _without_broadcast(spark, lambda: queries()[key](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet [^\n]*/ledger_month\b", plan)) == scans, plan


def test_sequence_is_one_exchange(stored):
    plan = _plan(L.with_sequence(stored["ledger_month"], max_loan_rows=0))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


@pytest.mark.parametrize("key", ["roll_matrix_units", "bucket_one_hot", "ltv_snapshot", "common_loans", "daily_closing_snapshot"])
def test_registered_queries_prune_partitions(spark, key):
    plan = _plan(queries()[key](spark, SF_SMALL))
    assert re.search(r"PartitionFilters: \[[^\]]*id_fecha", plan), plan


def test_month_filter_prunes_partitions(stored):
    p70 = L.product_slice(stored["ledger_month"])
    plan = _plan(p70.filter(L.month_range(2000, 10)))
    assert "PartitionFilters: [isnotnull(id_fecha" in plan and "20001001" in plan


def test_no_python_udf_cartesian_or_sort_aggregate_in_any_query(spark):
    for name, fn in queries().items():
        if name in ("csv2_roundtrip", "latest_extract") or name.endswith("_written"):
            continue  # these write files when built
        plan = _plan(fn(spark, SF_SMALL))
        assert "PythonUDF" not in plan and "EvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "SortAggregate" not in plan, name
