
import math

import pytest
from pyspark.sql import functions as F

from tables import SF_SMALL
from loanroll.operators import rolling as RM
from loanroll.plans.registry import fixture_params
from loanroll.plans.reports import RollReport, ValuationReport
from loanroll.sources.fixtures import fixture_sources


@pytest.fixture(scope="module")
def src(spark):
    return fixture_sources(spark, SF_SMALL)


def test_roll_shares_sum_to_one(spark, src):
    rm = RollReport(src, fixture_params())
    for r in rm.check.collect():
        assert math.isnan(r["row_sum"]) or r["row_sum"] == pytest.approx(1.0)


def test_units_total_equals_common_bucketed_loans(spark, src):
    rm = RollReport(src, fixture_params())
    total = sum(sum(r[b] for b in RM.BUCKETS) for r in rm.units.collect())
    (y0, m0), (y1, m1) = rm.params.months
    pairs = RM.roll_pairs(rm.product_rows, (y0, m0), (y1, m1))
    assert total == pairs.filter(F.col("bucket_t0").isNotNull() & F.col("bucket_t1").isNotNull()).count()
    assert rm.common.count() == pairs.count()


def test_active_plus_inactive_is_priced(spark, src):
    nv = ValuationReport(src, fixture_params())
    assert nv.active.count() + nv.inactive.count() == nv.priced.count() >= nv.tape.count()


def test_full_bucket_shares_sum_to_one(spark, src):
    rm = RollReport(src, fixture_params(include_over_360=True))
    # months without gaps in days or capital; a gap makes its bucket's share missing
    rm.__dict__["product_rows"] = rm.product_rows.filter("saldo_capital IS NOT NULL AND numero_dias_mora IS NOT NULL")
    for r in rm.share_history.collect():
        total = sum(r[b] for b in RM.BUCKETS if r[b] is not None and not math.isnan(r[b]))
        assert total == pytest.approx(1.0) or total == 0.0


def test_origin_duration_at_least_one(spark, src):
    nv = ValuationReport(src, fixture_params())
    assert nv.profile.filter(F.col("Duracion_p10") < 1).count() == 0
    assert nv.profile.filter(F.col("Duracion_p70") < 1).count() == 0


def test_the_fixture_can_tell_right_from_wrong(spark, src):
    """What the registered queries need to be able to fail (see FIXTURES.md)."""
    ledger = src.ledger_month
    for c in ("id_fecha", "credito", "id_fecha_desembolso", "numero_dias_mora", "saldo_capital", "saldo_interes"):
        assert not ledger.filter(F.col(c).isNull()).isEmpty(), c
    assert not ledger.filter("saldo_cargo_1 > 0 AND saldo_interes < 0").isEmpty()
    assert not ledger.groupBy("credito", "id_fecha").count().filter("count > 1").isEmpty()
    profile = ValuationReport(src, fixture_params()).profile
    assert not profile.filter("Fecha_desembolso <> Fecha_desembolso_media").isEmpty()


def test_sheets_are_written_in_order(spark, src):
    from loanroll.session import scratch_dir
    from loanroll.sources import sinks

    path = sinks.write_bundle({"x": src.ledger_month.select("credito", "id_fecha")}, scratch_dir(spark, "t-sorted"))["x"]
    parts = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("f"), "Credito").collect()
    firsts = {}
    for r in parts:
        firsts.setdefault(r["f"], []).append(-1 if r["Credito"] is None else r["Credito"])
    for f in firsts.values():
        assert f == sorted(f)
    ordered = [firsts[f] for f in sorted(firsts)]
    assert all(a[-1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False))
