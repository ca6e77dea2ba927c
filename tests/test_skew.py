"""Hot keys: a loan / a (loan, month) cell holding most of the rows."""

import pytest
from pyspark.sql import functions as F

from tables import ledger_rows
from loanroll.operators import ledger as L


def _hot_ledger(spark):
    rows = [(1, 20200131 + 100 * m, 70, float(m), 0.0, 0.0, 0) for m in range(6)]
    rows += [(1, 20200331, 70, 1000.0 + i, 0.0, 0.0, 0) for i in range(600)]   # hot duplicated cell
    rows += [(1, 20200430, 70, 7.0, 0.0, 0.0, 0)] * 300                         # and one of equal rows
    rows += [(2, 20200131, 10, 5.0, 0.0, 0.0, 0), (2, 20200229, 70, 0.0, 0.0, 0.0, 0)]
    return ledger_rows(spark, rows)


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_sequence_is_gapless_and_ordered_with_hot_cells(spark, hot_rows):
    seq = L.with_sequence(_hot_ledger(spark), hot_rows=hot_rows).collect()
    by_loan = {}
    for r in seq:
        by_loan.setdefault(r["credito"], []).append((r["orden"], r["id_fecha"], r["saldo_capital"]))
    assert {k: len(v) for k, v in by_loan.items()} == {1: 906, 2: 2}
    for rows in by_loan.values():
        rows.sort()
        assert [o for o, _, _ in rows] == list(range(1, len(rows) + 1))
        keys = [(d, c) for _, d, c in rows]
        assert keys == sorted(keys)


def test_both_ways_of_numbering_agree(spark):
    ledger = _hot_ledger(spark)
    columns = [*ledger.columns, "orden", "_ultima"]
    plain, split = (sorted(map(tuple, L.with_sequence(ledger, hot_rows=n, last_date=True).select(*columns).collect()), key=str)
                    for n in (1_000_000, 100))
    assert plain == split
    profiles = [sorted(map(tuple, L.loan_profile(L.with_sequence(ledger, hot_rows=n, last_date=True)).collect()), key=str)
                for n in (1_000_000, 100)]
    assert profiles[0] == profiles[1]


def test_a_hot_loan_is_spread_over_range_partitions(spark):
    ledger = _hot_ledger(spark).filter("credito = 1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small partitions are merged
    try:
        ranged = L._number_by_ranges(ledger, L.sequence_order(ledger))
        plan = ranged._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "_tramo" in plan
    assert ranged.agg(F.max("orden")).first()[0] == 906


def test_tie_break_comes_before_the_declared_order(spark):
    rows = [(1, 20200131, 70, 5.0, 1.0, 0.0, 0), (1, 20200131, 70, 4.0, 2.0, 0.0, 0)]
    seq = L.with_sequence(ledger_rows(spark, rows), tie_break=("saldo_interes",)).orderBy("orden").collect()
    assert [r["saldo_interes"] for r in seq] == [1.0, 2.0]
    seq = L.with_sequence(ledger_rows(spark, rows)).orderBy("orden").collect()
    assert [r["saldo_capital"] for r in seq] == [4.0, 5.0]
