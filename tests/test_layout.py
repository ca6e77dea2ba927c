"""The ledger's stored layout, and the per-loan state merged month by month."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from tables import SF_MID, SF_SMALL, ledger_rows

from loanroll.operators import ledger as L
from loanroll.operators import state as S
from loanroll.plans.registry import fixture_params, queries
from loanroll.plans.reports import RollReport, ValuationReport
from loanroll.session import scratch_dir
from loanroll.sources import layout, readers
from loanroll.sources.fixtures import staged_sources


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["ledger_sequence", "valuation_table", "recovery_rate_combined", "adjusted_capital_v1", "first_last_observation"])
def test_no_exchange_of_the_ledger(spark, key):
    """Every exchange stands above the per-loan aggregate (or there is none): the ledger's rows stay in their buckets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(queries()[key](spark, SF_SMALL)).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (scan,) = (i for i, x in enumerate(lines) if "FileScan" in x and "loanroll_ledger_" in x)
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    path, at = [], depth[scan]
    for i in range(scan, -1, -1):  # from the scan up to the root
        if depth[i] < at or i == scan:
            path.append(lines[i])
            at = depth[i]
    own = next((k for k, x in enumerate(path) if "HashAggregate" in x or "Window" in x), len(path))
    while own + 1 < len(path) and any(w in path[own + 1] for w in ("HashAggregate", "Window", "Project", "Filter", "Sort", "WholeStage")):
        own += 1
    assert not any("Exchange" in x for x in path[:own + 1]), "\n".join(x[:120] for x in path)
    assert "Bucketed: true" in lines[scan]


@pytest.fixture(scope="module")
def stored(spark):
    src = staged_sources(spark, SF_SMALL)
    table = "t_ledger_" + uuid.uuid4().hex[:8]
    rows = src.ledger_month.drop(*layout.PERIOD_COLUMNS)
    layout.store_ledger(rows, table, 5, path=scratch_dir(spark, "t-layout"))
    yield rows, table
    spark.sql(f"DROP TABLE {table}")


def test_the_stored_ledger_is_the_ledger(spark, stored):
    rows, table = stored
    back, largest = layout.stored_ledger(spark, table)
    assert sorted(map(tuple, back.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert largest == max(r["count"] for r in rows.groupBy("credito").count().collect())
    files = [f for f in back.inputFiles()]
    assert len(files) == len(set(files)) == back.select("id_fecha_mes", F.expr("pmod(hash(credito), 5)")).distinct().count()


def test_a_month_reads_its_folder(spark, stored):
    rows, table = stored
    ledger, _ = layout.stored_ledger(spark, table)
    month = ledger.filter(L.month_range(2000, 10) & layout.in_period(ledger, 2000, 10))
    assert "PartitionFilters: [isnotnull(id_fecha_mes" in _plan(month)
    plain = rows.filter(L.month_range(2000, 10) & layout.in_period(rows, 2000, 10))
    assert month.count() == plain.count() > 0


def test_reports_on_the_stored_table(spark, stored):
    rows, table = stored
    base, paths = scratch_dir(spark, "t-layout-src"), {"ledger_month": f"table:{table}"}
    staged = staged_sources(spark, SF_SMALL)
    for name in ("ledger_day", "ltv", "restructuring_mark", "collections", "purchase_tape_raw"):
        getattr(staged, name).write.parquet(f"{base}/{name}")
        paths[name] = f"{base}/{name}"
    src = readers.warehouse_sources(spark, paths)
    assert src.max_loan_rows is not None
    for make in (lambda s: ValuationReport(s, fixture_params()).valued, lambda s: RollReport(s, fixture_params()).units,
                 lambda s: RollReport(s, fixture_params()).one_hot_common):
        assert sorted(str(tuple(r)) for r in make(src).collect()) == sorted(str(tuple(r)) for r in make(staged).collect())


def _rows(df, columns=None):
    return sorted(map(tuple, df.select(*(columns or sorted(df.columns))).collect()), key=str)


def test_every_months_state_is_the_whole_recomputation(spark):
    """Months are merged one after the other; after each the profile is that of all rows so far."""
    rng, rows = random.Random(11), []
    for loan in (1, 2, 3, 4, 5, None):
        for m in range(1, 9):
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                rows.append((loan, 20200001 + 100 * m + rng.choice([27, 28]), rng.choice([70, 70, 10, 71]), rng.choice([0.0, 1.0, 5.0]),
                             rng.choice([0.0, 2.0]), 0.0, rng.randint(0, 400)))
    rows += [(1, None, 70, 3.0, 0.0, 0.0, 1), (2, None, 10, 4.0, 0.0, 0.0, 2), (6, None, 70, 4.0, 0.0, 0.0, 2), (6, None, 10, 7.0, 0.0, 0.0, 2)]
    ledger = ledger_rows(spark, rows).withColumn("id_fecha_desembolso", F.when(F.col("saldo_capital") < 5, F.col("id_fecha_desembolso") + F.col("numero_dias_mora")))
    month = F.expr("id_fecha DIV 100")
    state = S.loan_state(ledger.filter(F.col("id_fecha").isNull() | (month <= 202002)))
    for m in range(3, 9):
        state = S.merge(state, S.loan_state(ledger.filter(month == 202000 + m)))
        whole = L.loan_profile(ledger.filter(F.col("id_fecha").isNull() | (month <= 202000 + m)))
        got = S.profile(state)
        assert sorted(got.columns) == sorted(whole.columns) and _rows(got) == _rows(whole), m
        state = spark.createDataFrame(state.collect(), state.schema)
    both = S.merge(S.loan_state(ledger.filter(F.col("id_fecha").isNull() | (month <= 202004))), S.loan_state(ledger.filter(month > 202004)))
    assert _rows(S.profile(both)) == _rows(L.loan_profile(ledger))
    whole = S.loan_state(ledger)
    assert _rows(S.profile(whole, strict_na=False)) == _rows(L.loan_profile(ledger, strict_na=False)) and _rows(both) == _rows(whole)


def test_late_rows_are_refused(spark):
    first = S.loan_state(ledger_rows(spark, [(1, 20200131, 70, 1.0, 0.0, 0.0, 0), (2, 20200229, 70, 1.0, 0.0, 0.0, 0)]))
    fine = S.loan_state(ledger_rows(spark, [(1, 20200229, 70, 1.0, 0.0, 0.0, 0), (3, 20200131, 70, 1.0, 0.0, 0.0, 0)]))
    assert S.merge(first, fine).count() == 3
    for row in ((1, 20200131, 70, 1.0, 0.0, 0.0, 0), (2, None, 70, 1.0, 0.0, 0.0, 0)):
        with pytest.raises(Exception, match="not later"):
            S.merge(first, S.loan_state(ledger_rows(spark, [row]))).collect()


def test_only_the_months_folder_is_read(spark):
    src = staged_sources(spark, SF_MID)
    ledger = src.ledger_month
    rows = ledger.filter(L.month_range(1998, 5) & layout.in_period(ledger, 1998, 5))
    plan = _plan(S.loan_state(rows, max_loan_rows=src.max_loan_rows))
    assert "PartitionFilters: [isnotnull(id_fecha_anio" in plan and plan.count("FileScan") == 1


def test_stored_states_month_by_month(spark):
    """A state that was stored months ago is merged with each month since; each month's state stays readable."""
    src, folder = staged_sources(spark, SF_SMALL), scratch_dir(spark, "t-states")
    ledger = src.ledger_month
    assert S.stored_state(spark, folder) is None
    S.advance(ledger, folder, 200012)
    state = S.advance(ledger, folder, 200103)
    assert S.stored_state(spark, folder)[1] == 200103 and S.stored_state(spark, folder, 200101)[1] == 200101
    assert S.stored_state(spark, folder, 200011) is None
    for until, found in ((200103, state), (200101, S.stored_state(spark, folder, 200101)[0])):
        rows = ledger.drop(*layout.PERIOD_COLUMNS).filter(F.col("id_fecha").isNull() | (F.expr("id_fecha DIV 100") <= until))
        assert [str(x) for x in _rows(S.profile(found))] == [str(x) for x in _rows(L.loan_profile(rows))]
    assert S.months_between(200011, 200102) == [200012, 200101, 200102] and S.months_between(200102, 200102) == []


def test_reports_from_a_stored_state(spark):
    from dataclasses import replace

    from loanroll.plans.reports import ExtractReport
    from loanroll.plans.run import run_all

    src, folder, out = staged_sources(spark, SF_SMALL), scratch_dir(spark, "t-states2"), scratch_dir(spark, "t-states-out")
    S.advance(src.ledger_month, folder, 200105)
    paths = run_all(spark, src, fixture_params(), out, folder)
    assert S.stored_state(spark, folder)[1] == 200106
    cut = replace(src, ledger_month=src.ledger_month.filter("id_fecha IS NULL OR id_fecha <= 20010630"))
    summary = spark.read.parquet(paths["Resumen"])
    plain = ValuationReport(cut, fixture_params()).summary
    assert sorted(str(tuple(r)) for r in summary.collect()) == sorted(str(tuple(r)) for r in plain.collect())
    extract = ExtractReport(src, fixture_params(), state=S.stored_state(spark, folder)[0]).extract
    assert sorted(str(tuple(r)) for r in extract.collect()) == sorted(str(tuple(r)) for r in ExtractReport(cut, fixture_params()).extract.collect())


def test_lineitem_is_exchanged_once_into_the_buckets(spark, monkeypatch):
    """one exchange of lineitem, no partial aggregate ahead of it, and as many buckets as the rows ask for."""
    from loanroll.sources import fixtures

    monkeypatch.setattr(fixtures, "LEDGER_BUCKETS", 4)
    few = fixtures.ledger_buckets(spark, SF_SMALL)
    monkeypatch.setattr(fixtures, "BUCKET_ROWS", 500)
    many = fixtures.ledger_buckets(spark, SF_SMALL)
    assert few == 4 and many == -(-spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count() // 500) > 8
    ledger = fixtures.ledger_month(spark, SF_SMALL, many)
    lines = _plan(ledger).split("\n")
    assert [x for x in lines if "Exchange" in x] == [x for x in lines if f"Exchange hashpartitioning(d" in x and f", {many}), REPARTITION_BY_NUM" in x] != []
    assert not any("Aggregate" in x for x in lines[next(i for i, x in enumerate(lines) if "Exchange" in x):])
    staged = fixtures.stage(fixtures.fixture_sources(spark, SF_SMALL, many), scratch_dir(spark, "t-buckets"), many)
    rounded = [f"round({n}, 6) AS {n}" if t == "double" else n for n, t in ledger.dtypes]  # sums follow the order of addition
    assert _rows(staged.ledger_month.selectExpr(*rounded)) == _rows(ledger.selectExpr(*rounded))
    files = len(staged.ledger_month.inputFiles())
    cells = staged.ledger_month.select("id_fecha_anio", F.expr(f"pmod(hash(credito), {many})")).distinct().count()
    years = staged.ledger_month.select("id_fecha_anio").distinct().count()
    assert cells <= files <= cells + years * (many // 4 - 1)  # only the loan without an id lies in several files of a cell
    loans = [r[0] for r in ledger.select("credito").distinct().orderBy("credito").limit(5).collect()]
    for loan in loans:  # by the pruned bucket
        own = F.col("credito").eqNullSafe(F.lit(loan).cast("bigint"))
        assert staged.ledger_month.filter(own).count() == ledger.filter(own).count() > 0
    assert None in loans


def test_zero_start_history_leaves_the_ledger_in_its_buckets(spark):
    """the join needs no exchange of either side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(queries()["zero_start_history"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Bucketed: true") == 2 and "Exchange" not in plan, plan


@pytest.mark.parametrize("na_capital", [0.0, 5.0, None])
def test_zero_start_history_of_the_loan_without_an_id(spark, na_capital):
    """its rows are kept if it is a zero-start loan itself, once each, whatever the others are."""
    rows = [(None, 20200131, 70, na_capital, 0.0, 0.0, 0), (None, 20200229, 10, 3.0, 0.0, 0.0, 0), (None, None, 10, 3.0, 0.0, 0.0, 0),
            (1, 20200131, 70, 0.0, 0.0, 0.0, 0), (1, 20200229, 70, 2.0, 0.0, 0.0, 0), (2, 20200131, 70, 4.0, 0.0, 0.0, 0), (3, 20200131, 10, 0.0, 0.0, 0.0, 0)]
    seq = L.with_sequence(ledger_rows(spark, rows))
    profile = L.loan_profile(ledger_rows(spark, rows))
    whole = [(None, 1), (None, 2), (None, 3)] if na_capital == 0.0 else []
    for p in (profile, profile.unionByName(profile)):
        assert _rows(L.zero_start_history(seq, p), ["credito", "orden"]) == sorted([(1, 1), (1, 2), *whole], key=str)
