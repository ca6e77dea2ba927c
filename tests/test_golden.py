"""Hand-written edge rows (FIXTURES.md section 3)."""

import datetime as dt
import math

import pytest
from tables import ledger_rows
from loanroll.functions.calendar import closing_window_keys, previous_month_name, report_month_key
from loanroll.operators import ledger as L
from loanroll.operators import portfolio as P
from loanroll.operators import recovery as R
from loanroll.operators import rolling as RM
from loanroll.operators import valuation as V

NAN, INF = float("nan"), float("inf")


def _rates(spark, rows, baseline="as_written"):
    seq = L.with_sequence(ledger_rows(spark, rows))
    prof = L.loan_profile(seq)
    adj = L.adjusted_recovery_base(prof, baseline)
    return {r["credito"]: r for r in R.all_rates(adj).collect()}


def _months(credito, first, last, n, tipo=70, mora=(0.0, 0.0), cap=None, inte=0.0):
    """n monthly rows; first/last capital and arrears as given, middle rows copy the first."""
    out = []
    for i in range(n):
        key = 20200131 + 100 * i
        c = first if i < n - 1 else last
        m = mora[0] if i < n - 1 else mora[1]
        out.append((credito, key, tipo, c, inte, m, 0))
    return out


def test_capital_nan_arrears_fall(spark):
    r = _rates(spark, _months(1, 0.0, 0.0, 5, mora=(100.0, 40.0)))[1]
    assert math.isnan(r["tasa_recuperacion_anual_capital"])
    assert r["tasa_recuperacion_anual_mora"] == pytest.approx(1.2)
    assert r["tasa_recuperacion_anual"] == pytest.approx(1.2)


def test_arrears_nan_capital_fall(spark):
    r = _rates(spark, _months(2, 100.0, 40.0, 5))[2]
    assert math.isnan(r["tasa_recuperacion_anual_mora"])
    assert r["tasa_recuperacion_anual_capital"] == pytest.approx(1.2)
    assert r["tasa_recuperacion_anual"] == pytest.approx(1.2)


def test_both_zero_gives_nan(spark):
    r = _rates(spark, _months(3, 0.0, 0.0, 3))[3]
    assert math.isnan(r["tasa_recuperacion_anual"])


def test_capital_growth_floors_at_zero(spark):
    r = _rates(spark, _months(4, 0.0, 50.0, 3, mora=(10.0, 10.0)))[4]
    assert r["tasa_recuperacion_anual_capital"] == 0.0


def test_null_last_capital_propagates(spark):
    r = _rates(spark, _months(5, 100.0, None, 3))[5]
    assert r["tasa_recuperacion_anual_capital"] is None
    assert r["tasa_recuperacion_anual"] is None  # arrears NaN -> takes capital (NA)


def test_exposure_rate_as_written_and_initial(spark):
    rows = _months(6, 100.0, 40.0, 3)
    assert _rates(spark, rows)[6]["tasa_recuperacion_anual_exp"] == 0.0
    assert _rates(spark, rows, "initial")[6]["tasa_recuperacion_anual_exp"] == pytest.approx(1.8)


def test_zero_start_one_month_takes_prior_balance(spark):
    rows = [(7, 20200131, 10, 80.0, 0.0, 0.0, 0), (7, 20200229, 70, 0.0, 0.0, 0.0, 0)]
    r = _rates(spark, rows)[7]
    assert r["Saldo_exposicion_inicial"] == 80.0
    assert r["prop_recuperado_exposicion"] == 1.0
    assert r["tasa_recuperacion_anual_exp"] == pytest.approx(6.0)
    assert r["Duracion_p10"] == 2


def test_zero_start_without_prior_gives_na(spark):
    r = _rates(spark, [(8, 20200131, 70, 0.0, 0.0, 0.0, 0)])[8]
    assert r["Saldo_exposicion_inicial"] is None
    assert r["tasa_recuperacion_anual_exp"] is None


@pytest.mark.parametrize("rate,ltv,months,want", [
    (1.2, 0.5, 4, 3.3), (0.0, 0.5, 4, 2.2), (0.0, 0.7, 4, 1.0), (0.5, 0.0, 4, INF),
    (NAN, 0.5, 4, NAN), (0.3, None, 4, 1.3),
])
def test_price_factor_inverse(spark, rate, ltv, months, want):
    df = spark.createDataFrame([(rate, ltv, months)], "r double, ltv double, d int")
    got = df.select(V.price_factor_inverse("r", "ltv", "d")).first()[0]
    assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want)


@pytest.mark.parametrize("rate,ltv,months,want", [(0.0, 2.0, 4, 2.5), (1.0, 2.0, 4, 3.0), (0.2, 0.5, 4, 1.2)])
def test_price_factor_direct(spark, rate, ltv, months, want):
    df = spark.createDataFrame([(rate, ltv, months)], "r double, ltv double, d int")
    assert df.select(V.price_factor_direct("r", "ltv", "d")).first()[0] == pytest.approx(want)


def test_live_70_zero_price_uplift_is_zero(spark):
    df = spark.createDataFrame([(1, 70, 10.0, 0.0, 0.0, 0.0, 0.0)],
                               "credito long, tipo_producto int, saldo_actual double, precio_compra double, "
                               "Precio_y_valoracion_mod double, Precio_y_valoracion double, "
                               "Precio_y_valoracion_capital double")
    assert P.live_product_70(df).first()["valoracion_con_garantia"] == 0.0


def test_empty_residual_summary_is_one_row(spark):
    df = spark.createDataFrame([], "credito long, valor_pago_ttl_canc double, saldo_actual double, "
                                   "precio_compra double, Precio_y_valoracion double")
    rows = P.residual_summary(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["Creditos"], r["Deuda_total"], r["Saldo_a_capital"], r["Precio_de_compra"], r["Valoracion"]) == \
        (0, 0.0, 0.0, 0.0, 0.0)
    assert math.isnan(r["p"])


def test_dpd_buckets(spark):
    days = [0.0, 1.0, 30.0, 31.0, 360.0, 361.0, 30.5, -1.0, None]
    want = ["ICV0", "ICV30", "ICV30", "ICV60", "ICV360", "ICV360+", None, None, None]
    df = spark.createDataFrame([(d,) for d in days], "d double")
    assert [r[0] for r in df.select(RM.dpd_bucket("d")).collect()] == want


def test_roll_matrix_edges(spark):
    rows = [
        (1, 20201031, 70, 1.0, 0.0, 0.0, 0), (1, 20201130, 70, 1.0, 0.0, 0.0, 45),   # ICV0 -> ICV60
        (2, 20201031, 70, 1.0, 0.0, 0.0, 0),                                          # t0 only
        (3, 20201031, 70, 1.0, 0.0, 0.0, 400), (3, 20201130, 70, 1.0, 0.0, 0.0, 400),  # ICV360+ stays
    ]
    p70 = L.product_slice(L.with_sequence(ledger_rows(spark, rows)))
    units = {r["bucket_from"]: r for r in RM.roll_matrix_units(p70, (2020, 10), (2020, 11)).collect()}
    assert len(units) == 14
    assert units["ICV0"]["ICV60"] == 1 and units["ICV360+"]["ICV360+"] == 1
    assert sum(sum(r[b] for b in RM.BUCKETS) for r in units.values()) == 2
    share = {r["bucket_from"]: r for r in RM.roll_matrix_share(RM.roll_matrix_units(p70, (2020, 10), (2020, 11))).collect()}
    assert share["ICV0"]["ICV60"] == 1.0
    assert math.isnan(share["ICV30"]["ICV30"])


def test_calendar_january_wraps():
    as_of = dt.date(2025, 1, 10)
    assert report_month_key(as_of) == 20241231
    assert closing_window_keys(as_of) == [20250101, 20250102, 20250103, 20250104, 20250105]
    assert previous_month_name(as_of) == "Diciembre"


def test_null_payoff_and_no_rate_are_inactive(spark):
    tape = spark.createDataFrame([(1, 10.0, 3.0), (2, 10.0, 3.0)],
                                 "credito long, suma_importe_base double, precio_compra double")
    valued = spark.createDataFrame(
        [(1, None, 70, 1.0, 1.0, 1.0)],
        "credito long, valor_pago_ttl_canc double, tipo_producto int, Valoracion_pd double, "
        "Valoracion_pd_mod double, Valoracion_pd_cap double")
    priced = V.priced_portfolio(tape, valued)
    inactive = {r["credito"]: r for r in P.inactive_loans(priced).collect()}
    assert set(inactive) == {1, 2}
    assert inactive[2]["tipo_producto"] is None
    assert P.active_loans(priced).count() == 0


def test_first_mark_collation_option(spark):
    marks = spark.createDataFrame([(1, 20200101, "s", 1), (1, 20200102, "r", 2), (2, 20200101, "R", 3)],
                                  "credito long, id_fecha int, marcacion string, id_marca long")
    binary = {r["credito"]: r["marc_desc"] for r in V.first_restructuring_mark(marks).collect()}
    lcase = {r["credito"]: r["marc_desc"] for r in V.first_restructuring_mark(marks, case_insensitive=True).collect()}
    assert binary == {1: "Reestructuracion", 2: "Refinanciacion"}   # 's' is not 'S', 's' kept first
    assert lcase == {1: "Refinanciacion", 2: "Refinanciacion"}


def test_first_mark_keeps_missing_dates_and_ids(spark):
    """A mark without a date, or without an id, is ordered first, as ROW_NUMBER() orders it."""
    marks = spark.createDataFrame(
        [(1, None, "R", 5), (1, 20200101, "T", 1), (2, None, "T", 1), (3, 20200101, "R", None), (3, 20200101, "T", 1),
         (4, 20200101, "S", None), (4, 20200102, "R", 2), (5, 20200101, None, 1), (6, 20200101, "T", None), (6, 20200101, "R", None)],
        "credito long, id_fecha int, marcacion string, id_marca long")
    got = {r["credito"]: r["marc_desc"] for r in V.first_restructuring_mark(marks).collect()}
    assert got == {1: "Refinanciacion", 2: "Reestructuracion", 3: "Refinanciacion", 4: "Refinanciacion", 6: "Refinanciacion"}


def test_sequence_with_missing_dates_and_ids(spark):
    rows = [(1, None, 70, float(i), 0.0, 0.0, 0) for i in range(4)] + [(1, 20200131, 70, 1.0, 0.0, 0.0, 0), (1, 20200229, 70, 1.0, 0.0, 0.0, 0)]
    rows += [(None, 20200131 + 100 * i, 70, 1.0, 0.0, 0.0, 0) for i in range(3)]
    for hot_rows in (1_000_000, 2):
        seq = L.with_sequence(ledger_rows(spark, rows), hot_rows=hot_rows).collect()
        assert sorted(r["orden"] for r in seq if r["credito"] == 1) == [1, 2, 3, 4, 5, 6]
        assert sorted(r["orden"] for r in seq if r["credito"] is None) == [1, 2, 3]
        assert [r["orden"] for r in seq if r["id_fecha"] == 20200229] == [6]


def test_profile_skips_missing_dates_but_span_does_not(spark):
    rows = [(1, None, 70, 9.0, 0.0, 0.0, 0), (1, 20200131, 70, 5.0, 0.0, 0.0, 0), (1, 20200229, 70, 3.0, 0.0, 0.0, 0)]
    r = L.loan_profile(ledger_rows(spark, rows)).first()
    assert r["saldo_capital_inicial"] == 5.0 and r["saldo_capital_actual"] == 3.0
    assert r["fecha_inicio_p70"] is None and r["fecha_vigencia"] is None and r["Duracion_p70"] == 3 and r["Duracion_p10"] == 1


def test_profile_of_two_products_in_one_month(spark):
    """The product-10 row of the same month comes first in the declared order, so the first product-70 row is number 2."""
    rows = [(1, 20200131, 70, 5.0, 0.0, 0.0, 0), (1, 20200131, 10, 7.0, 0.0, 0.0, 0)]
    ledger = ledger_rows(spark, rows)
    for numbered in (ledger, L.with_sequence(ledger, last_date=True), L.with_sequence(ledger, hot_rows=1, last_date=True)):
        assert L.loan_profile(numbered).first()["Duracion_p10"] == 2


def test_zero_start_ignores_rows_without_a_date(spark):
    rows = [(1, None, 70, 8.0, 0.0, 0.0, 0), (1, 20200131, 70, 0.0, 0.0, 0.0, 0)]
    assert [r["credito"] for r in L.zero_start_loans(L.recovery_base(L.loan_profile(ledger_rows(spark, rows)))).collect()] == [1]


def test_last_two_rows_fan_out(spark):
    rows = [(1, 20200131, 70, 0.0, 0.0, 0.0, 0), (1, 20200229, 10, 6.0, 0.0, 0.0, 0), (1, 20200331, 10, 7.0, 0.0, 0.0, 0),
            (2, 20200131, 10, 5.0, 0.0, 0.0, 0), (2, 20200229, 70, 0.0, 0.0, 0.0, 0), (3, 20200131, 70, 0.0, 0.0, 0.0, 0),
            (4, 20200131, 10, 4.0, 0.0, 0.0, 0), (4, 20200229, 70, 1.0, 0.0, 0.0, 0)]
    profile = L.loan_profile(ledger_rows(spark, rows))
    got = sorted((r["credito"], r["capital_ant"]) for r in L.last_two_non_product(profile).collect())
    assert got == [(1, 6.0), (1, 7.0), (2, 5.0)]
    adjusted = sorted((r["credito"], r["Saldo_capital_inicial"]) for r in L.adjusted_capital_v1(profile).collect() if r["credito"] != 3)
    assert adjusted == [(1, 6.0), (1, 7.0), (2, 5.0), (4, 1.0)]
    assert [r["Saldo_capital_inicial"] for r in L.adjusted_capital_v1(profile).collect() if r["credito"] == 3] == [None]


def test_one_hot_has_one_row_a_loan_and_month(spark):
    """Repeats are settled by the latest date of the month, then the lowest sequence number."""
    rows = [(1, 20200131, 70, 5.0, 0.0, 0.0, 40), (1, 20200130, 70, 5.0, 0.0, 0.0, 100), (1, 20200131, 70, 5.0, 0.0, 0.0, 10),
            (1, 20200229, 70, 5.0, 0.0, 0.0, 0), (2, 20200131, 70, 1.0, 0.0, 0.0, 400), (3, 20200229, 70, 1.0, 0.0, 0.0, 5),
            (4, 20200131, 70, 1.0, 0.0, 0.0, -3), (4, 20200229, 70, 1.0, 0.0, 0.0, 70),
            (None, 20200131, 70, 1.0, 0.0, 0.0, 20), (None, 20200229, 70, 1.0, 0.0, 0.0, 50)]
    months = ((2020, 1), (2020, 2))
    ledger = ledger_rows(spark, rows)
    for p70 in (ledger, L.with_sequence(ledger)):
        hot = {(r["mes"], r["credito"]): [b for b in RM.BUCKETS if r[b]] for r in RM.bucket_one_hot(p70, *months).collect()}
        assert hot == {("01", 1): ["ICV30"], ("02", 1): ["ICV0"], ("01", 2): ["ICV360+"], ("02", 3): ["ICV30"], ("01", 4): [],
                       ("02", 4): ["ICV90"], ("01", None): ["ICV30"], ("02", None): ["ICV60"]}
        common = [(r["mes"], r["credito"]) for r in RM.bucket_one_hot_common(p70, *months).collect()]
        assert sorted(common, key=str) == sorted([(m, c) for m in ("01", "02") for c in (1, 4, None)], key=str)
        assert len(common) == 2 * RM.common_loans(p70, *months).count()
        units = {r["bucket_from"]: r["ICV0"] + r["ICV60"] for r in RM.roll_matrix_units(p70, *months).collect()}
        assert units["ICV30"] == 2 and sum(units.values()) == 2


def test_sequence_numbers_beyond_32_bits(spark):
    """First and last rows of a loan whose numbers begin above 2^31, ties by the lowest number."""
    far = 1 << 33
    rows = [(1, 20200131, 70, 10.0, 0.0, 0.0, 1), (1, 20200131, 70, 11.0, 0.0, 0.0, 2), (1, 20200229, 10, 12.0, 0.0, 0.0, 3),
            (1, 20200331, 70, 13.0, 0.0, 0.0, 4), (1, 20200331, 70, 14.0, 0.0, 0.0, 5)]
    seq = L.with_sequence(ledger_rows(spark, rows), last_date=True)
    assert dict(seq.dtypes)["orden"] == "bigint"
    near, moved = (L.loan_profile(s).first().asDict() for s in (seq, seq.withColumn("orden", seq["orden"] + far)))
    assert moved["Duracion_p10"] == near["Duracion_p10"] + far
    assert moved["saldo_capital_inicial"] == 10.0 and moved["saldo_capital_actual"] == 13.0 and moved["saldo_ant"] == 12.0
    assert moved["_previo_capital"] == 12.0 and moved["_ultimo_capital"] == 13.0
    assert {k: v for k, v in moved.items() if k != "Duracion_p10"} == {k: v for k, v in near.items() if k != "Duracion_p10"}


def test_month_ends_of_a_year(spark):
    from pyspark.sql import functions as F

    from loanroll.functions.calendar import date_key, month_ends_col, month_ends_of_year

    got = {r[0]: r[1] for r in spark.createDataFrame([(2023,), (2024,), (1900,), (2000,)], "y int").select("y", month_ends_col(F.col("y"))).collect()}
    assert got == {y: [date_key(d) for d in month_ends_of_year(y)] for y in got} and got[2024][1] == 20240229
