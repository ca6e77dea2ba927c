"""

Each query takes ``(spark, sf_dir)``, derives the report sources from the
driver's tables (``loanroll.sources.fixtures``) and returns a lazy DataFrame.
Doubles are rounded (6 decimals, sums of money 2) at this presentation step only, so the
DuckDB oracle (same rounding) can be compared value by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanroll.functions.calendar import (
    CLOSING_WINDOW_DAYS,
    date_of_key,
    key_of,
    month_ends_col,
    month_name_col,
    previous_month_end_col,
)
from loanroll.operators import ledger as L
from loanroll.operators import recovery as R
from loanroll.operators import state as S
from loanroll.operators import valuation as V
from loanroll.plans import run
from loanroll.plans.presentation import KEYS_AS_DOUBLES, MONEY_DIGITS, MONEY_SUMS, ROUND_DIGITS
from loanroll.plans.reports import ExtractReport, Observed, ReportParams, RollReport, ValuationReport
from loanroll.sources import readers, sinks
from loanroll.sources.fixtures import FIXTURE_AS_OF, ROLL_MONTHS, ledger_month_wide, write_tape_csv
from loanroll.sources.fixtures import staged_sources as fixture_sources
from loanroll.sources.layout import in_period
from loanroll.sources.schemas import LEDGER_COLUMNS, LEDGER_MONTH_WIDE
from loanroll.session import scratch_dir, write_and_read



def present(df: DataFrame) -> DataFrame:
    """Round double columns (NaN and +-Inf pass through unchanged); show the
    integer columns that can hold gaps as doubles."""
    cols = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if f.name in KEYS_AS_DOUBLES:
            c = f"CAST({c} AS DOUBLE)"
        elif f.name in MONEY_SUMS:
            c = f"rint({c} * {10 ** MONEY_DIGITS}) / {10 ** MONEY_DIGITS}"
        elif isinstance(f.dataType, T.DoubleType):
            c = f"round({c}, {ROUND_DIGITS})"
        cols.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*cols)


def fixture_params(**params) -> ReportParams:
    """The fixture's report date and month pair."""
    return ReportParams(**({"as_of": FIXTURE_AS_OF, "roll_months": ROLL_MONTHS} | params))


def _nv(spark: SparkSession, sf_dir: str, **params) -> ValuationReport:
    return ValuationReport(fixture_sources(spark, sf_dir), fixture_params(**params))


def _ov(spark: SparkSession, sf_dir: str, **params) -> ExtractReport:
    return ExtractReport(fixture_sources(spark, sf_dir), fixture_params(**params))


def _rm(spark: SparkSession, sf_dir: str, **params) -> RollReport:
    return RollReport(fixture_sources(spark, sf_dir), fixture_params(**params))


# --- scans / sources ---------------------------------------------------------

def ledger_sequence(spark, sf_dir):
    r = _nv(spark, sf_dir)
    return r.ledger_seq.select(*LEDGER_COLUMNS, "orden")


def daily_closing_snapshot(spark, sf_dir):
    return _nv(spark, sf_dir).daily


def ltv_snapshot(spark, sf_dir):
    return _nv(spark, sf_dir).ltv_snapshot


def ltv_snapshot_product(spark, sf_dir):
    return _ov(spark, sf_dir).ltv_snapshot


def first_restructuring_mark(spark, sf_dir):
    return V.first_restructuring_mark(fixture_sources(spark, sf_dir).restructuring_mark)


def purchase_tape(spark, sf_dir):
    return _nv(spark, sf_dir).tape


def csv2_roundtrip(spark, sf_dir):
    """K2 then S8: write the hand-off extract as a ';' / decimal-comma CSV, read it back."""
    extract = _ov(spark, sf_dir).extract
    path = sinks.write_csv2(extract, scratch_dir(spark, "csv2"), key=fixture_params().report_key)
    return readers.read_csv2(spark, path, extract.schema)


def latest_extract(spark, sf_dir):
    """Extracts for two report months land in one folder; read the newest file."""
    folder = scratch_dir(spark, "extracts")
    current = fixture_params()
    earlier = fixture_params(as_of=dt.date(current.as_of.year, current.as_of.month, 1) - dt.timedelta(days=1))
    schema = None
    for params in (earlier, current):
        extract = ExtractReport(fixture_sources(spark, sf_dir), params).extract
        schema = extract.schema
        sinks.write_csv2(extract, folder, key=params.report_key)
    return readers.read_latest_csv2(spark, folder, sinks.EXTRACT_PREFIX, schema)


# --- projections / filters ------------------------------------------------------

def product_slice(spark, sf_dir):
    r = _nv(spark, sf_dir)
    return L.with_year_month(r.product_rows)


def year_month_parts(spark, sf_dir):
    return L.with_year_month(_nv(spark, sf_dir).product_rows).select("credito", "id_fecha", "anio", "mes")


def exposure(spark, sf_dir):
    r = _nv(spark, sf_dir)
    return L.with_exposure(r.ledger_seq).select("credito", "id_fecha", "tipo_producto", "saldo_exposicion")


def exclude_loans(spark, sf_dir):
    """Ledger without the loans of a data-quality exclusion list.

    The scripts declare two id lists (loans with null values, loans with
    negative interest) and never apply them; here the list is derived by that
    rule from the ledger itself and applied with a left anti join.
    """
    src = fixture_sources(spark, sf_dir)
    ledger = src.ledger_month
    excluded = ledger.filter(F.col("saldo_capital").isNull() | (F.col("saldo_interes") < 0)).select("credito")
    report = ValuationReport(src, fixture_params(), exclusions=excluded)
    return report.ledger_seq.select(*LEDGER_COLUMNS, "orden")


# --- per-loan profile ---------------------------------------------------------------

def loan_span(spark, sf_dir):
    return L.loan_span(_nv(spark, sf_dir).profile)


def loan_span_mean(spark, sf_dir):
    return L.loan_span(_nv(spark, sf_dir).profile, mean_disbursement=True)


def first_last_observation(spark, sf_dir):
    return L.first_last_observation(_nv(spark, sf_dir).profile)


def first_last_capital(spark, sf_dir):
    return L.first_last_capital(_nv(spark, sf_dir).profile)


def recovery_base(spark, sf_dir):
    return _nv(spark, sf_dir).base


def zero_start_loans(spark, sf_dir):
    return L.zero_start_loans(_nv(spark, sf_dir).base)


def zero_start_history(spark, sf_dir):
    r = _nv(spark, sf_dir)
    return L.zero_start_history(r.ledger_seq, r.profile).select(*LEDGER_COLUMNS, "orden")


def prior_product_balance(spark, sf_dir):
    return L.prior_product_balance(_nv(spark, sf_dir).profile)


def last_two_non70(spark, sf_dir):
    return L.last_two_non_product(_ov(spark, sf_dir).profile)


def adjusted_recovery_base(spark, sf_dir):
    return _nv(spark, sf_dir).adjusted


def adjusted_capital_v1(spark, sf_dir):
    return _ov(spark, sf_dir).adjusted


# --- month by month ------------------------------------------------------------------

def _profile_by_month(spark, sf_dir, months: int = 3) -> DataFrame:
    """The profile from a state of all but the last months' rows, merged with one month after the other."""
    src = fixture_sources(spark, sf_dir)
    ledger, month = src.ledger_month, F.expr("id_fecha DIV 100")
    known = sorted(r[0] for r in ledger.filter("id_fecha IS NOT NULL").select(month).distinct().collect())[-months:]  # one row a month
    before = F.col("id_fecha").isNull() | (month < (known[0] if known else 0))
    state = write_and_read(S.loan_state(ledger.filter(before), max_loan_rows=src.max_loan_rows), "state")
    for ym in known:
        rows = ledger.filter(L.month_range(ym // 100, ym % 100) & in_period(ledger, ym // 100, ym % 100))
        state = write_and_read(S.merge(state, S.loan_state(rows, max_loan_rows=src.max_loan_rows)), "state")
    return S.profile(state)


def recovery_base_by_month(spark, sf_dir):
    return L.recovery_base(_profile_by_month(spark, sf_dir))


def prior_balance_by_month(spark, sf_dir):
    return L.prior_product_balance(_profile_by_month(spark, sf_dir))


def adjusted_capital_by_month(spark, sf_dir):
    return L.adjusted_capital_v1(_profile_by_month(spark, sf_dir))


# --- rates -----------------------------------------------------------------------------

def recovery_rate_exposure(spark, sf_dir):
    return R.exposure_rates(_nv(spark, sf_dir).adjusted)


def recovery_rate_exposure_initial(spark, sf_dir):
    return R.exposure_rates(_nv(spark, sf_dir, exposure_baseline="initial").adjusted)


def recovery_rate_arrears(spark, sf_dir):
    rates = R.arrears_capital_rates(_nv(spark, sf_dir).adjusted)
    return rates.select("credito", "Duracion_p70", "saldo_mora_inicial", "saldo_mora_actual",
                        "prop_recuperado_mora", "tasa_recuperacion_anual_mora")


def recovery_rate_capital(spark, sf_dir):
    rates = R.arrears_capital_rates(_nv(spark, sf_dir).adjusted)
    return rates.select("credito", "Duracion_p70", "saldo_capital_inicial", "saldo_capital_actual",
                        "prop_recuperado_capital", "tasa_recuperacion_anual_capital")


def recovery_rate_combined(spark, sf_dir):
    return R.arrears_capital_rates(_nv(spark, sf_dir).adjusted)


# --- valuation ----------------------------------------------------------------------

def valuation_table(spark, sf_dir):
    return _nv(spark, sf_dir).valuation


def _factor_view(valued: DataFrame, rate: str, factor: str) -> DataFrame:
    return valued.select("credito", "Duracion_p70", "LTV", rate, factor)


def price_factor_combined(spark, sf_dir):
    return _factor_view(_nv(spark, sf_dir).valued, "tasa_recuperacion_anual", "Valoracion_pd")


def price_factor_exposure(spark, sf_dir):
    return _factor_view(_nv(spark, sf_dir).valued, "tasa_recuperacion_anual_exp", "Valoracion_pd_mod")


def price_factor_capital(spark, sf_dir):
    return _factor_view(_nv(spark, sf_dir).valued, "tasa_recuperacion_anual_capital", "Valoracion_pd_cap")


def price_factor_origin_duration(spark, sf_dir):
    return _ov(spark, sf_dir).extract_with_mod.select(
        "credito", "Duracion_p10", "LTV", "tasa_recuperacion_anual", "Valoracion_pd_mod")


def price_factor_direct(spark, sf_dir):
    return _ov(spark, sf_dir).extract


def ltv_change(spark, sf_dir):
    return _ov(spark, sf_dir).ltv_change.select(
        "credito", "Saldo_capital_inicial", "Saldo_capital_final", "saldo_capital",
        "tasa_recuperacion_anual", "LTV", "LTV_ant", "valor_garantia_final", "garantia_anterior")


# --- portfolio ----------------------------------------------------------------------

def priced_portfolio(spark, sf_dir):
    return _nv(spark, sf_dir).priced


def priced_portfolio_v1(spark, sf_dir):
    return _ov(spark, sf_dir).priced


def active_loans(spark, sf_dir):
    return _nv(spark, sf_dir).active


def inactive_loans(spark, sf_dir):
    return _nv(spark, sf_dir).inactive


def portfolio_summary(spark, sf_dir):
    return _nv(spark, sf_dir).summary


def portfolio_summary_v1(spark, sf_dir):
    return _ov(spark, sf_dir).summary


def residual_loans(spark, sf_dir):
    return _nv(spark, sf_dir).residual


def residual_summary(spark, sf_dir):
    return _nv(spark, sf_dir).residual_summary


def residual_summary_v1(spark, sf_dir):
    return _ov(spark, sf_dir).residual_summary


def live_product_70(spark, sf_dir):
    return _nv(spark, sf_dir).live_70


def live_product_70_v1(spark, sf_dir):
    return _ov(spark, sf_dir).live_70


def live_product_71(spark, sf_dir):
    return _nv(spark, sf_dir).live_71


def live_product_71_v1(spark, sf_dir):
    return _ov(spark, sf_dir).live_71


def report_bundle_counts(spark, sf_dir):
    """K1's row counts; the priced portfolio that four of the five sheets share is written once."""
    report = _nv(spark, sf_dir)
    run.share(report, "priced")
    return sinks.bundle_counts(report.bundle())


def report_bundle_written(spark, sf_dir):
    """K1: the newest report's sheets written as the job writes them, then counted from the files."""
    report = _nv(spark, sf_dir)
    paths = run.write_valuation_report(spark, report, scratch_dir(spark, "bundle"))
    return sinks.bundle_counts({name: spark.read.parquet(path) for name, path in paths.items()})


def _roll_written(spark, sf_dir, name: str) -> DataFrame:
    paths = run.write_roll_report(spark, _rm(spark, sf_dir), scratch_dir(spark, "roll"))
    return spark.read.parquet(paths[name])


def bucket_share_written(spark, sf_dir):
    """K3: the share history written and read back (display names undone)."""
    back = {v: k for k, v in sinks.DISPLAY_NAMES.items()}
    df = _roll_written(spark, sf_dir, run.SHARE_HISTORY_NAME)
    return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])


def roll_matrices_written(spark, sf_dir):
    """K4: both matrices written and read back, units and shares side by side in long form by row."""
    units, share = (_roll_written(spark, sf_dir, n) for n in (run.UNITS_MATRIX_NAME, run.SHARE_MATRIX_NAME))
    return units.select("bucket_from", *[F.col(f"`{b}`").alias(f"n_{b}") for b in units.columns[1:]]).join(share, "bucket_from")


def purchase_tape_csv(spark, sf_dir):
    """The tape from exported files with a preamble, cut by position."""
    path = scratch_dir(spark, "tape") + ".csv"
    write_tape_csv(fixture_sources(spark, sf_dir).purchase_tape_raw, path)
    return V.purchase_tape(readers.read_purchase_tape_csv(spark, path))


def ledger_wide(spark, sf_dir):
    """The wider ledger, written and read with its declared schema."""
    path = scratch_dir(spark, "ledger-wide")
    ledger_month_wide(spark, sf_dir).write.parquet(path)
    return readers.read_parquet_table(spark, path, LEDGER_MONTH_WIDE)


# --- calendar --------------------------------------------------------------------------

def _report_dates(spark, sf_dir) -> DataFrame:
    """Every month end of the ledger taken as a report run date."""
    return fixture_sources(spark, sf_dir).ledger_month.select("id_fecha").filter("id_fecha IS NOT NULL").distinct()


def calendar_keys(spark, sf_dir):
    """F2/F3/F13/F15/F16 for each ledger month end used as ``as_of``."""
    as_of = date_of_key(F.col("id_fecha"))
    me = previous_month_end_col(as_of)
    window = F.sequence(F.date_add(me, 1), F.date_add(me, CLOSING_WINDOW_DAYS))
    return _report_dates(spark, sf_dir).select(
        "id_fecha",
        key_of(me).alias("fecha_actual"),
        F.array_join(F.transform(window, lambda d: F.date_format(d, "yyyyMMdd")), ",").alias("fechas_cierre"),
    )


def previous_month_name(spark, sf_dir):
    """K5: Spanish name of the month before each run date (January -> Diciembre)."""
    me = previous_month_end_col(date_of_key(F.col("id_fecha")))
    return _report_dates(spark, sf_dir).select("id_fecha", month_name_col(F.month(me)).alias("nombre_mes"))


def month_ends_of_year(spark, sf_dir):
    """the twelve month ends of every year that the ledger has rows of, with the rows of each."""
    ledger = fixture_sources(spark, sf_dir).ledger_month.filter("id_fecha IS NOT NULL").select("id_fecha")
    by_month = ledger.groupBy("id_fecha").agg(F.count(F.lit(1)).alias("filas"))
    years = by_month.select(F.expr("id_fecha DIV 10000").cast("int").alias("anio")).distinct()
    ends = years.select("anio", F.posexplode(month_ends_col(F.col("anio"))).alias("i", "id_fecha"))
    named = ends.select("anio", (F.col("i") + 1).alias("numero"), "id_fecha", month_name_col(F.col("i") + 1).alias("nombre"))
    return named.join(by_month, "id_fecha", "left").withColumn("filas", F.coalesce("filas", F.lit(0)))


def default_report_dates(spark, sf_dir):
    """what a report without a date reads: the month before today, its closing window, and the ledger's rows up to it."""
    params = ReportParams()
    ledger = fixture_sources(spark, sf_dir).ledger_month
    (y0, m0), (y1, m1) = params.months
    return ledger.filter(F.col("id_fecha") <= params.report_key).agg(F.count(F.lit(1)).alias("filas")).select(
        F.lit(params.report_key).alias("fecha_actual"), F.lit(",".join(map(str, params.window_keys))).alias("fechas_cierre"),
        F.lit(f"{y0:04d}{m0:02d}").alias("mes_t0"), F.lit(f"{y1:04d}{m1:02d}").alias("mes_t1"), "filas")


# --- checks ----------------------------------------------------------------------------

def fan_out_check(spark, sf_dir):
    """Rows before and after each join of the report, counted by the pass that writes the priced portfolio."""
    report = ValuationReport(fixture_sources(spark, sf_dir), fixture_params(), observed=Observed())
    run.share(report, "priced")
    rows = [(name, before, after, after - before) for name, (before, after) in report.check_fan_out().items()]
    return spark.createDataFrame(rows, "lado string, filas_antes bigint, filas_despues bigint, filas_de_mas bigint")


def jdbc_split_ranges(spark, sf_dir):
    """The ledger's dates in ranges of about equal rows, as a warehouse read would be split."""
    return readers.split_ranges(fixture_sources(spark, sf_dir).ledger_month, "id_fecha", 8)


# --- roll rates ------------------------------------------------------------------------

def dpd_bucket(spark, sf_dir):
    return _rm(spark, sf_dir).bucketed.select("credito", "id_fecha", "anio", "mes", "numero_dias_mora", "icvs")


def bucket_share_history(spark, sf_dir):
    return _rm(spark, sf_dir).share_history


def bucket_one_hot(spark, sf_dir):
    return _rm(spark, sf_dir).one_hot


def bucket_one_hot_common(spark, sf_dir):
    return _rm(spark, sf_dir).one_hot_common


def common_loans(spark, sf_dir):
    return _rm(spark, sf_dir).common


def roll_matrix_units(spark, sf_dir):
    return _rm(spark, sf_dir).units


def roll_matrix_share(spark, sf_dir):
    return _rm(spark, sf_dir).share


def roll_matrix_check(spark, sf_dir):
    return _rm(spark, sf_dir).check


def collections_flag(spark, sf_dir):
    return _rm(spark, sf_dir).collections_flag


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [
        ledger_sequence, daily_closing_snapshot, ltv_snapshot, ltv_snapshot_product,
        first_restructuring_mark, purchase_tape, csv2_roundtrip, latest_extract,
        product_slice, year_month_parts, exposure, exclude_loans,
        loan_span, loan_span_mean, first_last_observation, first_last_capital, recovery_base,
        zero_start_loans, zero_start_history, prior_product_balance, last_two_non70,
        adjusted_recovery_base, adjusted_capital_v1,
        recovery_base_by_month, prior_balance_by_month, adjusted_capital_by_month,
        recovery_rate_exposure, recovery_rate_exposure_initial, recovery_rate_arrears,
        recovery_rate_capital, recovery_rate_combined,
        valuation_table, price_factor_combined, price_factor_exposure, price_factor_capital,
        price_factor_origin_duration, price_factor_direct, ltv_change,
        priced_portfolio, priced_portfolio_v1, active_loans, inactive_loans,
        portfolio_summary, portfolio_summary_v1, residual_loans, residual_summary,
        residual_summary_v1, live_product_70, live_product_70_v1, live_product_71,
        live_product_71_v1, report_bundle_counts,
        report_bundle_written, bucket_share_written, roll_matrices_written, purchase_tape_csv, ledger_wide,
        calendar_keys, previous_month_name, month_ends_of_year, default_report_dates, fan_out_check, jdbc_split_ranges,
        dpd_bucket, bucket_share_history, bucket_one_hot, bucket_one_hot_common, common_loans,
        roll_matrix_units, roll_matrix_share, roll_matrix_check, collections_flag,
    ]
}


def _presented(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _presented(fn) for name, fn in _QUERIES.items()}
