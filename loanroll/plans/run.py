"""Report jobs: build the reports and write them (K1-K5).

Several sheets of one report share an upstream graph (rates, valuation,
pricing). Before writing them, that shared DataFrame is materialized once as
a Parquet table in the shared checkpoint folder (``spark.checkpoint.dir``):
each sheet then reads it instead of recomputing the rate stage, and a lost
executor costs a re-read, not a recomputation from the ledger.

Command line, on stored tables (a JSON file maps each source table to a
Parquet folder, a ``.csv`` tape, or the JDBC reader's options), or on the test
fixture derived from the driver's tables::

    python -m loanroll.plans.run --tables tables.json --out /shared/out
    python -m loanroll.plans.run --sf-dir /root/testdata/sf0.01 --as-of 2001-07-15 --out /shared/out
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from loanroll.functions.calendar import previous_month_name
from loanroll.operators.state import advance
from loanroll.plans.reports import ExtractReport, Observed, ReportParams, RollReport, ValuationReport
from loanroll.session import write_and_read
from loanroll.sources import readers, sinks
from loanroll.sources.model import Sources


# Report folder and dataset names (the scripts' file names, without
# their hard-coded period suffix, see D9).
VALUATION_FOLDER = "Resumen y créditos vigentes"
SHARE_HISTORY_NAME = "PROPORCION DE SALDO A CAPITAL POR CATEGORIA DE VENCIMIENTO"
UNITS_MATRIX_NAME = "MATRIZ RODAMIENTOS UNIDADES"
SHARE_MATRIX_NAME = "MATRIZ RODAMIENTOS PROPORCIONES"


def share(report, attr: str) -> None:
    """Replace a cached report stage by its materialized table."""
    report.__dict__[attr] = write_and_read(getattr(report, attr), attr)


def write_valuation_report(spark: SparkSession, report: ValuationReport, out_dir: str) -> dict[str, str]:
    """K1 + K5: the five sheets of the newest script, one dataset each, under a
    folder named after the previous month (``Resumen y créditos vigentes <Mes>``)."""
    if report.observed is None and "valuation" not in report.__dict__ and "priced" not in report.__dict__:
        report.observed = Observed()
    share(report, "priced")
    if report.observed:
        report.check_fan_out()  # before anything is published
    folder = f"{out_dir.rstrip('/')}/{VALUATION_FOLDER} {previous_month_name(report.params.as_of)}"
    return sinks.write_bundle(report.bundle(), folder)


def write_extract(report: ExtractReport, out_dir: str) -> str:
    """K2: the older script's hand-off extract (';' CSV, decimal comma), built once for the older report too."""
    if report.observed is None and "extract" not in report.__dict__:
        report.observed = Observed()
    share(report, "extract")
    if report.observed:
        report.check_fan_out()  # before anything is published
    return sinks.write_csv2(report.extract, out_dir, key=report.params.report_key)


def write_extract_report(spark: SparkSession, report: ExtractReport, out_dir: str) -> dict[str, str]:
    """K1 for the older report: tape, summary, residual, live 70/71 lists."""
    share(report, "priced")
    if report.observed:
        report.check_fan_out()
    bundle = {
        "Cartera": report.tape,
        "Resumen": report.summary,
        "residuo": report.residual,
        "Vigentes_70": report.live_70,
        "Vigentes_71": report.live_71,
    }
    return sinks.write_bundle(bundle, f"{out_dir.rstrip('/')}/{VALUATION_FOLDER} modificado")


def write_roll_report(spark: SparkSession, report: RollReport, out_dir: str) -> dict[str, str]:
    """K3 (share history) + K4 (unit and share matrices, ``bucket_from`` first)."""
    share(report, "units")
    base = out_dir.rstrip("/")
    return sinks.write_bundle({
        SHARE_HISTORY_NAME: report.share_history,
        UNITS_MATRIX_NAME: report.units,
        SHARE_MATRIX_NAME: report.share,
    }, base)


def run_all(spark: SparkSession, sources: Sources, params: ReportParams, out_dir: str, state_dir: str | None = None) -> dict[str, str]:
    """All reports. With ``state_dir`` the profile comes from the state stored there, merged with the months up to
    the report's (rows of later months are then left out); only those months of the ledger are read for it."""
    out, state = {}, None
    if state_dir:
        state = advance(sources.ledger_month, state_dir, params.report_key // 100, params.product, params.tie_break, sources.max_loan_rows)
    out.update(write_valuation_report(spark, ValuationReport(sources, params, state=state), f"{out_dir}/valuation"))
    extract_report = ExtractReport(sources, params, state=state)
    out["extract"] = write_extract(extract_report, f"{out_dir}/extracts")
    out.update({f"v1/{k}": v for k, v in
                write_extract_report(spark, extract_report, f"{out_dir}/valuation_v1").items()})
    out.update({f"roll/{k}": v for k, v in
                write_roll_report(spark, RollReport(sources, params), f"{out_dir}/roll").items()})
    return out


def main(argv: list[str] | None = None) -> None:
    from loanroll.session import get_session

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="JSON file: source table -> Parquet folder, .csv tape or JDBC options")
    source.add_argument("--sf-dir", help="folder of the driver's parquet tables (the test fixture)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--state", default=None, help="folder of the per-loan states by month: read, advanced and written")
    ap.add_argument("--as-of", default=None,
                    help="report run date, YYYY-MM-DD (default: today)")
    args = ap.parse_args(argv)
    spark = get_session()
    params = ReportParams(as_of=dt.date.fromisoformat(args.as_of)) if args.as_of else ReportParams()
    if args.tables:
        with open(args.tables, encoding="utf-8") as f:
            sources = readers.warehouse_sources(spark, json.load(f))
    else:
        from loanroll.sources.fixtures import staged_sources

        sources = staged_sources(spark, args.sf_dir)
    for name, path in run_all(spark, sources, params, args.out, args.state).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
