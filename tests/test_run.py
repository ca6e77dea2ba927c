"""Report jobs end to end on the smallest fixture."""

import json

import pytest

from tables import SF_SMALL
from loanroll.operators import ledger as L
from loanroll.plans.registry import fixture_params
from loanroll.plans.run import main, run_all
from loanroll.session import scratch_dir
from loanroll.sources.fixtures import staged_sources
from loanroll.sources.model import TABLES


def test_run_all_writes_every_sheet(spark):
    out = run_all(spark, staged_sources(spark, SF_SMALL), fixture_params(), scratch_dir(spark, "t-run"))
    assert "Vigentes_70" in out and "extract" in out and "v1/Resumen" in out
    assert "Resumen y créditos vigentes Junio" in out["Resumen"]
    assert spark.read.parquet(out["roll/MATRIZ RODAMIENTOS UNIDADES"]).count() == 14
    assert "Saldo a capital" in spark.read.parquet(out["Vigentes_70"]).columns


def test_assert_unique_key(spark):
    src = staged_sources(spark, SF_SMALL)
    assert L.assert_unique_key(src.restructuring_mark.filter("id_marca IS NOT NULL"), ["id_marca"]).isEmpty()
    assert not L.assert_unique_key(src.ledger_month, ["credito", "id_fecha"]).isEmpty()


def test_exclusions_and_unique_option(spark):
    from loanroll.plans.reports import ValuationReport

    src = staged_sources(spark, SF_SMALL)
    some = src.ledger_month.filter("credito IS NOT NULL").select("credito").distinct().orderBy("credito").limit(5)
    kept = ValuationReport(src, fixture_params(), exclusions=some).profile
    assert kept.join(some, "credito").isEmpty()
    with pytest.raises(ValueError):  # the fixture repeats snapshot rows
        ValuationReport(src, fixture_params(assert_unique=True)).valuation


def test_runs_on_stored_tables_from_the_command_line(spark):
    """Tables as a warehouse stores them (the tape as a CSV with its preamble), named in a JSON file."""
    src = staged_sources(spark, SF_SMALL)
    base, out = scratch_dir(spark, "t-stored"), scratch_dir(spark, "t-stored-out")
    tables = {}
    for name in TABLES:
        tables[name] = f"{base}/{name}"
        getattr(src, name).write.parquet(tables[name])
    tape = src.purchase_tape_raw.collect()
    tables["purchase_tape_raw"] = f"{base}/tape.csv"
    with open(tables["purchase_tape_raw"], "w") as f:
        f.write("a\nb\n20240101,1,1\nCredito,Suma de Importe base,Precio de compra\n")
        f.writelines(",".join("" if v is None else str(v) for v in r) + "\n" for r in tape)
    with open(f"{base}/tables.json", "w") as f:
        json.dump(tables, f)
    main(["--tables", f"{base}/tables.json", "--as-of", "2001-07-15", "--out", out])
    folder = f"{out}/valuation/Resumen y créditos vigentes Junio"
    kept = spark.read.parquet(f"{folder}/Cartera")
    assert kept.count() == sum(r["credito"] is not None for r in tape)
    from loanroll.plans.reports import ValuationReport

    direct = ValuationReport(src, fixture_params())
    assert spark.read.parquet(f"{folder}/Vigentes_70").count() == direct.live_70.count() > 0
    assert spark.read.parquet(f"{folder}/Vigentes_71").count() == direct.live_71.count() > 0


def test_default_date_is_today():
    import datetime as dt

    from loanroll.plans.reports import ReportParams, last_two_months

    assert ReportParams().as_of == dt.date.today()
    assert last_two_months(dt.date(2025, 1, 10)) == ((2024, 11), (2024, 12))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from loanroll.session import ensure_checkpoint_dir

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master))


def test_cluster_conf_sizes_partitions():
    from loanroll.session import cluster_conf

    conf = cluster_conf(shuffle_bytes=10 * 1024 ** 4, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 40961
    assert cluster_conf(1.0, cores=8)["spark.sql.shuffle.partitions"] == "16"
